"""Plans that are stored and loaded, in this process and in another one after the fit's own tables are gone."""

import datetime as dt
import json
import shutil
import subprocess
import sys
import warnings
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessella.errors import InvalidDataError, TransformerInputError
from tessella.functions import tables
from tessella.operators.base import ColumnFunctions
from tessella.operators.categorical import FrequencyEncoder, LabelEncoder, OneHotEncoder, OrderedLabelEncoder, UniformEncoder
from tessella.operators.ids import IndexGenerator, RegexGenerator
from tessella.operators.numeric import ClusterBasedNormalizer, FloatFormatter, GaussianNormalizer, LogScaler
from tessella.operators.pii import AnonymizedFaker, PseudoAnonymizedFaker
from tessella.operators.temporal import OptimizedTimestampEncoder, UnixTimestampEncoder
from tessella.plans.store import load, save
from tessella.plans.table import HyperTransformer

KINDS = {
    "number": (FloatFormatter(learn_rounding_scheme=True, enforce_min_max_values=True, missing_value_generation="from_column"), "numerical", "CASE WHEN id % 7 = 0 THEN NULL ELSE id / 4 END"),
    "bell": (GaussianNormalizer(distribution="gamma"), "numerical", "1 + pow(id % 37, 2)"),
    "kernel": (GaussianNormalizer(distribution="gaussian_kde"), "numerical", "CAST(id % 50 AS DOUBLE)"),
    "mixed": (ClusterBasedNormalizer(), "numerical", "CASE WHEN id % 3 = 0 THEN id % 10 ELSE 500 + id % 11 END"),
    "log": (LogScaler(constant=-1.0), "numerical", "CAST(id AS DECIMAL(12, 2))"),
    "few": (UniformEncoder(), "categorical", "CASE WHEN id % 9 = 0 THEN NULL ELSE concat('c', id % 5) END"),
    "many": (LabelEncoder(order_by="alphabetical"), "categorical", "concat('name', lpad(CAST(id AS STRING), 5, '0'))"),
    "hot": (OneHotEncoder(), "categorical", "concat('h', id % 3)"),
    "ordered": (OrderedLabelEncoder([2, 1, 0]), "categorical", "id % 3"),
    "day": (UnixTimestampEncoder(), "datetime", "date_format(date_add(DATE '2001-02-03', CAST(id AS INT)), 'd.M.yyyy')"),
    "moment": (OptimizedTimestampEncoder(), "datetime", "CAST(date_add(DATE '2001-02-03', CAST(id AS INT)) AS TIMESTAMP_NTZ)"),
    "code": (RegexGenerator("[A-Z]{4}", generation_order="scrambled", cardinality_rule="unique"), "id", "CAST(id AS STRING)"),
    "mail": (AnonymizedFaker("internet", "email", cardinality_rule="match"), "pii", "concat('m', id % 40)"),
    "alias": (PseudoAnonymizedFaker("person", "name"), "pii", "concat('p', id % 30)"),
    "serial": (IndexGenerator("s-"), "id", "CAST(id AS STRING)"),
}


def data(spark):
    return spark.range(1500).selectExpr("id AS k", *[f"{sql} AS {name}" for name, (_, _, sql) in KINDS.items()])


@pytest.fixture(scope="module")
def plan(spark):
    out = HyperTransformer("k")
    out.set_config({"sdtypes": {"k": "id", **{n: s for n, (_, s, _) in KINDS.items()}}, "transformers": {"k": None, **{n: t for n, (t, _, _) in KINDS.items()}}})
    out.fit(data(spark))
    return out


def results(plan, spark):
    plan.reset_randomization()
    made = plan.transform(data(spark))
    back = plan.reverse_transform(made)
    return [sorted(map(str, df.collect())) for df in (made, back)]


def test_a_loaded_plan_gives_the_same(spark, plan, tmp_path):
    expected = results(plan, spark)
    plan.save(f"{tmp_path}/plan")
    again = HyperTransformer.load(f"{tmp_path}/plan")
    assert results(again, spark) == expected
    assert repr(again.get_config()) == repr(plan.get_config())
    assert [t.get_name() for t in again._sequence] == [t.get_name() for t in plan._sequence]
    # the config's operators are the fitted ones, not copies of them
    assert again.field_transformers["many"] in again._sequence


def test_another_process_loads_it_after_the_fit_s_tables_are_gone(spark, plan, tmp_path):
    expected = [r.many for r in plan.transform(data(spark)).orderBy("k").limit(5).collect()]
    plan.field_transformers["many"].reset_randomization()
    save(plan, f"{tmp_path}/plan")
    told = json.loads((next((tmp_path / "plan" / "state").glob("part-*.txt"))).read_text())
    assert tables.shared_root(spark) not in json.dumps(told)
    code = (
        "import sys, json; sys.path.insert(0, '.')\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '1').getOrCreate()\n"
        "from tessella.plans.store import load\n"
        f"t = load('{tmp_path}/moved').field_transformers['many']\n"
        "df = spark.range(5).selectExpr('id AS k', \"concat('name', lpad(CAST(id AS STRING), 5, '0')) AS many\")\n"
        "print(json.dumps([r.many for r in t.transform(df).orderBy('k').collect()]))\n"
    )
    shutil.move(f"{tmp_path}/plan", f"{tmp_path}/moved")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert json.loads(out.stdout.strip().splitlines()[-1]) == expected


def test_values_of_all_types(spark, tmp_path):
    t = UniformEncoder()
    for k, value in enumerate([1.5, float("inf"), Decimal("1.20"), dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5, 6), b"\x00\xff", (1, "a"), {3: [None, True]}, {"x"}, frozenset({2}), dt.timedelta(1, 2, 3)]):
        t.extra = value
        save(t, f"{tmp_path}/{k}")
        found = load(f"{tmp_path}/{k}").extra
        assert (found, type(found)) == (value, type(value))


class Halved(ColumnFunctions):
    """A user's operator."""

    def __init__(self):
        super().__init__(None, None)

    def _made(self, function, x, kind):
        return x / 2 if kind is None else x * 2


def test_what_cannot_be_stored(spark, tmp_path):
    save(Halved(), f"{tmp_path}/own")
    assert isinstance(load(f"{tmp_path}/own"), Halved)
    with pytest.raises(InvalidDataError, match="can't be stored"):
        save(ColumnFunctions(lambda x: x, lambda y: y), f"{tmp_path}/lambda")
    save(FrequencyEncoder(), f"{tmp_path}/old")
    state = next((tmp_path / "old" / "state").glob("part-*.txt"))
    for old, new, message in (('"version": 1', '"version": 0', "layout"), ("tessella.operators.categorical:FrequencyEncoder", "os:system", "not known")):
        spark.createDataFrame([(state.read_text().replace(old, new).strip(),)], "state string").coalesce(1).write.mode("overwrite").text(f"{tmp_path}/bad/state")
        with pytest.raises(InvalidDataError, match=message):
            load(f"{tmp_path}/bad")


def test_nested_columns_and_missing_keys_are_told(spark):
    with pytest.raises(TransformerInputError, match="nested"):
        FloatFormatter().fit(spark.range(2).selectExpr("array(id) AS x"), "x")
    plan = HyperTransformer("k")
    plan.set_config({"sdtypes": {"k": "id", "x": "categorical"}, "transformers": {"k": None, "x": UniformEncoder()}})
    df = spark.range(6).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id") % 2).alias("x"))
    plan.fit(df)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        plan.transform(df)
    with pytest.warns(UserWarning, match="lack the row key"):
        plan.transform_subset(df.select("x"))
