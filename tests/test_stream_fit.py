"""Plans of statistics that batches left, against one fit over all rows."""

import pytest

from tessella.errors import NotFittedError
from tessella.operators.boolean import BinaryEncoder
from tessella.operators.categorical import LabelEncoder, OneHotEncoder, OrderedUniformEncoder, UniformEncoder
from tessella.operators.ids import IndexGenerator
from tessella.operators.numeric import ClusterBasedNormalizer, FloatFormatter, GaussianNormalizer, LogitScaler, LogScaler
from tessella.operators.pii import AnonymizedFaker, PseudoAnonymizedFaker
from tessella.operators.temporal import OptimizedTimestampEncoder, UnixTimestampEncoder
from tessella.plans.table import HyperTransformer
from tessella.streaming.fit import StreamFit, fit_batches

NUMBER = "CASE WHEN id % 5 = 0 THEN NULL ELSE (id * 37 % 101) / 4.0D END"
CASES = {
    "float": (lambda: FloatFormatter(learn_rounding_scheme=True, enforce_min_max_values=True, missing_value_generation="from_column"), "numerical", NUMBER),
    "mode": (lambda: FloatFormatter("mode"), "numerical", NUMBER),
    "random": (lambda: FloatFormatter("random", computer_representation="Int16"), "numerical", "id * 3"),
    "log": (lambda: LogScaler(constant=-1.0), "numerical", NUMBER),
    "inverted": (lambda: LogScaler(constant=99.0, invert=True), "numerical", NUMBER),
    "logit": (lambda: LogitScaler(max_value=30.0), "numerical", NUMBER),
    "norm": (lambda: GaussianNormalizer(distribution="norm"), "numerical", NUMBER),
    "truncnorm": (lambda: GaussianNormalizer(), "numerical", NUMBER),
    "binary": (lambda: BinaryEncoder(), "boolean", "id % 3 = 0"),
    "uniform": (lambda: UniformEncoder(), "categorical", "CASE WHEN id % 4 = 0 THEN NULL ELSE concat('v', (id * 7) % 13) END"),
    "label": (lambda: LabelEncoder(), "categorical", "concat('v', (id * 7) % 13)"),
    "many": (lambda: LabelEncoder(order_by="alphabetical"), "categorical", "concat('n', id)"),
    "hot": (lambda: OneHotEncoder(), "categorical", "id % 4"),
    "ordered": (lambda: OrderedUniformEncoder([3, 2, 1, 0, 9]), "categorical", "id % 4"),
    "unix": (lambda: UnixTimestampEncoder(datetime_format="%d.%m.%Y"), "datetime", "date_format(date_add(DATE '2001-02-03', CAST(id AS INT)), 'dd.MM.yyyy')"),
    "optimized": (lambda: OptimizedTimestampEncoder(enforce_min_max_values=True), "datetime", "CAST(date_add(DATE '2001-02-03', CAST(id % 50 AS INT)) AS TIMESTAMP_NTZ)"),
    "fake": (lambda: AnonymizedFaker("internet", "email"), "pii", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'x' END"),
    "index": (lambda: IndexGenerator("i"), "id", "concat('i', id)"),
}


def table(spark, names=CASES):
    return spark.range(1300).selectExpr("id AS k", *[f"{CASES[n][2]} AS {n}" for n in names])


def maker(names=CASES, operators=None):
    def make():
        plan = HyperTransformer("k")
        own = operators or {n: CASES[n][0]() for n in names}
        plan.set_config({"sdtypes": {"k": "id", **{n: CASES[n][1] for n in names}}, "transformers": {"k": None, **own}})
        return plan

    return make


def results(plan, df):
    made = plan.transform(df)
    back = plan.reverse_transform(made)
    return [sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x.collect()) for x in (made, back)] if made else None


def test_every_operator_as_by_one_fit(spark, tmp_path):
    df = table(spark)
    whole = maker()()
    whole.fit(df)
    fit = StreamFit(maker(), str(tmp_path))
    with pytest.raises(NotFittedError):
        fit.plan(spark)
    # uneven batches, one without rows, one that comes again
    for k, rows in enumerate(("k % 7 = 3", "k < 900 AND k % 7 <> 3", "k < 0", "k >= 900 AND k % 7 <> 3")):
        fit.absorb(df.where(rows), k)
    fit.absorb(df.where("k < 900 AND k % 7 <> 3"), 1)
    plan = fit.plan(spark)
    key = lambda r: tuple(map(str, r))
    for a, b in zip((whole.transform(df), whole.reverse_transform(whole.transform(df))), (plan.transform(df), plan.reverse_transform(plan.transform(df))), strict=True):
        assert a.columns == b.columns
        first, second = ([tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in x.collect()] for x in (a, b))
        assert sorted(first, key=key) == sorted(second, key=key)


def test_a_stream_is_absorbed_by_batch(spark, tmp_path):
    names = ["float", "uniform"]
    df = table(spark, names)
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    fit = StreamFit(maker(names), f"{tmp_path}/fit")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    fit.start(stream, f"{tmp_path}/state").awaitTermination()
    assert len(list((tmp_path / "fit" / "stats").glob("batch=*"))) == 3
    whole = maker(names)()
    whole.fit(df)
    assert fit.plan(spark).field_transformers["uniform"].intervals == whole.field_transformers["uniform"].intervals
    assert fit.plan(spark).field_transformers["float"].null_transformer.value == pytest.approx(whole.field_transformers["float"].null_transformer.value, rel=1e-14)


@pytest.mark.parametrize(
    ("name", "operator"),
    [("float", ClusterBasedNormalizer()), ("float", GaussianNormalizer(distribution="gamma")), ("fake", AnonymizedFaker("internet", "email", cardinality_rule="match")), ("fake", PseudoAnonymizedFaker("person", "name")), ("unix", UnixTimestampEncoder())],
)
def test_operators_that_look_twice_are_refused(spark, tmp_path, name, operator):
    with pytest.raises(ValueError, match="one look"):
        fit_batches(maker([name], {name: operator}), str(tmp_path), [table(spark, [name])], spark)
