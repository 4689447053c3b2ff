import pickle

import pytest
from pyspark.sql import functions as F

from tessella import HyperTransformer, get_demo
from tessella.errors import ConfigNotSetError, InvalidConfigError, InvalidDataError, NotFittedError, TransformerInputError
from tessella.operators.base import BaseMultiColumnTransformer, ColumnFunctions
from tessella.operators.categorical import LabelEncoder, OneHotEncoder, UniformEncoder
from tessella.operators.ids import IndexGenerator, RegexGenerator
from tessella.operators.numeric import FloatFormatter
from tessella.plans import registry
from tessella.plans.performance import evaluate_transformer_performance, profile_transformer
from tessella.plans.validators import AddressValidator, GPSValidator
from tessella.streaming.apply import refit_by_batch, reverse_stream, transform_stream


def test_demo_round_trip(spark):
    df = get_demo(spark, 20)
    plan = HyperTransformer()
    plan.detect_initial_config(df)
    assert plan.get_config()["sdtypes"] == {"last_login": "datetime", "email_optin": "boolean", "credit_card": "categorical", "age": "numerical", "dollars_spent": "numerical"}
    made = plan.fit_transform(df)
    assert all(kind in ("double", "bigint", "int") for _, kind in made.dtypes)
    assert all(v is not None for r in made.collect() for v in r)
    back = plan.reverse_transform(made)
    assert back.columns == df.columns
    assert sorted(r.age for r in back.collect()) == sorted(r.age for r in df.collect())
    assert "FloatFormatter()" in repr(plan.get_config())


def test_config_is_checked(spark):
    plan = HyperTransformer()
    df = spark.createDataFrame([(1.0, "a")], "n double, c string")
    with pytest.raises(ConfigNotSetError):
        plan.fit(df)
    with pytest.raises(InvalidConfigError):
        plan.set_config({"sdtypes": {"n": "numerical"}, "transformers": {}})
    with pytest.raises(InvalidConfigError):
        plan.set_config({"sdtypes": {"n": "numerical"}, "transformers": {"n": UniformEncoder()}})
    shared = FloatFormatter()
    with pytest.raises(InvalidConfigError, match="share"):
        plan.set_config({"sdtypes": {"n": "numerical", "m": "numerical"}, "transformers": {"n": shared, "m": shared}})
    plan.detect_initial_config(df)
    with pytest.raises(InvalidConfigError):
        plan.update_sdtypes({"n": "nothing"})
    with pytest.raises(InvalidDataError):
        plan.fit(df.drop("c"))
    plan.fit(df)
    with pytest.warns(UserWarning):
        plan.update_sdtypes({"n": "categorical"})
    with pytest.raises(NotFittedError):
        plan.transform(df)
    plan.update_transformers({"n": OneHotEncoder()})
    plan.update_transformers_by_sdtype("categorical", transformer_name="LabelEncoder", transformer_parameters={"add_noise": True})
    assert all(isinstance(t, LabelEncoder) for t in plan.field_transformers.values())
    plan.fit(df)
    plan.remove_transformers(["c"])
    assert plan.field_transformers["c"] is None


def test_chains_and_taken_names(spark):
    class Twice(ColumnFunctions):
        def __init__(self, after=None):
            super().__init__(lambda x: x * 2, lambda y: y / 2)
            self.output_properties = {"a": {"sdtype": "numerical", "next_transformer": after}}

    df = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0)], "`col` double, `col.a` double")
    plan = HyperTransformer()
    plan.set_config({"sdtypes": {"col": "numerical", "col.a": "numerical"}, "transformers": {"col": Twice(), "col.a": None}})
    with pytest.warns(UserWarning, match="taken"):
        made = plan.fit_transform(df)
    assert made.columns == ["col#.a", "col.a"]
    assert sorted(map(tuple, plan.reverse_transform(made).collect())) == [(1.0, 5.0), (2.0, 6.0)]
    plan = HyperTransformer()
    plan.set_config({"sdtypes": {"n": "numerical"}, "transformers": {"n": Twice(Twice(Twice()))}})
    made = plan.fit_transform(spark.createDataFrame([(1.0,), (-1.0,)], "n double"))
    assert sorted(r[0] for r in made.collect()) == [-8.0, 8.0]
    assert sorted(r.n for r in plan.reverse_transform(made).collect()) == [-1.0, 1.0]


class Total(BaseMultiColumnTransformer):
    SUPPORTED_SDTYPES = ["numerical"]

    def __init__(self):
        super().__init__()
        self.output_properties = {"total": {"sdtype": "float", "next_transformer": None}, "first": {"sdtype": "float", "next_transformer": None}}

    def forward(self, df, x, draws):
        a, b = (x[c] for c in self.columns)
        return df, {"total": a + b, "first": a}

    def inverse(self, df, y, draws):
        a, b = self.columns
        return df, {a: y["first"], b: y["total"] - y["first"]}


def test_several_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    plan = HyperTransformer()
    plan.set_config({"sdtypes": {"a": "numerical", "b": "numerical"}, "transformers": {("a", "b"): Total()}})
    made = plan.fit_transform(df)
    assert made.columns == ["total", "first"]
    assert sorted(map(tuple, plan.reverse_transform(made).collect())) == [(1.0, 2.0), (3.0, 4.0)]
    plan.update_transformers({"a": FloatFormatter()})
    assert set(plan.field_transformers) == {"a", "b"}


def test_subsets_and_new_rows(spark):
    df = spark.createDataFrame([(1.0, "x", "i"), (2.0, "y", "j")], "n double, c string, id string")
    plan = HyperTransformer()
    plan.set_config({"sdtypes": {"n": "numerical", "c": "categorical", "id": "id"}, "transformers": {"n": FloatFormatter(), "c": LabelEncoder(), "id": RegexGenerator("[a-z]{2}")}})
    plan.fit(df)
    assert plan.transform_subset(df.select("n")).columns == ["n"]
    assert plan.reverse_transform_subset(plan.transform(df).select("c")).columns == ["c"]
    assert sorted(r.id for r in plan.reverse_transform(plan.transform(df)).collect()) == ["aa", "ab"]
    plan.reset_randomization()
    assert sorted(r.id for r in plan.create_anonymized_columns(3, ["id"], spark).collect()) == ["aa", "ab", "ac"]
    with pytest.raises(InvalidConfigError):
        plan.create_anonymized_columns(3, ["n"], spark)
    with pytest.raises(ValueError):
        plan.create_anonymized_columns(0, ["id"], spark)


def test_calls_differ_until_reset(spark):
    df = spark.range(20).select("id", F.lit("v").alias("c"))
    plan = HyperTransformer("id")
    plan.set_config({"sdtypes": {"id": "id", "c": "categorical"}, "transformers": {"id": None, "c": UniformEncoder()}})
    plan.fit(df)
    first, second = ([r.c for r in plan.transform(df).orderBy("id").collect()] for _ in range(2))
    plan.reset_randomization()
    assert first != second
    assert first == [r.c for r in plan.transform(df.repartition(5)).orderBy("id").collect()]


def test_a_transform_is_one_projection_without_shuffles(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    plan = HyperTransformer("o_orderkey")
    plan.set_config({"sdtypes": {"o_orderkey": "id", "o_totalprice": "numerical", "o_orderstatus": "categorical"}, "transformers": {"o_orderkey": None, "o_totalprice": FloatFormatter(), "o_orderstatus": UniformEncoder()}})
    plan.fit(df)
    text = plan.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text
    assert "Python" not in text


def test_fitted_plans_are_pickled(spark):
    df = spark.range(1500).select("id", F.concat(F.lit("v"), "id").alias("many"), (F.col("id") % 3).cast("string").alias("few"), F.col("id").cast("double").alias("n"))
    plan = HyperTransformer("id")
    plan.set_config({"sdtypes": {"id": "id", "many": "categorical", "few": "categorical", "n": "numerical"}, "transformers": {"id": None, "many": UniformEncoder(), "few": LabelEncoder(), "n": FloatFormatter()}})
    plan.fit(df)
    assert plan.field_transformers["many"].dictionary.table is not None
    again = pickle.loads(pickle.dumps(plan))
    assert sorted(map(tuple, again.transform(df).collect())) == sorted(map(tuple, plan.transform(df).collect()))


def test_registry():
    assert registry.get_transformer_class("FloatFormatter") is FloatFormatter
    assert IndexGenerator in registry.get_transformers_by_type()["id"]
    assert isinstance(registry.get_default_transformer("boolean"), UniformEncoder)
    with pytest.raises(ValueError):
        registry.get_transformer_class("Nothing")
    assert registry.load_plugins() == []


def test_validators():
    AddressValidator.validate({"a": "city", "b": "state"})
    GPSValidator.validate({"a": "latitude", "b": "longitude"})
    for bad in ({"a": "city", "b": "city"}, {"a": "state", "b": "state_abbr"}, {"a": "nothing"}):
        with pytest.raises(TransformerInputError):
            AddressValidator.validate(bad)
    with pytest.raises(TransformerInputError):
        GPSValidator.validate({"a": "latitude"})


def test_streams(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") % 5).cast("string").alias("c"))
    df.write.parquet(str(tmp_path / "in"))
    plan = HyperTransformer("id")
    plan.set_config({"sdtypes": {"id": "id", "c": "categorical"}, "transformers": {"id": None, "c": UniformEncoder()}})
    plan.fit(df)
    stream = transform_stream(plan, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    plan.reset_randomization()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, plan.transform(df).collect()))


def test_a_stream_is_reversed(spark, tmp_path):
    plan = HyperTransformer("k")
    plan.set_config({"sdtypes": {"k": "id", "x": "numerical"}, "transformers": {"k": None, "x": FloatFormatter(missing_value_generation=None)}})
    data = spark.range(50).selectExpr("id AS k", "CAST(id AS DOUBLE) / 4 AS x")
    plan.fit_transform(data).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, x double").parquet(f"{tmp_path}/in")
    reverse_stream(plan, stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("k", "x").collect())) == [(i, i / 4) for i in range(50)]


def test_plans_are_fitted_again_by_batch(spark, tmp_path):
    def make():
        plan = HyperTransformer("k")
        plan.set_config({"sdtypes": {"k": "id", "x": "numerical"}, "transformers": {"k": None, "x": FloatFormatter(missing_value_generation=None)}})
        return plan

    for i in range(3):
        spark.createDataFrame([(i * 10, float(i)), (i * 10 + 1, None)], "k long, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("k long, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    refit_by_batch(stream, make, lambda df, plan, i: seen.append((i, id(plan), sorted(map(tuple, df.select("k", "x").collect())))), f"{tmp_path}/state", every=2).awaitTermination()
    assert [i for i, _, _ in seen] == [0, 1, 2]
    assert seen[0][1] == seen[1][1] != seen[2][1]
    # a batch's mean fills its nulls; a batch without a new fit has the mean of the one before
    first, last = (rows for _, _, rows in (seen[0], seen[2]))
    assert all(rows[0][1] == rows[1][1] for rows in (first, last))
    assert seen[1][2][1][1] == first[0][1]


def test_measurements(spark):
    found = profile_transformer(spark, FloatFormatter("mode"), "numerical", "Normal", 200, nulls=True, times=1)
    assert set(found) == {f"{step}_{what}" for step in ("fit", "transform", "reverse_transform") for what in ("time", "memory")} | {"transformed_bytes"}
    assert found["fit_memory"] > 0  # the counts' hash tables
    assert found["transform_memory"] == 0  # a projection holds none
    assert callable(evaluate_transformer_performance)
