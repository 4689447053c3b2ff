"""Values that don't fit: noted by a transform's own job, and told by errors."""

import math

import pytest
from pyspark.sql import functions as F

from tessella import HyperTransformer, Watch
from tessella.errors import InvalidDataError
from tessella.operators.categorical import FrequencyEncoder, LabelEncoder, OneHotEncoder, OrderedLabelEncoder, UniformEncoder
from tessella.operators.numeric import LogitScaler, LogScaler


def jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def save(df):
    df.write.format("noop").mode("overwrite").save()


@pytest.mark.filterwarnings("ignore:FrequencyEncoder")
@pytest.mark.parametrize("make", [UniformEncoder, LabelEncoder, FrequencyEncoder, OneHotEncoder, lambda: OneHotEncoder(sparse=True), lambda: OrderedLabelEncoder(["b", "a", None])])
def test_unseen_values_are_noted(spark, make):
    t = make()
    t.fit(spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "k long, x string"), "x", "k")
    watch = Watch()
    data = spark.createDataFrame([(k, v) for k, v in enumerate(["a", "q", None, "q", "z" * 500, "b"])], "k long, x string")
    save(t.transform(data, watch=watch))
    assert watch.reports["x"].rows == 3
    assert watch.reports["x"].examples == ["q", "z" * 200]
    with pytest.warns(UserWarning, match="not seen"):
        watch.warn()


def test_an_unseen_null(spark):
    t, watch = LabelEncoder(), Watch()
    t.fit(spark.createDataFrame([(0, "a")], "k long, x string"), "x", "k")
    save(t.transform(spark.createDataFrame([(0, "a"), (1, None)], "k long, x string"), watch=watch))
    assert (watch.reports["x"].rows, watch.reports["x"].examples) == (1, [None])


def test_nulls_that_are_left_missing_are_none(spark):
    t, watch = LabelEncoder(missing_value_encoding=None), Watch()
    t.fit(spark.createDataFrame([(0, "a")], "k long, x string"), "x", "k")
    save(t.transform(spark.createDataFrame([(0, "a"), (1, None)], "k long, x string"), watch=watch))
    assert watch.reports == {}


def test_watching_needs_no_job_of_its_own(spark):
    plan = HyperTransformer("k")
    data = spark.range(3000).selectExpr("id AS k", "'c' || id AS x", "id % 3 AS y", "id * 0.5 AS z")
    plan.set_config({"sdtypes": {"k": "id", "x": "categorical", "y": "categorical", "z": "numerical"}, "transformers": {"k": None, "x": LabelEncoder(), "y": OneHotEncoder(), "z": None}})
    plan.fit(data.where("k < 2500 AND y < 2"))
    watch = Watch()
    plain = jobs(spark, "plain", lambda: save(plan.transform(data)))
    watched = jobs(spark, "watched", lambda: save(plan.transform(data, watch)))
    assert watched == plain
    assert (watch.reports["x"].rows, watch.reports["y"].rows) == (3000 - 1667, 1000)
    assert len(watch.reports["x"].examples) == 5
    assert watch.reports["y"].examples == [2]


def test_watched_results_are_the_same(spark):
    data = spark.range(100).selectExpr("id AS k", "id % 7 AS x")
    first, second = UniformEncoder(), UniformEncoder()
    for t in (first, second):
        t.fit(data.where("x < 5"), "x", "k")
    a, b = first.transform(data).orderBy("k").collect(), second.transform(data, watch=Watch()).orderBy("k").collect()
    assert a == b


@pytest.mark.parametrize(
    ("operator", "values", "told"),
    [
        (LogScaler(), [1.0, -1.0, -2.0, 3.0, 0.0], r"\[-2.0, -1.0, 0.0\] \(3 rows\)"),
        (LogScaler(constant=2.0, invert=True), [1.0, 5.0], r"\[5.0\] \(1 rows\)"),
        (LogitScaler(), [0.5, 1.5, -3.0, None], r"\[-3.0, 1.5\] \(2 rows\)"),
    ],
)
def test_errors_of_bounds_have_examples(spark, operator, values, told):
    df = spark.createDataFrame(list(enumerate(values)), "k long, x double")
    with pytest.raises(InvalidDataError, match=told):
        operator.fit(df, "x", "k")


def test_errors_of_bounds_have_five_examples_at_most(spark):
    df = spark.range(1000).selectExpr("id AS k", "CAST(id AS double) AS x")
    with pytest.raises(InvalidDataError, match=r"such as \[[^,]*(, [^,]*){4}\] \(998 rows\)"):
        LogitScaler().fit(df, "x", "k")


def test_a_fill_beyond_the_constant_is_an_error_without_examples(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None)], "k long, x double")
    with pytest.raises(InvalidDataError, match="logarithm$"):
        LogScaler(missing_value_replacement=-1.0).fit(df, "x", "k")


def sparse(spark, values):
    t = OneHotEncoder(sparse=True)
    df = spark.createDataFrame(list(enumerate(values)), "k long, x string")
    return t, t.fit_transform(df, "x", "k")


def test_sparse_indicators(spark):
    t, made = sparse(spark, ["oak", None, "elm", "elm", "fir"])
    got = [(r.x["size"], r.x.indices, r.x["values"]) for r in made.orderBy("k").collect()]
    assert got == [(4, [k], [1.0]) for k in (0, 3, 1, 1, 2)]
    assert [r.x for r in t.reverse_transform(made).orderBy("k").collect()] == ["oak", None, "elm", "elm", "fir"]
    unseen = t.transform(spark.createDataFrame([(0, "yew")], "k long, x string")).first().x
    assert (unseen.indices, unseen["values"]) == ([], [])
    assert t.get_output_sdtypes() == {"x": "vector"}


@pytest.mark.parametrize(
    ("indices", "values", "expected"),
    [
        ([1, 2], [0.5, 0.75], "fir"),
        ([2, 1], [0.5, 0.5], "elm"),
        ([], [], "oak"),
        ([0], [-1.0], "elm"),
        ([0, 1, 2], [-3.0, -1.0, -2.0], "elm"),
        ([2], [0.0], "oak"),
        ([1], [math.nan], "oak"),
        ([1, 2], [None, 0.1], "fir"),
        ([9, 1], [5.0, 0.1], "elm"),
        (None, None, None),
    ],
)
def test_the_largest_number_tells_the_category(spark, indices, values, expected):
    t, _ = sparse(spark, ["oak", "elm", "fir"])
    vector = None if indices is None else (3, indices, values)
    made = spark.createDataFrame([(0, vector)], "k long, x struct<size: int, indices: array<int>, values: array<double>>")
    assert t.reverse_transform(made).first().x == expected


def test_sparse_indicators_of_a_hundred_thousand_categories(spark, tmp_path):
    df = spark.range(100_000).selectExpr("id AS k", "'c' || id AS x")
    t = OneHotEncoder(sparse=True)
    made = t.fit_transform(df, "x", "k")
    assert made.agg(F.count_distinct(F.col("x.indices")[0]), F.max("x.size")).first() == (100_000, 100_000)
    assert t.reverse_transform(made).join(df.withColumnRenamed("x", "y"), "k").where("x = y").count() == 100_000


def test_sparse_indicators_of_no_rows(spark):
    t = OneHotEncoder(sparse=True)
    made = t.fit_transform(spark.createDataFrame([], "k long, x string"), "x", "k")
    assert t.reverse_transform(made).collect() == []
