"""Distinct values by sketches, and rows told by their files."""

import pytest

from tessella import HyperTransformer, TransformerInputError
from tessella.functions.sketches import ERROR, distinct_counts, sketch, union
from tessella.operators.base import FILE_ROWS
from tessella.operators.categorical import LabelEncoder, UniformEncoder
from tessella.operators.ids import RegexGenerator
from tessella.operators.pii import AnonymizedFaker
from tessella.streaming.fit import fit_batches


def test_counts_within_their_error(spark):
    df = spark.range(200_000).selectExpr("id", "id % 1000 AS few", "CAST(NULL AS string) AS none", "if(id % 2 = 0, 0.0D, -0.0D) AS zero", "CAST(CAST(id % 77 AS string) AS binary) AS bytes", "id % 50 + if(id % 3 = 0, NULL, 0) AS holes")
    about, exact = distinct_counts(df), distinct_counts(df, exact=True)
    assert exact == {"id": 200_000, "few": 1000, "none": 0, "zero": 1, "bytes": 77, "holes": 50}
    for c, n in exact.items():
        assert abs(about[c] - n) <= 4 * ERROR * n
    assert distinct_counts(df, ["few"]).keys() == {"few"}
    assert distinct_counts(df.limit(0)) == dict.fromkeys(df.columns, 0)


def test_merged_sketches_count_the_whole(spark):
    df = spark.range(60_000)
    parts = [bytes(df.where(f"id % 3 <> {k}").agg(sketch(df.id, df.schema["id"].dataType).alias("s")).first().s) for k in range(3)]
    _, n = union(parts)
    assert abs(n - 60_000) <= 4 * ERROR * 60_000


@pytest.mark.parametrize("make", [lambda d: RegexGenerator("[a-z]{3}", cardinality_rule="match", distinct=d), lambda d: AnonymizedFaker("person", "name", cardinality_rule="match", distinct=d)])
def test_match_by_either_way(spark, make):
    df = spark.range(500).selectExpr("id AS k", "if(id % 20 = 0, NULL, id % 20) AS x")
    exact, about = make("exact"), make("sketch")
    for t in (exact, about):
        t.fit(df, "x", "k")
    assert exact.n_distinct == about.n_distinct
    rows = spark.range(500).selectExpr("id AS k")
    assert sorted(map(str, exact.reverse_transform(rows).collect())) == sorted(map(str, about.reverse_transform(rows).collect()))


def test_distinct_is_one_of_two(spark):
    with pytest.raises(TransformerInputError, match="distinct"):
        RegexGenerator(cardinality_rule="match", distinct="some")


def test_match_over_batches(spark, tmp_path):
    def make():
        plan = HyperTransformer("k")
        plan.set_config({"sdtypes": {"k": "id", "x": "id"}, "transformers": {"k": None, "x": RegexGenerator("[a-z]{3}", cardinality_rule="match", distinct="sketch")}})
        return plan

    df = spark.range(900).selectExpr("id AS k", "'v' || id % 30 AS x")
    plan = fit_batches(make, str(tmp_path), [df.where("k < 100"), df.where("k >= 100 AND k < 100"), df.where("k >= 100")], spark)
    assert plan.field_transformers["x"].n_distinct == 30


@pytest.fixture
def stored(spark, tmp_path):
    """Values that first appear in the order e, d, c, b, a over the files' rows."""
    rows = spark.range(1000).selectExpr("id AS n", "substr('edcba', CAST(id / 200 AS INT) + 1, 1) AS x")
    rows.coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/rows")
    return spark.read.parquet(f"{tmp_path}/rows")


def drawn(t, df):
    return sorted((r.n, r.x) for r in t.transform(df).collect())


def test_file_rows_hold_over_partitionings(spark, stored):
    results = []
    for df in (stored, stored.repartition(7), stored.orderBy("x"), stored.where("n >= 0").repartition(3, "x")):
        t = UniformEncoder()
        t.fit(df, "x", FILE_ROWS)
        assert list(t.intervals) == ["e", "d", "c", "b", "a"]
        results.append(drawn(t, df.select("x", "n")))
    assert all(r == results[0] for r in results)
    assert len({u for _, u in results[0]}) > 990


def test_file_rows_in_a_plan(spark, stored):
    made = []
    for df in (stored, stored.repartition(5)):
        plan = HyperTransformer(FILE_ROWS)
        plan.set_config({"sdtypes": {"n": "numerical", "x": "categorical"}, "transformers": {"n": None, "x": UniformEncoder()}})
        plan.fit(df)
        made.append(sorted(map(tuple, plan.transform(df).collect())))
    assert made[0] == made[1]


def test_rows_of_no_file_are_warned_of(spark):
    df = spark.range(4).selectExpr("id AS n", "'a' AS x")
    t = LabelEncoder()
    with pytest.warns(UserWarning, match="Parquet files"):
        t.fit(df, "x", FILE_ROWS)
    with pytest.warns(UserWarning, match="Parquet files"):
        assert t.transform(df).count() == 4


def test_a_column_of_that_name_is_a_column(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "x string, _metadata long")
    t = LabelEncoder()
    t.fit(df, "x", "_metadata")
    assert t.categories_to_values == {"a": 0, "b": 1}
