"""Hard negatives against all scores in Python's integers, over blocks and chunks of several sizes."""

import random

import pytest

from tessella.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def table(seed: int, n: int = 180, dims: int = 7, repeats: bool = True):
    """Vectors of few distinct values, so that scores tie; some rows repeat."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 0.25, 0.5, 0.7, 1.0]) for _ in range(dims)], rng.choice([0, 0, 0, 1, 2])) for i in range(n)]
    return rows + ([rows[i] for i in range(0, n, 9)] if repeats else [])


def mined(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, "id % 5 = 0", **kwargs).collect())


def expected(rows, **kwargs):
    return sorted(hard_negatives.mine_by_brute_force([(i, c, v) for i, v, c in rows], {i for i, _, _ in rows if i % 5 == 0}, **kwargs))


@pytest.mark.parametrize("sizes", [{}, {"anchor_block": 16, "row_block": 32, "dim_chunk": 3}, {"anchor_block": 7, "row_block": 50, "dim_chunk": 1}])
def test_against_all_scores(spark, sizes):
    rows = table(1)
    assert mined(spark, rows, **sizes) == expected(rows)


def test_other_windows(spark):
    rows = table(2, repeats=False)
    how = {"positives": 3, "negatives": 7, "low_percent": 20, "high_percent": 110}
    assert mined(spark, rows, row_block=64, **how) == expected(rows, **how)


@pytest.mark.parametrize("scale", [3.0e6, 2.0e8])
def test_large_and_negative_components(spark, scale):
    """Products beyond a double's integers, scores beyond what shares a key with a place, scores of both signs."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(9)], i % 3) for i in range(120)]
    assert mined(spark, rows, scale=scale, row_block=50, dim_chunk=4) == expected(rows, scale=scale)
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(0, [1e300, 1.0], 1), (1, [1.0, 2.0], 2)])


def test_odd_inputs(spark):
    inf, nan = float("inf"), float("nan")
    good = [(0, [1.0, 0.5], 1), (5, [0.9, 0.5], 1), (1, [0.6, 0.4], 2), (2, [0.5], 3), (3, [], 4), (10, [-1.0, -1.0], 7)]
    bad = [(15, None, 1), (20, [1.0, None], 1), (25, [inf, 1.0], 1), (30, [nan, 1.0], 1), (35, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 3) for r in good + bad], SCHEMA + ", number string, block int")
    made = hard_negatives.mine(df, "id % 5 = 0")
    assert made.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in made.collect()) == expected(good)
    assert hard_negatives.mine(df.limit(0), "id % 5 = 0").collect() == []
    assert hard_negatives.mine(df, "id = 77").collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], SCHEMA)
    assert hard_negatives.mine(alone, "id % 5 = 0").collect() == []


def test_op12_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    made = queries.op12_hard_negatives(spark, sf)
    assert {f.name: f.dataType.simpleString() for f in made.schema} == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    got = sorted(tuple(r) for r in made.collect())
    assert got == sorted(hard_negatives.mine_by_brute_force(rows, {i for i, _, _ in rows if i % 50 == 0}))
    assert len(got) > 20
