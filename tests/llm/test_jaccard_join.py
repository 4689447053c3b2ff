"""The set similarity join against all pairs, at several thresholds and costs, and its keys alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import clusters, jaccard_join, near_dedup, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def classes(df, *args, **kwargs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_classes(df, *args, **kwargs).collect()}


def test_op13(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op13_jaccard_join(spark, SF).collect()}
    assert got == near_dedup.components_by_brute_force(documents, 3, 90)
    assert any(d != c for d, (_, c) in got.items())


def near_copies(seed: int) -> list[tuple[int, str]]:
    """Families of short and middling texts, each a few words off another, and texts that share a passage only."""
    rng, out = random.Random(seed), []
    common = " ".join(f"c{i}" for i in range(14))
    for family in range(25):
        words = [f"f{family}w{i}" for i in range(rng.choice([1, 2, 5, 9, 10, 11, 12, 19, 20, 21, 40, 75, 160]))]
        for _ in range(8):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(own))
    out += [f"{common} tail{i // 2} {i % 2}" for i in range(60)] + [f"one{i}" for i in range(40)] + ["", "  "]
    return list(enumerate(out))


@pytest.mark.parametrize(("words", "percent", "most_shared"), [(1, 90, 256), (1, 90, 1), (3, 80, 1), (1, 60, 2), (2, 85, 1), (1, 100, 1)])
def test_against_all_pairs(spark, words, percent, most_shared):
    """A small bound makes nearly all shared segments skipped, so links come by deletion keys."""
    texts = near_copies(words * percent)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert classes(df, words, percent, most_shared=most_shared) == near_dedup.components_by_brute_force(texts, words, percent)


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_share_a_key(percent):
    """Of sets at the threshold, each pair that links agrees in a segment of a block that differs in one at most."""
    rng, partition = np.random.default_rng(percent), jaccard_join.Partition(percent)
    for n in [*range(1, 60), 200, 1500]:
        a = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for gone in range(n):
            for added in {0, gone}:
                b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, added).astype(np.uint64)]))
                both = n - gone
                if 100 * both < percent * (len(a) + len(b) - both):
                    continue
                agree = 0
                for above_a in (0, 1):
                    for above_b in (0, 1):
                        one, two = (partition.segments(x, np.array([0, len(x)]), y) for x, y in ((a, above_a), (b, above_b)))
                        if len(one[2]) == len(two[2]) and (one[3] == two[3]).all():
                            same = (one[2] == two[2]).reshape(-1, 2)
                            agree += same.any()
                assert agree or (gone == 0 and added == 0), (n, gone, added)
            if gone > 400:
                break


def test_odd_inputs(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (4, "one two"), (5, "one two"), (None, "one two"), (6, long), (7, long + " tail"), (7, "another text of the same id"), (8, "naïve  café ﬁne\x00 end \U0001f600")]
    df = spark.createDataFrame([(d, t, "n", 1, [2], True) for d, t in rows], "doc_id long, text string, node string, bucket int, keys array<int>, shared boolean")
    made = jaccard_join.similarity_classes(df)
    assert made.columns == ["doc_id", "n_shingles", "component_id"]
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(rows)
    assert {r[0]: r[2] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, None: None, 6: 6, 7: 6, 8: 8}
    assert {r[1] for r in got if r[0] in (1, 2, 3)} == {0}
    assert jaccard_join.similarity_classes(df.limit(0)).count() == 0


def test_keys_without_a_whole_part_link_nothing(spark):
    """Parts that differ in one shingle are a whole one and one without a shingle; two that both lack one differ in two."""
    spread = spark.createDataFrame([(1, 10, True), (1, 11, False), (2, 10, False), (2, 11, False), (3, 12, True), (4, 10, True), (4, 11, True)], "bucket long, node long, whole boolean")
    assert sorted((r.node, r.pivot) for r in clusters.members_of(spread, "whole").collect()) == [(10, 10), (11, 10)]  # buckets 1 and 4 have the same nodes
    assert clusters.members_of(spread.where("bucket = 2"), "whole").count() == 0
    assert clusters.members_of(spread.where("bucket = 2")).count() == 2


def test_only_texts_that_skip_segments_are_shuffled(spark, monkeypatch):
    """Of 5000 texts 3 skip a segment; the rows that go through the shuffle are these, whatever their arrays' size."""
    texts = spark.range(5000).select(F.col("id").alias("node"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    skipped = spark.createDataFrame([(d, [d, d + 1]) for d in (7, 70, 700)], "node long, skipped array<long>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = jaccard_join._with_skipped(texts, skipped)
        assert sorted(tuple(r) for r in made.collect()) == [(d, f"text {d}", [d, d + 1]) for d in (7, 70, 700)]
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan
        monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 2)
        many = jaccard_join._with_skipped(texts, skipped)
        assert "LeftSemi" not in many._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(tuple(r) for r in many.collect()) == sorted(tuple(r) for r in made.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
