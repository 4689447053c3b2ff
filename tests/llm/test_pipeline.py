"""The pipeline's stages against plain computations, each on what the stage before kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import near_dedup, substring_dedup


@pytest.fixture(scope="module")
def kept(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(out[-1], docs.schema)
        made = stage(spark, docs, sf_dir)
        out.append(made.collect())
        docs = made
    return out


def test_the_stages_come_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "substring dedup", "packing"]


def test_quality_keeps_clean_documents(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    stay = {r.doc_id for r in kept[1]}
    good = [d for d, q in labels.items() if q == 1]
    low = [d for d, q in labels.items() if q == 0]
    assert sum(d in stay for d in good) >= 0.98 * len(good)
    assert sum(d in stay for d in low) <= 0.2 * len(low)
    assert {r.doc_id: r.text for r in kept[1]}.items() <= {r.doc_id: r.text for r in kept[0]}.items()


def test_one_of_each_group_stays(kept):
    expected = near_dedup.components_by_brute_force([(r.doc_id, r.text) for r in kept[1]], 5, 80)
    assert sorted(r.doc_id for r in kept[2]) == sorted(d for d, (_, c) in expected.items() if d == c)


def test_repeats_are_cut_out(kept):
    import hashlib

    expected = {d: (n, s) for d, _, n, s in substring_dedup.removed_by_brute_force([(r.doc_id, r.text) for r in kept[2]])}
    before = {r.doc_id: r.text for r in kept[2]}
    for r in kept[3]:
        removed, digest = expected[r.doc_id]
        assert hashlib.sha256(" ".join((r.text or "").split()).encode()).hexdigest() == digest if removed else r.text == before[r.doc_id]
    assert len(kept[3]) == len(kept[2])


def test_all_tokens_are_packed(kept):
    assert {r.doc_id for r in kept[4]} == {r.doc_id for r in kept[3]}
    assert all(sum(r.length for r in own) == own[0].doc_tokens for own in ([r for r in kept[4] if r.doc_id == d] for d in {r.doc_id for r in kept[4]}))


def odd_documents(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [
        (1, " ".join(words), "en", "a"),
        (2, " ".join(words[:399] + ["other"]), "en", "a"),
        (3, " ".join(["x"] + words[100:200] + [f"y{i}" for i in range(300)]), "de", "b"),
        (4, None, None, None),
        (5, "", "en", "a"),
        (6, " " * 1_000_000 + "end", "en", "a"),
        (7, "again and again", "en", "c"),
        (7, "again and again", "en", "c"),
        (None, "a text without an id", "en", "c"),
    ]
    return spark.createDataFrame([(d, t, g, s, len(t or ""), "own") for d, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long, _doc string")


def test_run_over_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), docs.schema)
        sizes.append(sorted(r.doc_id or 0 for r in now.collect()))
    assert sizes == [[0, 1, 2, 3, 4, 5, 6, 7, 7], [0, 1, 3, 4, 5, 6, 7, 7], [0, 1, 3, 4, 5, 6, 7, 7]]
    kept = {r.doc_id: r for r in now.collect()}
    assert kept[3].text == " ".join(["x"] + [f"y{i}" for i in range(300)])
    assert kept[3].n_chars == len(kept[3].text)
    assert {r._doc for r in kept.values()} == {"own"}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in pieces if r.doc_id == 6) == 1_000_001
    assert {r.doc_id for r in pieces} == {None, 1, 3, 4, 5, 6, 7}


def test_run_over_no_documents(spark, tmp_path):
    odd_documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_packed_ids_are_those_of_the_kept_texts(kept):
    import zlib

    from tessella.llm import packing, queries

    library = packing.encoder(queries.tokenizer("byte_bpe_50k.json")).tokenizer
    texts = {r.doc_id: r.text for r in kept[3]}
    for r in kept[4]:
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_documents_keep_columns_that_are_named_like_the_operators(spark):
    names = ["n_words", "n_removed", "kept_text", "_copy", "_spots", "_key", "_doc", "_row"]
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(d, text, len(text), *[f"{n} {d}" for n in names]) for d in (1, 2)], "doc_id long, text string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    made = corpus_pipeline.without_repeats(spark, docs, None)
    assert made.columns == docs.columns
    rows = made.orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in rows] == [(text, len(text)), ("", 0)]
    assert [[r[n] for n in names] for r in rows] == [[f"{n} {d}" for n in names] for d in (1, 2)]


def test_band_keys_are_shuffled_once_and_buckets_of_the_same_nodes_are_one(spark, monkeypatch):
    """Copies that differ in a word share many bands: they meet in a few buckets, and each key goes through one exchange."""
    text = [f"w{i}" for i in range(300)]
    rows = [(d, " ".join(text[:150] + ([f"x{d}"] if d else []) + text[150:])) for d in range(6)] + [(9, "something else that nobody has")]
    seen, own = [], near_dedup.cut

    def watched(df):
        if df.columns == ["bucket", "node", "pivot"]:
            seen.append((df, df._jdf.queryExecution().optimizedPlan().toString()))
        return own(df)

    monkeypatch.setattr(near_dedup, "cut", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.keep_one(docs).collect()}
    assert kept == {0, 9}
    [(members, plan)] = seen
    assert plan.count("Generate explode") == 1 and "Join" not in plan
    named = [r.nodes for r in members.groupBy("bucket").agg(F.sort_array(F.collect_set("node")).alias("nodes")).collect()]
    assert named and len(named) == len({tuple(x) for x in named})
