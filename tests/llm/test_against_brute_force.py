"""Each operator's query over the smallest tables, against a plain computation of the same."""

import hashlib
import io
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, media, near_dedup, queries, substring_dedup


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_op1_minhash(spark, sf_dir, documents):
    expected = near_dedup.components_by_brute_force(documents, 3, 85)
    got = rows(queries.op1_minhash(spark, sf_dir))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == expected
    assert all(r.kept == (r.component_id == d) for d, r in got.items())


def test_op1_at_five_words_and_more_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    expected = near_dedup.components_by_brute_force([tuple(r) for r in docs.collect()], 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == expected


def test_op2_bpe(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    got = rows(queries.op2_bpe(spark, sf_dir))
    for d, text in documents:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op4_media(spark, sf_dir, documents):
    got = rows(queries.op4_media(spark, sf_dir))
    for d, text in documents:
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44
        stored = media.wav_header(len(payload)) + payload
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest()
        with wave.open(io.BytesIO(stored)) as w:  # another reader finds the same samples
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
        changes = sum(a != b for a, b in zip(payload, payload[1:]))
        assert r.feature == f"audio/wav;samples={len(payload)};sum={sum(payload)};peak={max(payload)};changes={changes}"


def test_op5_substring_dedup(spark, sf_dir, documents):
    got = sorted(tuple(r) for r in queries.op5_substring_dedup(spark, sf_dir).collect())
    assert got == sorted(substring_dedup.removed_by_brute_force(documents))
    assert any(r[2] for r in got)


def test_op6_quality_on_held_out_labels(spark, sf_dir):
    from tessella.llm import quality

    sf = "/root/testdata/sf0.01"
    labels, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "documents"))
    judged = quality.judge(docs, labels.where("doc_id % 2 = 0"), *queries.sites(docs)).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    low, good = ([r.rejected for r in judged if r.quality == q] for q in (0, 1))
    print("rejected of low and of good", sum(low) / len(low), sum(good) / len(good))
    assert sum(low) / len(low) > 0.9
    assert sum(good) / len(good) < 0.02
    assert queries.op6_quality(spark, sf_dir).count() == 200


def test_op7_ann_recall_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    vectors = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    asked = [v for v, _ in vectors if v % 100 == 0]
    exact = ann.nearest_by_brute_force(vectors, asked, 10)
    got = {}
    for r in queries.op7_ann(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == sorted(asked)
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in exact[q]}) for q in asked) >= 0.9 * 10 * len(asked)
    table = dict(vectors)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
        for v, score in found:
            assert score == pytest.approx(np.linalg.norm(np.array(table[q]) - np.array(table[v])), rel=1e-12)


def test_op7_graph_recall_in_a_larger_shard():
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(3000, 32)) + 2 * rng.normal(size=(20, 32))[rng.integers(0, 20, 3000)]).astype(np.float32)
    edges, entry = ann.build_graph(vectors)
    points = vectors[::30]
    exact = np.argsort(((points[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2), axis=1)[:, :10]
    found, _ = ann.beam_search(vectors, edges, entry, points, ann.SEARCH_BEAM)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(exact, found[:, :10], strict=True)]) / 10 >= 0.95


def test_op7_recall_over_several_full_shards(spark):
    """Over 40,000 clustered vectors in full shards: each query asks some of the shards only."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(300, 32))
    vectors = centers[rng.integers(0, 300, 45_000)] + 0.35 * rng.normal(size=(45_000, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in ann.nearest(df, "vec_id % 300 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 150
    assert all(len(v) == 10 for v in got.values())
    exact = {q: {int(i) for i in np.argsort(((vectors - vectors[q]) ** 2).sum(axis=1))[1:11]} for q in got}
    assert np.mean([len(got[q] & exact[q]) for q in got]) >= 9.0

    usable = ann._usable(df, "vec_id", "embedding").withColumn("least", F.col("vec_id")).select("h0", "h1", "dim", "vector", "least")
    centroids = ann.fit_centroids(usable, ann.SHARD_ROWS)
    placed = ann.with_cell(usable, centroids)
    probes = ann.measured_probes(placed, usable, centroids, 10)
    assert probes[32] <= len(centroids[32]) // 2
    assert ann.with_probes(usable.limit(10), centroids, probes).count() == 10 * probes[32]


def test_op9_packing(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    pieces, sequences = {}, {}
    for r in queries.op9_packing(spark, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(pieces) == sorted(d for d, _ in documents)
    for d, text in documents:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for own in sequences.values() for r in own) / (2048 * len(sequences)) > 0.97


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = c.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(x)] for x in columns) for r in cursor.fetchall()), key=repr)
