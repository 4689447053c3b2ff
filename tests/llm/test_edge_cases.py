"""Nulls, empty and long texts, repeated rows, empty tables, and columns with names of the operators' own."""

import gzip
import io
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, bpe, chat_formatting, media, near_dedup, packing, quality, queries, substring_dedup, url_filters, warc

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, kept boolean, node string, hash string, words long"
ROWS = [
    (1, None, "en", "a", True, "n", "h", 1),
    (2, "", "en", "a", None, None, None, None),
    (3, " \t\n ", None, None, False, "n", "h", 2),
    (4, "one two", "en", "a", True, "n", "h", 3),
    (4, "one two", "en", "a", True, "n", "h", 3),
    (5, "one two", "de", "b", True, "n", "h", 3),
    (None, "one two", "de", "b", True, "n", "h", 3),
    (6, LONG, "de", "b", True, "n", "h", 3),
    (7, LONG + " tail", "de", "b", True, "n", "h", 3),
    (7, "another text of the same id", "de", "b", True, "n", "h", 3),
    (8, "naïve  café ﬁne\x00 end \U0001f600", "fr", "c", True, "n", "h", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(docs, none):
    got = [tuple(r) for r in near_dedup.near_duplicates(docs).collect()]
    assert len(got) == len(ROWS)
    by = {r[0]: r[2] for r in got}
    assert by == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, None: None, 6: 6, 7: 6, 8: 8}
    assert {r[1] for r in got if r[0] in (1, 2, 3)} == {0}
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.keep_one(docs)
    assert set(kept.columns) == set(docs.columns)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 8]


def test_chains_of_near_copies_are_one_component(spark):
    base = [f"t{i}" for i in range(200)]
    texts = [(100 - k, " ".join([f"e{i}" for i in range(5 * k)] + base[5 * k :])) for k in range(12)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    expected = near_dedup.components_by_brute_force(texts, 5, 80)
    assert len({c for _, c in expected.values()}) == 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()} == expected


def test_groups_that_share_buckets_but_not_links(spark):
    """Many texts just below the threshold, some pairs of which link: the rounds find them all."""
    common = [f"c{i}" for i in range(150)]
    texts = [(i, " ".join(common + [f"own{i // 2}_{j}" for j in range(45)] + [f"z{i}"])) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 3, 85).collect()} == {d: c for d, (_, c) in near_dedup.components_by_brute_force(texts, 3, 85).items()}


def test_bpe(docs, none):
    path = queries.tokenizer("word_bpe_49k.json")
    made = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("old")), path), path)
    assert made.count() == len(ROWS)
    assert {r.decoded for r in made.where("doc_id IN (1, 2, 3)").collect()} == {""}
    assert bpe.encode(none, path).count() == 0
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    odd = ["don't", "ΑΣ ΣΑΣ", "İstanbul", "a\x1fb", "<|endoftext|>x", "x<|startoftext|>", "ﬁ ② ½", "é́", "12345", " x　y", "!!!???", "Ǆ ß", "a" * 3000, "ab" * 700_000, "".join(chr(97 + i * i % 26) for i in range(1_000_000)), "!" * 1_000_000, " " * 1_000_000 + "x", "word " * 500_000]
    assert [list(memoryview(b).cast("i")) for b in bpe.encoder(path).encode(odd)] == [t.encode(x, add_special_tokens=False).ids for x in odd]
    df = docs.sparkSession.createDataFrame([(1, [0, None, 99999999, 5]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(df, path).collect()} == {1: t.decode([0]) + " " + t.decode([5]), 2: ""}


def test_packing_of_odd_texts(docs, none):
    path = queries.tokenizer("byte_bpe_50k.json")
    made = packing.pack(docs, path, 1).collect()
    assert sum(len(r.ids) // 4 for r in made if r.doc_id == 1) == 1
    assert {r.doc_id for r in made} == {r[0] for r in ROWS}
    assert packing.pack(none, path, 1).count() == 0
    odd = ["", " ", "a\nb", "\n\n x", "don't 's", "<|endoftext|> x", "a b", "x\r\ny", "é́ ß", "a" * 3000]
    own = packing.encoder(path)
    for by_word in (set(), set(range(len(odd)))):
        assert [list(memoryview(b).cast("I")) for b in own.encode(odd, by_word)] == [e.ids for e in own.tokenizer.encode_batch(odd, add_special_tokens=False)]


@pytest.mark.parametrize("n", [1_000_000, 5_000_000])
def test_packing_of_long_runs(spark, n):
    path = queries.tokenizer("byte_bpe_50k.json")
    letters = "".join(chr(97 + i * i * 7 % 26) for i in range(n))
    texts = [" " * n, " " * n + "x", "a  b\n" + "\n" * n + "b\n\nc", letters, "it's" + "!" * n + "<|endoftext|> end\x1c\x85\xa0 it'll" + "\xe9" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    pieces = {}
    for r in packing.pack(df, path, 1).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    library = packing.encoder(path).tokenizer
    for d, text in enumerate(texts):
        ids = np.frombuffer(b"".join(x for _, x in sorted(pieces[d])), "<u4")
        assert np.array_equal(ids, np.array([*library.encode(text, add_special_tokens=False).ids, 1]))


@pytest.mark.parametrize("n", [1_000_000, 5_000_000])
def test_packing_of_mixed_white_space(n):
    """Each pair of white-space characters in turn, so that no run of one kind is long; with and without a word after it."""
    own = packing.encoder(queries.tokenizer("byte_bpe_50k.json"))
    wide = [int(c).to_bytes(3 if c > 0xFFFF else 2).decode() for c in packing.WIDE_SPACES]
    pairs = [a + b for a in " \t\n\r" for b in wide] + [a + b for a, b in zip(wide, wide[1:] + wide[:1], strict=True)]
    for pair in pairs if n == 1_000_000 else pairs[::29]:
        text = pair * (n if pair in pairs[:2] else n // 100)
        for t in (text, f"it's{text}word"):
            data = np.frombuffer(t.encode(), np.uint8)
            long = packing.long_runs(data, np.array([0, len(data)]))
            assert long == {0}
            assert list(memoryview(own.encode([t], long)[0]).cast("I")) == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_substring_dedup(spark, docs, none):
    made = substring_dedup.remove_repeats(docs)
    assert made.columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    got = {(r.doc_id, r.n_words): r.n_removed for r in made.collect()}
    assert got[(7, 60_001)] == 60_000
    assert got[(6, 60_000)] == 0
    assert made.count() == len(ROWS)
    assert substring_dedup.remove_repeats(none).count() == 0
    words = [f"w{i}" for i in range(300)]
    texts = [(1, " ".join(words)), (2, " ".join(words[40:89])), (3, " ".join(["x", *words[40:90], "y"])), (4, " ".join(words[:60] + ["q"] + words[100:170])), (5, " ".join(words[:60] * 2)), (6, " ".join(words))]
    got = sorted(tuple(r) for r in substring_dedup.kept_digest(substring_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"))).collect())
    assert got == sorted(substring_dedup.removed_by_brute_force(texts))


def test_difference_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (6, 1), (None, 0)], "doc_id long, quality int")
    site = F.col("source"), F.col("lang")
    made = quality.judge(docs, labels, *site)
    assert made.count() == len(ROWS)
    assert all(0 <= r.low_quality <= 1 for r in made.collect())
    assert quality.judge(none, labels, *site).count() == 0
    clashing = docs.withColumns({c: F.lit("own") for c in ("host", "path", "evidence", "_text", "_row", "_id", "_n", "low_quality", "label")})
    kept = quality.keep_good(clashing, labels.limit(0), *site)
    assert kept.columns == clashing.columns
    assert kept.count() == len(ROWS)
    assert {r.evidence for r in kept.collect()} == {"own"}
    assert quality.judge(clashing, labels, *site).count() == len(ROWS)


def test_quality_of_a_very_long_text(spark):
    texts = [(1, "word " * 400_000), (2, "x" * 1_000_000), (3, "\n" * 1_000_000)]
    docs = spark.createDataFrame([(d, t, "s", "l") for d, t in texts], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    assert quality.judge(docs, labels, F.col("source"), F.col("lang")).count() == 3


def test_rates_and_posteriors_against_sums_over_all_other_rows(spark):
    rows = [("bad", "p", 6.0)] * 40 + [("good", "p", -6.0)] * 40 + [("mixed", "p", 6.0)] * 15 + [("mixed", "q", -6.0)] * 15 + [("mixed", "r", 1.0)]
    rows += [("alone", "p", 2.0), ("new", "p", 0.0), (None, None, 1.5), (None, "p", -1.0), ("two", "p", 3.0), ("two", None, -3.0)]
    scored = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, host string, path string, evidence double")
    rates = quality.site_rates(scored, 0.3)
    found = sorted((r.i, r.host_rate, r.path_rate, r.low_quality) for r in quality.posteriors(scored, rates, 0.3).collect())
    expected = quality.posteriors_by_brute_force(rows, 0.3, rates.host_weight, rates.path_weight)
    assert [f[1:] for f in found] == [pytest.approx(e, abs=1e-9) for e in expected]
    # a site of one document has the corpus's rate, whatever the document's own evidence is
    alone = quality.posteriors(scored.where("host = 'alone'").withColumn("evidence", F.lit(2.0)), rates, 0.3).first()
    others = [1 / (1 + math.exp(-(e + math.log(0.3 / 0.7)))) for h, _, e in rows if h != "alone"]
    assert alone.path_rate == pytest.approx((sum(others) + 1) / (len(others) + 2), abs=1e-5)


def test_the_fit_takes_a_bounded_share_of_the_labels(spark):
    texts = spark.range(400).selectExpr("id AS _id", "IF(id % 2 = 0, 'good words here', 'BAD!!! | |') AS _text")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 = 0 AS INT) AS quality")
    model = quality.fit_documents(texts, labels, "doc_id", "quality", most=100)
    assert 0.2 < model.prior < 0.8
    assert model.weights.any()


def test_nearest_neighbours(spark):
    rows = [(0, [1.0, 0.0], "x"), (100, [1.0, 0.0], "x"), (3, [0.9, 0.1], "x"), (4, None, "x"), (5, [0.0, 0.0], "x"), (6, [float("nan"), 1.0], "x"), (7, [None, 1.0], "x"), (8, [float("inf"), 1.0], "x"), (None, [1.0, 1.0], "x"), (9, [1.0, 0.0, 0.0], "x"), (3, [0.9, 0.1], "x"), (10, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in ann.nearest(df, "vec_id % 100 = 0").orderBy("query_id", "rank").collect()]
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 100), (0, 2, 3), (100, 1, 0), (100, 2, 3)]
    assert got[0][3] == 0.0
    assert ann.nearest(df.limit(0), "vec_id % 100 = 0").count() == 0


@pytest.mark.parametrize(("n", "shard_rows"), [(30, 8192), (60, 20)])
def test_many_vectors_at_one_distance(spark, n, shard_rows):
    # shards that a search meets whole: which of the found ones stay is what counts here
    df = spark.range(n).selectExpr("id AS vec_id", f"transform(sequence(0, {n - 1}), i -> IF(i = id, 1.0D, 0.0D)) AS embedding")
    got = [(r.rank, r.vec_id) for r in ann.nearest(df, f"vec_id = {n - 1}", shard_rows=shard_rows, probes=0).orderBy("rank").collect()]
    assert got == [(i + 1, i) for i in range(10)]


def test_many_equal_vectors(spark):
    df = spark.range(3000).selectExpr("id AS vec_id", "CASE WHEN id % 3 = 0 THEN array(1.0D, 2.0D) ELSE array(sin(id), cos(id)) END AS embedding")
    got = {}
    for r in ann.nearest(df, "vec_id IN (0, 300, 1)", shard_rows=500).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [v for v, _ in got[0]] == [3 * i for i in range(1, 11)]
    assert [v for v, _ in got[300]] == [3 * i for i in range(10)]
    assert len(got[1]) == 10


PNG = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")))
GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def test_media(spark, none):
    packed = io.BytesIO()
    with gzip.GzipFile(fileobj=packed, mode="wb", mtime=0) as f:
        f.write(b"hello")
    zipped = packed.getvalue()
    rows = [("png", PNG, "image/jpeg"), ("gif", b"junk" + GIF + b"more" + zipped, None), ("wav", media.wav_header(4) + b"abcd", "audio/wav"), ("cut", PNG[:-3], "image/png"), ("none", None, "x"), ("empty", b"", None), ("bad", PNG[:20] + b"\xff" + PNG[21:], None)]
    df = spark.createDataFrame(rows, "name string, content binary, said string")
    got = {r.name: r for r in media.sniff(df, "content", "said").collect()}
    assert (got["png"].detected_type, got["png"].media_length, got["png"].corrected) == ("image/png", len(PNG), True)
    assert (got["wav"].detected_type, got["wav"].corrected) == ("audio/wav", False)
    assert [(p.type, p.offset, p.length) for p in got["gif"].embedded] == [("image/gif", 4, len(GIF)), ("application/gzip", 8 + len(GIF), len(zipped))]
    assert all(got[n].detected_type is None and got[n].embedded == [] for n in ("cut", "none", "empty", "bad"))
    carved = {r.carved_type: bytes(r.carved) for r in media.carve(media.sniff(df, "content", "said")).collect()}
    assert carved == {"image/gif": GIF, "application/gzip": zipped}
    assert media.store_samples(none).count() == 0


def test_warc(spark, tmp_path):
    big = "x" * 200
    rows = [(1, "http://a/ä b", big), (2, None, big), (3, "http://b", "short"), (4, "http://c", "short"), (5, "http://d", None), (None, "http://e", big), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(warc.mark_revisits(pages))
    back = warc.resolve_revisits(warc.record_lengths(warc.read_archives(archives)))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in back.collect())
    assert got == [(0, "response", None, 200), (1, "response", None, 200), (2, "revisit", 1, 200), (2, "revisit", 1, 200), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0)]
    assert warc.write_archives(warc.mark_revisits(pages.limit(0))).count() == 0
    warc.write_files(archives, f"file://{tmp_path}")
    assert warc.read_archives(warc.read_files(spark, f"file://{tmp_path}")).count() == len(rows)


def test_warc_dictionary_makes_archives_smaller(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = warc.write_archives(warc.mark_revisits(pages).coalesce(1)).first()
    first = next(warc.frames(memoryview(bytes(one.content))))
    assert struct.unpack_from("<I", first)[0] == warc.DICTIONARY_FRAME
    import zstandard

    own = [warc.record(r.page_id, r.url, bytes(r.payload), r.payload_digest, r.refers_to) for r in warc.mark_revisits(pages).collect()]
    assert len(one.content) < sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in own)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, None, None), (5, 0, "", None), (None, 0, "user", "hi"), (6, 0, "user", "x"), (6, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("own"))
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat_formatting.format_conversations(turns).collect()}
    assert got == {2: (2, 2), 4: (1, 1), 5: (1, 1), 6: (2, 1)}
    assert chat_formatting.format_conversations(turns.limit(0)).count() == 0


def test_archives_of_others(spark):
    import zstandard

    head = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: {}\r\nContent-Length: {}\r\nWARC-Payload-Digest: sha1:ABC\r\n\r\n"
    kinds = [("warcinfo", "application/warc-fields", b"software: x"), ("response", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\n" + b"body " * 9)]
    plain = [head.format(k, c, len(b)).encode() + b + b"\r\n\r\n" for k, c, b in kinds]
    words = zstandard.train_dictionary(2048, [bytes([i % 251]) * 40 + plain[i % 2] for i in range(400)])
    packed = zstandard.ZstdCompressor().compress(words.as_bytes())
    frames = []
    for p in plain:
        c = zstandard.ZstdCompressor(dict_data=words, write_content_size=False).compressobj()
        frames.append(c.compress(p) + c.flush())
    content = struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed + b"".join(frames)
    got = [tuple(r) for r in warc.read_archives(spark.createDataFrame([("a", content)], "archive_id string, content binary")).collect()]
    assert [(r[0], r[2], bytes(r[4])) for r in got] == [(None, "warcinfo", b"software: x"), (None, "response", b"body " * 9)]


def test_warc_of_a_very_long_page(spark):
    pages = spark.createDataFrame([(1, "http://a/" + "b" * 100_000, "z" * 5_000_000), (2, "", "z" * 5_000_000)], "page_id long, url string, html string")
    back = warc.resolve_revisits(warc.record_lengths(warc.read_archives(warc.write_archives(warc.mark_revisits(pages)))))
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in back.collect()) == [(1, "response", 5_000_000), (2, "revisit", 5_000_000)]


def test_stored_samples_of_odd_rows(spark, docs):
    clashing = docs.withColumns({c: F.lit("own") for c in ("media", "samples", "feature", "n_bytes", "detected_type")})
    made = media.read_samples(media.sniff(media.store_samples(clashing), "media"))
    rows = made.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, bytes(r.samples), r.detected_type) == (len(raw), payload, "audio/wav")
        assert bytes(r.media) == media.wav_header(len(payload)) + payload


def test_substring_dedup_keeps_columns_of_any_name(spark):
    names = ["_row", "_text", "_doc", "_key", "_copy", "_spots"]
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(d, text, "old", *[f"{n} {d}" for n in names]) for d in (1, 2)], "doc_id long, text string, n_words string, " + ", ".join(f"{n} string" for n in names))
    made = substring_dedup.remove_repeats(docs)
    assert made.columns == ["doc_id", "text", *names, "n_words", "n_removed", "kept_text"]
    rows = made.orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed) for r in rows] == [(60, 0), (60, 60)]
    assert [[r[n] for n in names] for r in rows] == [[f"{n} {d}" for n in names] for d in (1, 2)]


def test_many_shapes_of_rules(spark):
    rules = [(f"h{i % 50}.Example.com" if i % 2 else "example.com", "/" + "p" * (i % 400), "block" if i % 3 else "allow") for i in range(3000)]
    urls = ["http://h7.example.com/" + "p" * 250 + "?x", "http://x.h7.example.com/", "https://other.example.com/" + "p" * 7 + "q", "http://nothing.org/", "http://" + "a." * 3000 + "example.com/" + "p" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, url in enumerate(urls):
        host, _, path = url.split("://")[1].split("?")[0].partition("/")
        fits = [(len(h.lower() + p), v == "block", h.lower() + p, v) for h, p, v in rules if (host == h.lower() or host.endswith("." + h.lower())) and ("/" + path).startswith(p)]
        assert found[i] == ((max(fits)[2], max(fits)[3]) if fits else (None, "allow"))


def test_chat_of_very_long_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x" * 3_000_000), (2, 0, "user", "x" * 3_000_000), (2, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in chat_formatting.format_conversations(turns).collect()] == [(2, 2)]


def test_ids_with_several_texts(spark):
    """The texts of one id are one vertex, however many they are."""
    texts = [(1, " ".join(f"t{k}_{i}" for i in range(20))) for k in range(30)] + [(2, " ".join(f"t7_{i}" for i in range(20))), (3, "something else altogether here now")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_urls(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, ("x.org", "/", "block"), ("X", None, "allow"), ("com", "/fr/", "allow")], "host string, path string, verdict string")
    urls = [None, "no scheme", "http://A.Example.org/es/1?q", "https://example.org/en/12", "ftp://example.org/en/2", "http://b.com/fr/x", "http://b.com/de/", "http://com/de/x#f", "http://notcom/de/", "http://x.org", "http://y.x.org/a", "://org/", "http://org?x=/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df, rules).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[3][2:] == ("example.org/en/1", "block")
    assert got[4][2:] == ("org/", "allow")
    assert got[5][2:] == ("com/fr/", "allow")
    assert got[6][2:] == got[7][2:] == ("com/de/", "block")
    assert got[8][2:] == (None, "allow")
    assert got[9] == ("x.org", "", None, "allow")
    assert got[10][2:] == ("x.org/", "block")
    assert got[11] == ("org", "/", "org/", "allow")
    assert got[12] == ("org", "", None, "allow")
    assert url_filters.filter_urls(df, rules.limit(0)).where("rule IS NOT NULL").count() == 0
