"""Tables with columns that are named like the operators' own: they don't change what comes out."""

from pyspark.sql import functions as F

from tessella.llm import chat_formatting, media, packing, queries, warc


def same(a, b):
    names = b.columns
    return sorted(map(repr, a.select(*names).collect())) == sorted(map(repr, b.collect()))


def test_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 20").coalesce(1)
    clashing = docs.select("*", *[F.lit("own").alias(c) for c in ("start", "window", "offset", "open", "ids", "group", "doc_tokens", "sequence_id")])
    path = queries.tokenizer("byte_bpe_50k.json")
    a, b = (packing.pack(df, path, 1).select("doc_id", "start", "ids", "doc_tokens", "offset") for df in (clashing, docs))
    assert a.columns == b.columns
    assert same(a, b)


def test_chat_formatting(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    clashing = rows.select("*", *[F.lit("own").alias(c) for c in ("lines", "window", "hash", "prefix", "n_turns", "turns", "last")])
    assert same(chat_formatting.format_conversations(clashing), chat_formatting.format_conversations(rows))


def test_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(40)
    clashing = pages.select("*", *[F.lit("own").alias(c) for c in ("payload", "digest", "record_type", "first", "refers_to", "archive", "n")])
    read = lambda df: warc.resolve_revisits(warc.record_lengths(warc.read_archives(warc.write_archives(warc.mark_revisits(df))))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert same(read(clashing), read(pages))


def test_sniffing(spark):
    rows = spark.createDataFrame([(1, bytearray(media.wav_header(4) + b"abcd"), "image/png")], "k long, media binary, declared string")
    clashing = rows.select("*", *[F.lit("own").alias(c) for c in ("_part", "part", "kind", "at")])
    made, plain = media.sniff(clashing, "media", "declared"), media.sniff(rows, "media", "declared")
    assert same(made, plain)
    assert {r["_part"] for r in made.collect()} == {"own"}
