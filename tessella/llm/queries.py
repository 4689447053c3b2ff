"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import ann, bpe, chat_formatting, hard_negatives, jaccard_join, media, near_dedup, packing, quality, substring_dedup, token_alignment, url_filters, warc
from tessella.llm.common import cut, table

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; workers find it at the same path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold_percent=85)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    decoded = bpe.decode(encoded, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.joined_ids("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = cut(warc.write_archives(warc.mark_revisits(table(spark, sf_dir, "pages"))))
    resolved = warc.resolve_revisits(cut(warc.record_lengths(warc.read_archives(archives))))
    return resolved.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_samples(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media")
    sniffed = media.sniff(stored.withColumn("declared", F.lit("image/png")), "media", "declared")
    back = media.read_samples(sniffed).withColumn("tail", media.tail("samples"))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32("tail").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def sites(docs: DataFrame) -> tuple[Column, Column]:
    """A document's host and path. Documents have no URL: the source stands for the host, and the path in it
    is the language and the power of two of the text's length, which leaves many paths sparse."""
    size = F.floor(F.log2(F.length(F.coalesce("text", F.lit(""))) + 1)).cast("string")
    return F.col("source"), F.concat_ws("/", F.coalesce("lang", F.lit("")), size)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, table(spark, sf_dir, "labels"), *sites(docs))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=1))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.format_conversations(table(spark, sf_dir, "conversations"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filters.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def groups_digest(groups: str) -> str:
    """Of a text without tokens, which has no groups, an empty string."""
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = token_alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), kept=groups_digest)
    return made.withColumnRenamed("groups", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), "id % 50 = 0", label_col=label)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"), words=3, threshold_percent=90)


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

def _little_endian(n: str) -> str:
    """SQL for the hexadecimal digits of a 32-bit number, smallest byte first."""
    return " || ".join(f"substr(printf('%08x', {n}), {at}, 2)" for at in (7, 5, 3, 1))


_WORDS_SQL = r"'[^\x20\x09-\x0D]+'"


def _links_sql(threshold_percent: int) -> str:
    """A table c of doc_id, n_shingles and component_id over sets of three words, from all pairs that share a shingle."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS_SQL}) AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE [array_to_string(words[i:i + 2], ' ') FOR i IN range(1, len(words) - 1)] END) AS shingles FROM w),
k AS (SELECT doc_id, shingles, CAST(len(shingles) AS BIGINT) AS n, CASE WHEN len(shingles) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(shingles)) END AS node FROM s),
e AS (SELECT node, n, unnest(shingles) AS shingle FROM k WHERE node = doc_id),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.node < b.node
  WHERE 100 * least(a.n, b.n) >= {threshold_percent} * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= {threshold_percent} * (any_value(a.n) + any_value(b.n) - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a AS node, min(b) AS low FROM reach GROUP BY a),
c AS (SELECT doc_id, n AS n_shingles, least(node, coalesce(low, node)) AS component_id FROM k LEFT JOIN lowest USING (node))
"""


ORACLES = {
    "op1_minhash": _links_sql(85) + "SELECT *, doc_id = component_id AS kept FROM c",
    "op13_jaccard_join": _links_sql(90) + "SELECT * FROM c",
    "op3_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
""",
    "op4_media": f"""
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS raw FROM documents),
p AS (SELECT doc_id, len(raw) // 2 AS n_bytes, rpad(raw, CAST(128 * greatest(1, (len(raw) + 127) // 128) AS INT), '0') AS payload FROM t),
m AS (
  SELECT *, len(payload) // 2 AS size,
         '{media.wav_header(0)[:4].hex()}' || {_little_endian("len(payload) // 2 + 36")} || '{media.wav_header(0)[8:40].hex()}' || {_little_endian("len(payload) // 2")} || payload AS media,
         [CAST('0x' || v AS BIGINT) FOR v IN regexp_extract_all(payload, '..')] AS samples
  FROM p),
b AS (
  -- the last bytes' bits, lowest first, after the register that they are shifted into
  SELECT *, list_prepend(4294967295, flatten([[(v >> i) & 1 FOR i IN range(8)] FOR v IN samples[-64:]])) AS bits FROM m)
SELECT doc_id, n_bytes, size AS payload_bytes, sha256(unhex(payload)) AS payload_sha256,
       CAST(xor(list_reduce(bits, LAMBDA c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS BIGINT) AS tail_crc32,
       len(media) // 2 AS media_bytes, sha256(unhex(media)) AS media_sha256,
       concat('audio/wav;samples=', size, ';sum=', CAST(list_sum(samples) AS BIGINT), ';peak=', list_max(samples), ';changes=',
              len(list_filter(list_zip(samples, samples[2:], true), LAMBDA x: x[1] <> x[2]))) AS feature
FROM b
""",
    "op5_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS_SQL}) AS words FROM documents),
w AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS place, unnest([array_to_string(words[i:i + 49], ' ') FOR i IN range(1, len(words) - 48)]) AS passage
  FROM d WHERE len(words) >= 50),
f AS (SELECT passage, min(doc_id) AS first FROM w GROUP BY passage),
gone AS (SELECT DISTINCT doc_id, unnest(range(place, place + 50)) AS place FROM w JOIN f USING (passage) WHERE doc_id > first),
one AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d),
k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS kept FROM one ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
    "op8_chat_formatting": chat_formatting.ORACLE_SQL,
    "op10_url_filters": f"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest),
rules(h, p, v) AS (VALUES {_RULES_SQL}),
fits AS (
  SELECT page_id, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, v = 'block' DESC, h || p DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (page_id)
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, LAMBDA x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_media": op4_media,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_ann": op7_ann,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_packing": op9_packing,
    "op10_url_filters": op10_url_filters,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_jaccard_join": op13_jaccard_join,
}
