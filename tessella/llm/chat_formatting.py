"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Loggers often store a conversation again after each turn. Rolling hashes of the turn
prefixes find the conversations that are a prefix of a longer one or equal to another;
anti-joins keep the maximal ones, which are then rendered.

Defined cases: rows without a conversation id belong to no conversation and are left
out; a conversation's turns are ordered by turn, role and text (nulls first), and
repeated rows are turns of their own; null and empty roles or texts differ in the
comparison and both render as empty; of equal conversations the smallest id stays; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its place and the rolling 128-bit hash of the turns up to it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rolling = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(w))
    content = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    for lane in (0, 1):
        place = place.withColumn(f"_t{lane}", F.xxhash64(F.lit(lane), *content))
    # each turn's hash is salted with its place, so their exclusive or is the hash of the prefix
    return place.select(
        "conv_id", "place", "role", "text",
        F.bit_xor("_t0").over(rolling).alias("h0"), F.bit_xor("_t1").over(rolling).alias("h1"),
        F.lead("place").over(w).isNull().alias("last"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no other one extends."""
    prefixes = turn_prefixes(turns).select("conv_id", "place", "h0", "h1", "last")
    whole = prefixes.where("last").groupBy("h0", "h1", "place").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    shorter = prefixes.where("NOT last").select("h0", "h1", "place").distinct()
    return whole.join(shorter, ["h0", "h1", "place"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def format_conversations(turns: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """The maximal conversations, rendered: conv_id, n_turns, n_copies, rendered."""
    kept = maximal_conversations(turns)
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ordered = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(w))
    line = F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"{end}\n"))
    return (
        ordered.join(kept, "conv_id")
        .groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
        .select("conv_id", "n_turns", "n_copies", F.concat_ws("", F.transform("lines", lambda x: x["line"])).alias("rendered"))
    )


ORACLE_SQL = f"""
WITH numbered AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY place) AS turns, count(*) AS n_turns,
         string_agg('{START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{END}' || chr(10), '' ORDER BY place) AS rendered
  FROM numbered GROUP BY conv_id),
same AS (
  SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(rendered) AS rendered
  FROM conv GROUP BY turns, n_turns)
SELECT conv_id, n_turns, n_copies, rendered FROM same a
WHERE NOT EXISTS (SELECT 1 FROM same b WHERE b.n_turns > a.n_turns AND b.turns[1:a.n_turns] = a.turns)
"""
