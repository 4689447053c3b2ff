"""URL allow and block lists: host-suffix and path-prefix expressions met by hash prefixes.

Every rule is an expression ``host + path``. A URL's host is expanded into the suffixes
of up to as many labels as rules have, which meet the rules' hosts; for each host that
is met, the URL's path is expanded into the prefixes of the lengths that this host's
rules have. Expressions and rules meet in an equi-join on a short hash prefix, and the
full digests confirm. No list of rules or shapes passes through the driver.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no
rule; a rule with a null part is ignored, and A-Z in its host count as lower case;
repeated rules count once; of several fitting rules the longest ``host + path`` wins,
then block before allow, then the greater string; repeated rows are judged each; an
empty table gives an empty result. Columns of the input named like an output (host,
path, rule, verdict) are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join uses.
PREFIX_HEX = 8


def _lowered(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = _lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _hashed(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the digest of a column (``name``) and its prefix (``_prefix``), which joins meet by."""
    return df.withColumn(name, F.sha2(text, 256)).withColumn("_prefix", F.substring(name, 1, PREFIX_HEX))


def filter_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to each row.

    ``rules`` has the columns host, path and verdict (allow or block).
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(_lowered(F.col("host")).alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_v"))
    labels = F.split("host", r"\.")
    most = rules.agg(F.max(F.size(F.split("_host", r"\.")))).first()[0] or 0
    # a host's rules may be many, but the lengths of their paths are few
    hosts = _hashed(rules.groupBy("_host").agg(F.collect_set(F.length("_path")).alias("_lengths")), "_host", "_full")
    full = _hashed(rules.select(F.concat("_host", "_path").alias("rule"), "_v").distinct(), "rule", "_full")

    host, path = url_parts(F.col(url_col))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    judged = df.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1)))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    met = _hashed(judged.select("host", "path").distinct().withColumn("_suffix", F.explode(suffixes)), "_suffix", "_digest")
    met = met.join(hosts, "_prefix").where("_digest = _full").select("host", "path", "_host", F.explode("_lengths").alias("_length")).where(F.length("path") >= F.col("_length"))
    expressions = _hashed(met.select("host", "path", F.concat("_host", F.substring(F.col("path"), F.lit(1), F.col("_length"))).alias("_expression")).distinct(), "_expression", "_digest")
    best = (
        expressions.join(full, "_prefix")
        .where("_digest = _full")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("_v") == "block").alias("b"), "rule", "_v")).alias("_best"))
        .select("host", "path", F.col("_best.rule").alias("rule"), F.col("_best._v").alias("_v"))
    )
    return judged.join(best, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("_v", F.lit(default)).alias("verdict"))
