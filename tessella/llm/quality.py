"""Quality classifier by hierarchical empirical Bayes: a document's own evidence, its path's, its host's and the corpus's.

A logistic regression on features of style and on hashed words gives each document a
likelihood ratio. Sums of the documents' posteriors by host and path, made in grouped
aggregations, give each site a rate of low quality: a host's rate is shrunk towards the
corpus's, a path's towards its host's, by pseudo-counts that the method of moments takes
from the spread between sites. A sparse site so has its parent's rate. A document's own
part is taken out of its path's, its host's and the corpus's sums before its rates are
formed, so its evidence counts once: its posterior is its likelihood ratio times the odds
of its path's rate.

The regression is fitted on the rows with a labelled id; of more than FIT_IDS such ids,
on about so many whose hashes are small. Rates are sums over all documents.

Defined cases: a null text is judged as an empty one; a null host or path is a site of
its own; rows that repeat are judged each, and each counts for its site; a label that is
null is none, and of labels that repeat an id the smallest quality counts; without
labels of both kinds all documents have the ratio 1 and the prior PRIOR; an empty table
gives an empty result; ``judge`` gives its own columns only, ``keep_good`` all columns of
the input, whatever their names are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import column_buffers, cut, slices
from tessella.llm.textscan import lowered, mix, word_hashes, words_of

#: Bytes of text that a task works on at a time; about fifty bytes are held for each.
SLICE_BYTES = 256 << 10
#: Rate of low quality where no label tells one, and a document is rejected beyond this posterior.
PRIOR, REJECT = 0.1, 0.5
#: Bounds of the pseudo-counts that sites are shrunk with.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1e6
#: A document's evidence counts as so many units of log odds at most.
MOST_EVIDENCE = 12.0
#: The regression's penalty on a squared weight, over all rows, and the scale of the words' shares beside features of style of unit variance.
PENALTY, CONTENT_SCALE = 0.5, 10.0
#: Buckets of hashed words (a power of two), and about how many labelled ids the regression is fitted on at most.
BUCKETS, FIT_IDS = 128, 200_000

FEATURES = ["log_words", "word_length", "upper", "digit", "wide", "mark", "shout", "bar", "symbol", "line", "distinct_words", "repeated_words", "top_word", "distinct_lines"]

#: Classes of bytes, in the order of the byte shares above.
_CLASSES = [
    bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256)), b".,;:?'\"()-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~", b"\n",
]


def _class_of() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for k, members in enumerate(_CLASSES):
        table[list(members)] = k + 1
    return table


_CLASS = _class_of()


def _share_of_distinct(hashes: np.ndarray, row: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's items, the share that is distinct, and the share of the most frequent one (1 and 0 for none)."""
    keys = mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys, first, times = np.unique(keys, return_index=True, return_counts=True)
    distinct = np.bincount(row[first], minlength=len(count))
    top = np.zeros(len(count), np.int64)
    np.maximum.at(top, row[first], times)
    full = np.maximum(count, 1)
    return np.where(count > 0, distinct / full, 1.0), top / full


def style(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The features of each text, a row of FEATURES each; the row and the bucket of each word; the number of words of each text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    row_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row_of_byte * (len(_CLASSES) + 1) + _CLASS[data], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)
    starts, ends, before = words_of(data, offsets)
    words = np.diff(before)
    row = np.repeat(np.arange(n), words)
    hashes = word_hashes(data, starts, ends)
    distinct_words, top_word = _share_of_distinct(hashes, row, words)
    again = np.zeros(n)
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        again = np.bincount(row[1:][same], minlength=n) / np.maximum(words - 1, 1)
    # lines: the runs between line feeds, with the texts' bounds
    edge = np.zeros(len(data), bool)
    edge[1:] = data[:-1] == 10
    edge[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(data))
    line_row = row_of_byte[begin] if len(begin) else begin
    distinct_lines = np.ones(n)
    if len(begin):
        distinct_lines = _share_of_distinct(word_hashes(data, begin, end), line_row, np.bincount(line_row, minlength=n))[0]
    length = np.bincount(row, weights=ends - starts, minlength=n) / np.maximum(words, 1)
    shares = counts[:, 1:] / size[:, None]
    found = np.column_stack([np.log1p(words), np.minimum(length, 100), *shares.T, distinct_words, again, top_word, distinct_lines])
    # words by content, whatever their case
    plain = mix(word_hashes(lowered(data), starts, ends)) & np.uint64(BUCKETS - 1)
    return found, row, plain.astype(np.int64), words


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: FEATURES, and the share of its words in each bucket."""
    found, row, bucket, words = style(data, offsets)
    shares = np.bincount(row * BUCKETS + bucket, minlength=len(words) * BUCKETS).reshape(-1, BUCKETS) / np.maximum(words, 1)[:, None]
    return np.concatenate([found, shares], axis=1)


class Model:
    """Weights of the features and buckets, and the labelled rows' rate of low quality."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior

    def log_odds(self) -> float:
        return math.log(self.prior / (1 - self.prior))

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The logarithm of the likelihood ratio of low to good quality, for each text."""
        found, row, bucket, words = style(data, offsets)
        k = len(FEATURES)
        content = np.bincount(row, weights=self.weights[k:][bucket], minlength=len(words)) / np.maximum(words, 1)
        return np.clip(found @ self.weights[:k] + content + self.bias - self.log_odds(), -MOST_EVIDENCE, MOST_EVIDENCE)


def _by_slice(df: DataFrame, text_col: str, name: str, kind: T.DataType, make, keep_text: bool = False) -> DataFrame:
    """Add what ``make`` gives for slices of the texts; the texts go, unless they are kept."""
    names = [c for c in df.columns if c != name and (keep_text or c != text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_buffers(batch.column(batch.schema.get_field_index(text_col)))
            for i, j in slices(offsets, SLICE_BYTES):
                made = make(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in names), made], [*names, name])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in names), T.StructField(name, kind)]))


def with_features(df: DataFrame, text_col: str, name: str = "_features") -> DataFrame:
    """The rows with their features, an array of doubles, in place of the texts."""
    size = len(FEATURES) + BUCKETS

    def make(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(offsets) * size, size, dtype=np.int32)), pa.array(features(data, offsets).reshape(-1)))

    return _by_slice(df, text_col, name, T.ArrayType(T.DoubleType()), make)


def with_evidence(df: DataFrame, model: Model, text_col: str, keep_text: bool = False) -> DataFrame:
    return _by_slice(df, text_col, "evidence", T.DoubleType(), lambda data, offsets: pa.array(model.evidence(data, offsets)), keep_text)


def fit_documents(texts: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int = FIT_IDS) -> Model:
    """Logistic regression of ``label_col = 0`` on the features of ``texts`` (_id, _text), over at most ``most`` labelled ids."""
    # here, so that workers that only make features don't load them
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).alias("_good"))
    known = cut(known)
    share = min(1.0, most / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # so few rows that they may be broadcast; texts are not shuffled
    rows = cut(with_features(texts.join(F.broadcast(known), "_id").select((F.col("_good") == 0).cast("double").alias("label"), "_text"), "_text"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("low")).first()
    if not seen.n or not 0 < seen.low < seen.n:
        return Model(np.zeros(len(FEATURES) + BUCKETS), math.log(PRIOR / (1 - PRIOR)), PRIOR)
    spread = rows.agg(*[F.stddev(F.col("_features")[k]).alias(str(k)) for k in range(len(FEATURES))]).first()
    scale = [1 / max(x or 0.0, 1e-6) for x in spread] + [CONTENT_SCALE] * BUCKETS
    scaled = F.zip_with("_features", F.array(*map(F.lit, scale)), lambda x, s: x * s)
    fitted = LogisticRegression(maxIter=100, regParam=PENALTY / seen.n, standardization=False).fit(rows.select("label", array_to_vector(scaled).alias("features")))
    return Model(np.array(fitted.coefficients) * np.array(scale), float(fitted.intercept), seen.low / seen.n)


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (F.lit(1.0) - p))


def weight(rates: DataFrame, low: str, rows: str, parent: str) -> float:
    """The pseudo-count by which sites with ``low`` of ``rows`` are shrunk towards their ``parent`` rate.

    The sites' spread beyond what their own sampling explains is the variance of a beta
    distribution, whose weight it gives.
    """
    p, m, n = F.col(low) / F.col(rows), F.col(parent), F.col(rows).cast("double")
    s = rates.agg(
        F.count(F.lit(1)).alias("sites"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(n * (p - m) ** 2).alias("between"), (F.sum(n * m * (1 - m)) / F.sum(n)).alias("within")
    ).first()
    if not s.sites or s.sites < 2 or not s.within:
        return MOST_WEIGHT
    variance = (s.between - (s.sites - 1) * s.within) / max(s.n - s.nn / s.n, 1e-9)
    return MOST_WEIGHT if variance <= 0 else min(max(s.within / variance - 1, LEAST_WEIGHT), MOST_WEIGHT)


class Rates:
    """The sums by host and path (a table), those of the corpus, and the weights that sites are shrunk with."""

    def __init__(self, sites: DataFrame, rows: int, low: float, host_weight: float, path_weight: float):
        self.sites, self.rows, self.low, self.host_weight, self.path_weight = sites, rows, low, host_weight, path_weight


def own_share(prior: float) -> Column:
    """A document's part of its sites' sums: its posterior at the labelled rows' rate. Rounded, so sums don't depend on the order of rows."""
    return F.round(_sigmoid(F.col("evidence") + math.log(prior / (1 - prior))), 6)


def shrunk(low: Column, rows: Column, parent: Column, by: float) -> Column:
    return (low + F.lit(by) * parent) / (rows + F.lit(by))


def site_rates(scored: DataFrame, prior: float) -> Rates:
    """Sums over all rows of ``scored`` (host, path and evidence)."""
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(own_share(prior).cast("decimal(18,6)")).cast("double").alias("low")))
    hosts = paths.groupBy(F.col("host").alias("_host")).agg(F.sum("n").alias("host_n"), F.sum("low").alias("host_low"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_low").alias("low")).first()
    rows, low = total.n or 0, total.low or 0.0
    rate = (low + 1) / (rows + 2)
    host_weight = weight(hosts.withColumn("_m", F.lit(rate)), "host_low", "host_n", "_m")
    sites = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"))
    host_rate = shrunk(F.col("host_low"), F.col("host_n"), F.lit(rate), host_weight)
    return Rates(sites, rows, low, host_weight, weight(sites.withColumn("_m", host_rate), "low", "n", "_m"))


def posteriors(scored: DataFrame, rates: Rates, prior: float) -> DataFrame:
    """Add host_rate, path_rate (without the row's own part) and low_quality (the posterior) to rows with host, path and evidence."""
    sites = rates.sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("n").alias("_n"), F.col("low").alias("_low"), F.col("host_n").alias("_host_n"), F.col("host_low").alias("_host_low"))
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    own, one = own_share(prior), F.lit(1)
    rate = (F.lit(rates.low) - own + one) / F.lit(rates.rows + 1)
    joined = joined.withColumn("host_rate", shrunk(F.col("_host_low") - own, F.col("_host_n") - one, rate, rates.host_weight))
    joined = joined.withColumn("path_rate", shrunk(F.col("_low") - own, F.col("_n") - one, F.col("host_rate"), rates.path_weight))
    return joined.withColumn("low_quality", _sigmoid(F.col("evidence") + _logit(F.col("path_rate")))).drop("_host", "_path", "_n", "_low", "_host_n", "_host_low")


def _site(host: Column | str, path: Column | str) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).cast("string").alias(name) for c, name in ((host, "host"), (path, "path"))]


def fit(docs: DataFrame, labels: DataFrame, host: Column | str, path: Column | str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, Model, Rates]:
    """The scored rows (_id, host, path, evidence), the document model and the sites' rates, of all of ``docs``."""
    parted = docs.select(F.col(id_col).cast("long").alias("_id"), *_site(host, path), F.col(text_col).alias("_text"))
    model = fit_documents(parted.select("_id", "_text"), labels, id_col, label_col)
    scored = cut(with_evidence(parted, model, "_text"))
    return scored, model, site_rates(scored, model.prior)


def judge(docs: DataFrame, labels: DataFrame, host: Column | str, path: Column | str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", reject: float = REJECT) -> DataFrame:
    """Per row: ``id_col``, host, path, evidence, host_rate, path_rate, low_quality and rejected."""
    scored, model, rates = fit(docs, labels, host, path, id_col, text_col, label_col)
    return posteriors(scored, rates, model.prior).withColumn("rejected", F.col("low_quality") > reject).withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, host: Column | str, path: Column | str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns.

    The rows are read again and judged in passing: texts are not shuffled unless the
    table of sites is too large to broadcast.
    """
    _, model, rates = fit(docs, labels, host, path, id_col, text_col, label_col)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    parted = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("_row"), *_site(host, path), F.col(text_col).alias("_text"))
    kept = posteriors(with_evidence(parted, model, "_text", keep_text=True), rates, model.prior).where(~(F.col("low_quality") > reject))
    return kept.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def posteriors_by_brute_force(rows: list[tuple[str | None, str | None, float]], prior: float, host_weight: float, path_weight: float) -> list[tuple[float, float, float]]:
    """host_rate, path_rate and the posterior of each of a small list of rows (host, path, evidence), from the sums over all other rows: for tests."""
    share = [round(1 / (1 + math.exp(-(e + math.log(prior / (1 - prior))))), 6) for _, _, e in rows]
    out = []
    for i, (host, path, evidence) in enumerate(rows):
        others = [k for k in range(len(rows)) if k != i]
        rate = (sum(share[k] for k in others) + 1) / (len(others) + 2)
        for site, by in (((host,), host_weight), ((host, path), path_weight)):
            same = [k for k in others if rows[k][: len(site)] == site]
            rate = (sum(share[k] for k in same) + by * rate) / (len(same) + by)
            out.append(rate)
        out.append(1 / (1 + math.exp(-(evidence + math.log(rate / (1 - rate))))))
    return list(zip(out[::3], out[1::3], out[2::3], strict=True))
