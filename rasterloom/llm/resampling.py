"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target texts (labelled good) and one of the raw
corpus, give every text the log of its importance weight; adding Gumbel noise and keeping the k
largest keys samples k texts without replacement in proportion to those weights. Besides word unigrams
and bigrams the models count those of word shapes (case, digits, punctuation, repetition), since rare
words say little.

Nulls count as empty texts: log weight 0. Repeated rows get equal weights and, sharing the id, equal
noise; a row without an id draws its noise by its text. Rows that tie with the k-th key all stay, so
repeated rows stay or go together. An empty table gives an empty result; without target labels nothing
can be told apart and every row is kept; other columns are carried along or ignored. Log weights are
sums over a text's n-grams, as in the published method, so long texts stand far from the limit and the
noise decides among the near ones; a `temperature` over 1 evens the draw out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.base import kth_largest, materialise

BUCKETS = 1 << 14
#: Bound of the labelled sample behind the target model.
SAMPLE_TARGET = 20_000
SMOOTHING = 1.0
SEED = 11

_RUNS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")


def shape(word: str) -> str:
    """`Thing.` -> `Aa.`, `that***` -> `a***`, `ONE!!` -> `A!!`, `2024` -> `0`."""

    if word.isalpha():
        return _letters(word)

    def short(m: re.Match) -> str:
        run = m[0]
        return "0" if run[0].isdigit() else _letters(run) if run[0].isalpha() else run[:3]

    return _RUNS.sub(short, word)[:12]


def _letters(run: str) -> str:
    return "a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "Aa" if run.istitle() else "aA"


class _Tokens(dict):
    """Word -> row of two arrays, the hash of the bare word and that of its shape, for the words met
    lately."""

    def __init__(self, keep: int = 300_000):
        super().__init__()
        self.keep = keep
        self.bare, self.form = np.zeros(keep, np.uint64), np.zeros(keep, np.uint64)

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        text = word.decode("utf-8", "replace")
        self.bare[row] = xxhash.xxh64_intdigest(text.lower().strip(".,;:!?\"'()*$%&#|<>-"))
        self.form[row] = xxhash.xxh64_intdigest(shape(text), seed=1)
        return row

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of every word; long texts go in parts, so that the table never overflows."""
        parts = []
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            if len(self) + len(part) > self.keep:
                self.clear()
            rows = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            parts.append((self.bare[rows], self.form[rows]))
        return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts)))


def ngram_buckets(text: bytes | None, tokens: _Tokens, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every n-gram of a text; `buckets` is a power of two."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int64)
    bare, form = tokens.of(words)
    for lag in (1, 2):
        form[lag:] += (bare[lag:] == bare[:-lag]) * np.uint64(lag * 0x9E37)
    grams = np.concatenate([bare, form, bare[:-1] * np.uint64(3) + bare[1:], form[:-1] * np.uint64(3) + form[1:]])
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def target_ids(labels: DataFrame, bound: int = SAMPLE_TARGET) -> DataFrame:
    """At most `bound` ids labelled good, chosen by hash."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability per bucket. Raw counts cover every text; the driver gets
    one pair of counts per bucket."""
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(target_ids(labels).withColumn("target", F.lit(True))), "doc_id", "left"
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, raw, target = _Tokens(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, good in zip(batch["text"], batch["target"].notna()):
                n = np.bincount(ngram_buckets(text, tokens), minlength=BUCKETS)
                raw += n
                if good:
                    target += n
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "raw": raw, "target": target})

    counts = marked.mapInPandas(count, "bucket int, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS))
    return share(target) - share(raw)


def log_weight(docs: DataFrame, ratios: np.ndarray) -> Column:
    """The log weight of the text of a row of `docs`, as a column."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens, r = _Tokens(), shared.value
        for batch in batches:
            yield pd.Series([float(r[ngram_buckets(t, tokens)].sum()) for t in batch], dtype="float64")

    return run(F.col("text").cast("binary"))


def keep_share(labels: DataFrame) -> float:
    """Share of texts to sample: that of good ones among all labels, plus two standard errors."""
    good, n = labels.agg(F.sum((F.col("quality") == 1).cast("int")), F.count("quality")).first()
    if not n or not good:
        return 1.0
    p = good / n
    return min(1.0, p + 2 * (p * (1 - p) / n) ** 0.5)


def draw(docs: DataFrame, labels: DataFrame, carry: list[str], share: float | None = None, seed: int = SEED, temperature: float = 1.0) -> DataFrame:
    """row (a struct of the columns to carry), log_weight, key and kept of every row; kept marks the
    Gumbel top k, k = share of rows. Rows are written once with their keys, so none is looked up again."""
    noise = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    uniform = (F.pmod(noise, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    weighed = docs.select(row, log_weight(docs, fit(docs, labels)).alias("log_weight"), (-F.log(-F.log(uniform))).alias("gumbel"))
    keyed = materialise(weighed.select("row", "log_weight", (F.col("log_weight") / temperature + F.col("gumbel")).alias("key")))
    n = keyed.count()
    k = round(n * (keep_share(labels) if share is None else share))
    if k >= n:
        return keyed.withColumn("kept", F.lit(True))
    limit = kth_largest(keyed, "key", k)
    return keyed.withColumn("kept", F.col("key") >= limit if limit is not None else F.lit(False))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, temperature: float = 1.0) -> DataFrame:
    """doc_id, log_weight, key and kept of every row."""
    return draw(docs, labels, ["doc_id"], share, seed, temperature).select("row.doc_id", "log_weight", "key", "kept")


def keep_sample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """The rows of `docs` in the sample."""
    return draw(docs, labels, docs.columns, share, seed).where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
