"""Suffix-array dedup over a sparse suffix array.

Suffixes are kept only at minimiser positions, chosen by content, so that equal passages keep equal
suffixes: every 50-word passage holds one of them within its first 32 words. Suffixes whose next 19
words occur in several documents are dealt by those words. Each task sorts its suffixes by the words
after them, and once more by the words before them, and compares neighbours in both orders; the common
lengths cut either order into intervals of suffixes that agree in d words to the right, or in 50 - d
words to the left. Suffixes in the same interval of both orders, for some d, stand in the same 50-word
passage, and the match is extended to the largest such d and 50 - d. Every pair of suffixes is covered
by its intervals, not only neighbours. Longer passages are the union of what their successive suffixes
report.

Nineteen words with very many occurrences are not dealt to one task: their suffixes are matched by the
hashes of the 50-word passages around them, a row for each passage, which Spark spreads evenly.

Matches inside one document do not count. Null texts hold no words; rows without an id are left out;
repeated rows with the same id are one document; an empty table gives an empty result; other columns
are ignored. A word stands for its 32-bit hash within a key (64 bits), passages of frequent keys for
128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.base import Portion, materialise, minimisers, mixed, portions, window_hashes
from rasterloom.llm.recurring import Recurring, passes, recurring

PASSAGE, GRAM, SPREAD = 50, 8, 32
#: Words after a position in its key, and words kept on both sides of it for the extension.
KEY = PASSAGE - SPREAD + 1
LEFT, RIGHT = SPREAD - 1, PASSAGE
#: Occurrences from which a key is matched by passage, and suffixes expected in a task.
HOT, SHARD_ROWS = 20_000, 40_000
CONTEXT = "key long, doc_id long, at int, after binary, before binary"


def suffixes(p: Portion) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, kept position, key) of the sparse suffix array's entries; positions are places in the whole."""
    text = np.repeat(np.arange(len(p.lengths)), p.lengths)
    grams, span = window_hashes(p.hashes, GRAM), GRAM + SPREAD - 1
    whole = text[: max(len(text) - span + 1, 0)] == text[span - 1 :]
    at = minimisers(grams, SPREAD, whole)
    ends = np.cumsum(p.lengths)
    at = at[at + KEY <= ends[text[at]]]
    return text[at], at, window_hashes(p.hashes, KEY)[at]


def _keys(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for p in portions(batch["text"]):
                text, _, key = suffixes(p)
                yield pd.DataFrame({"key": key.view(np.int64), "doc_id": ids[p.rows[text]]})

    return docs.mapInPandas(run, "key long, doc_id long")


def _chosen(p: Portion, found: Recurring, hot: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes whose key may recur: the frequent ones or the others."""
    text, at, key = suffixes(p)
    ok = passes(key, found.filter.value)
    if found.hot:
        ok &= passes(key, found.hot_filter.value) == hot
    return text[ok], at[ok], key[ok]


def _contexts(docs: DataFrame, found: Recurring) -> DataFrame:
    """key, doc_id, at and the 32-bit word hashes after (`after`) and, backwards, before (`before`) each
    suffix that may recur; 0 stands for the end of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for p in portions(batch["text"]):
                text, at, key = _chosen(p, found, False)
                if not len(at):
                    continue
                ends = np.cumsum(p.lengths)[text][:, None]
                begins = ends - p.lengths[text][:, None]
                small = (p.hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

                def around(places: np.ndarray) -> list[bytes]:
                    inside = (places >= begins) & (places < ends)  # noqa: B023
                    found_ = np.where(inside, small[np.clip(places, 0, len(small) - 1)], np.uint32(0))  # noqa: B023
                    flat = found_.astype(">u4").tobytes()
                    width = 4 * places.shape[1]
                    return [flat[i : i + width] for i in range(0, len(flat), width)]

                after, before = around(at[:, None] + np.arange(RIGHT)), around(at[:, None] - 1 - np.arange(LEFT))
                own = (at - begins[:, 0]).astype(np.int32)
                yield pd.DataFrame({"key": key.view(np.int64), "doc_id": ids[p.rows[text]], "at": own, "after": after, "before": before})

    return docs.mapInPandas(run, CONTEXT)


def _words(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u4").reshape(-1, width)


def _common(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row of an order with the row before it; the first has 0."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 8192):
        one, two = x[order[a - 1 : a + 8191]], x[order[a : a + 8192]]
        one = one[: len(two)]
        differ = (one != two) | (one == 0)
        out[a : a + len(two)] = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    return out


def compare(rows: pd.DataFrame) -> pd.DataFrame:
    """doc_id, lo, hi of the passages that suffixes, whole keys of them, share with other documents."""
    n = len(rows)
    key, doc, at = rows["key"].to_numpy(), rows["doc_id"].to_numpy(), rows["at"].to_numpy().astype(np.int64)
    orders, shared = [], []
    for column, width in (("after", RIGHT), ("before", LEFT)):
        words = _words(rows[column], width)
        order = np.argsort(np.frombuffer(words.tobytes(), f"S{4 * width}"), kind="stable")
        order = order[np.argsort(key[order], kind="stable")]
        common = _common(words, order)
        common[1:][key[order][1:] != key[order][:-1]] = -1
        common[:1] = -1
        orders.append(order)
        shared.append(common)
    interval = np.empty((2, n), np.int64)
    right, left = np.zeros(n, np.int64), np.full(n, -1)
    for d in range(KEY, PASSAGE + 1):
        for side, depth in ((0, d), (1, PASSAGE - d)):
            interval[side, orders[side]] = np.cumsum(shared[side] < depth)
        both = interval[0] * (n + 1) + interval[1]
        order = np.argsort(both, kind="stable")
        begin = np.flatnonzero(np.diff(both[order], prepend=-1))
        low, high = np.minimum.reduceat(doc[order], begin), np.maximum.reduceat(doc[order], begin)
        hit = order[np.repeat(low < high, np.diff(np.append(begin, n)))]
        right[hit] = d
        left[hit] = np.maximum(left[hit], PASSAGE - d)
    ok = left >= 0
    return pd.DataFrame({"doc_id": doc[ok], "lo": at[ok] - left[ok], "hi": at[ok] + right[ok]})


def _dealt(contexts: DataFrame, shards: int) -> DataFrame:
    """What suffixes of the same key share; shards are bounded, as frequent keys are not here."""
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    distinct = contexts.select(shard, "*").dropDuplicates(["shard", "key", "doc_id", "at", "after", "before"])
    return distinct.groupBy("shard").applyInPandas(compare, "doc_id long, lo int, hi int")


def _passage_hashes(docs: DataFrame, found: Recurring) -> DataFrame:
    """one, two (128 bits of a passage's hash), doc_id, lo: every 50-word passage around the suffixes of
    frequent keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for p in portions(batch["text"]):
                text, at, _ = _chosen(p, found, True)
                if not len(at):
                    continue
                ends = np.cumsum(p.lengths)
                places = (at[:, None] - np.arange(SPREAD)).ravel()
                text = np.repeat(text, SPREAD)
                ok = (places >= (ends - p.lengths)[text]) & (places + PASSAGE <= ends[text])
                places, first = np.unique(places[ok], return_index=True)
                text = text[ok][first]
                one, two = window_hashes(p.hashes, PASSAGE)[places], window_hashes(mixed(p.hashes), PASSAGE)[places]
                lo = (places - (ends - p.lengths)[text]).astype(np.int32)
                yield pd.DataFrame({"one": one.view(np.int64), "two": two.view(np.int64), "doc_id": ids[p.rows[text]], "lo": lo})

    return docs.mapInPandas(run, "one long, two long, doc_id long, lo int")


def _frequent(docs: DataFrame, found: Recurring) -> DataFrame:
    """What the suffixes of frequent keys share. The join's left side may hold one passage very often; its
    right side, a written table, holds it once, so adaptive execution can split it."""
    hashed = _passage_hashes(docs, found)
    twice = hashed.groupBy("one", "two").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    hits = hashed.join(materialise(twice.select("one", "two")).hint("merge"), ["one", "two"])
    return hits.select("doc_id", "lo", (F.col("lo") + PASSAGE).alias("hi"))


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop (words, stop exclusive) of every maximal repeated passage; documents without
    one give no row."""
    texts = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    found = recurring(_keys(texts), HOT)
    spans = _dealt(_contexts(texts, found), max(8, found.rows // SHARD_ROWS))
    if found.hot:
        spans = spans.unionByName(_frequent(texts, found))
    # Islands of overlapping spans; a document's spans grow with its own length only.
    before = Window.partitionBy("doc_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    longest = spans.groupBy("doc_id", "lo").agg(F.max("hi").alias("hi"))
    opened = longest.withColumn("new", F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True)).cast("int"))
    islands = opened.withColumn("island", F.sum("new").over(upto)).groupBy("doc_id", "island")
    return islands.agg(F.min("lo").cast("long").alias("start"), F.max("hi").cast("long").alias("stop")).drop("island")


def passage_texts(docs: DataFrame) -> DataFrame:
    """The passages with their words."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    text = F.array_join(F.slice(words, (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")), " ")
    return passages(docs).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "start", "stop", text.alias("passage"))
