"""Sets of 64-bit keys as bit filters of bounded size, and which keys occur in several documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.base import materialise

#: The filter takes 16 bits per key, within these powers of two (8 KB to 64 MB). A fuller filter lets
#: more keys pass that occur once; it never loses one that recurs.
LEAST_BITS, MOST_BITS = 16, 29
_CHUNK_BITS = 16


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.view(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(64 - bits)) & mask).astype(np.int64)


def passes(keys: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys may recur."""
    if not len(keys):
        return np.empty(0, bool)
    a, b = _places(keys, (len(filter_) * 8).bit_length() - 1)
    hit = lambda p: (filter_[p >> 3] >> (p & 7).astype(np.uint8)) & 1
    return (hit(a) & hit(b)).astype(bool)


@dataclass
class Recurring:
    """Filters of the keys that occur in several documents and, of those, the ones with more than a given
    number of occurrences; `rows` adds up occurrences, each key's to that number at most, and `hot` those
    of the frequent keys."""

    filter: Broadcast
    hot_filter: Broadcast
    rows: int
    hot: int


def recurring(keyed: DataFrame, hot_from: int) -> Recurring:
    """The recurring keys of rows (key, doc_id), counted by Spark."""
    seen = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    seen = materialise(seen.where("low < high").select("key", "n"))
    most = F.lit(hot_from)
    hot = F.col("n") > most
    total = seen.agg(F.sum(F.least("n", most)).alias("rows"), F.sum(F.when(hot, F.col("n"))).alias("hot")).first()
    return Recurring(bit_filter(seen.select("key"))[0], bit_filter(seen.where(hot).select("key"))[0], total["rows"] or 0, total["hot"] or 0)


def recurring_filter(keyed: DataFrame) -> tuple[Broadcast, int]:
    """(broadcast filter, number of recurring keys) of rows (key, doc_id), counted by Spark."""
    seen = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return bit_filter(materialise(seen.where("low < high").select("key")))


def bit_filter(keys: DataFrame) -> tuple[Broadcast, int]:
    """(broadcast filter, number of keys) of distinct, well mixed keys; `keys` is read twice, so it should
    be a written table. The driver joins chunks of bits, at most 64 MB in all, whatever the number of keys."""
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (max(n, 1) * 16 - 1).bit_length()))
    mask = (1 << bits) - 1
    low = F.col("key").bitwiseAND(F.lit(mask))
    high = F.shiftrightunsigned("key", 64 - bits).bitwiseAND(F.lit(mask))
    # Distinct places bound what a chunk receives, however many keys there are.
    places = keys.select(F.explode(F.array(low, high)).alias("place")).distinct()
    chunked = places.select(F.shiftright("place", _CHUNK_BITS).alias("chunk"), F.col("place").bitwiseAND(F.lit((1 << _CHUNK_BITS) - 1)).cast("int").alias("bit"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << _CHUNK_BITS, np.uint8)
        on[part["bit"]] = 1
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << _CHUNK_BITS) // 8
    for r in chunked.groupBy("chunk").applyInPandas(build, "chunk long, bits binary").collect():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out), n
