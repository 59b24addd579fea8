"""Helpers shared by the training-data operators: intermediate tables, word hashes, exact k-th values."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six (space, tab, LF, VT, FF, CR);
#: `bytes.split()` without arguments splits UTF-8 text in the same way.
WORD = r"[^\x20\x09-\x0D]+"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Local sessions, as in tests,
    get one; a cluster must name its own, as no executor sees another's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{tempfile.mkdtemp(prefix='spark-')}/shared"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: later reads neither recompute it nor
    depend on shuffle files of an executor that may be lost. The session names the codec, unless it is given."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Odd multiplier of the positional word hash, its inverse modulo 2^64, and bytes hashed at a time.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPAN = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, by doubling."""
    out = np.ones(n, np.uint64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        have, step = have + more, step * step % (1 << 64)
    return out


@functools.cache
def _letters(seed: int) -> np.ndarray:
    """A fixed random value for each byte; the space has 0."""
    out = np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    out[32] = 0
    return out


_SEED, _UP, _DOWN = 17, _powers(_BASE, _SPAN), _powers(_INVERSE, _SPAN)


def word_hashes(blob: bytes, starts: np.ndarray, seed: int = _SEED) -> np.ndarray:
    """64-bit hash of every word of a text whose words are joined by one space and start at `starts`: a
    positional sum over its bytes, scrambled. Equal words have equal hashes wherever they stand."""
    data = np.frombuffer(blob, np.uint8)
    letters, out, a = _letters(seed), np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        begin = int(starts[a])
        b = max(a + 1, int(np.searchsorted(starts, begin + _SPAN, "right")) - 1)
        if b == len(starts) - 1 and len(data) - begin <= _SPAN:
            b += 1
        end = len(data) if b == len(starts) else int(starts[b])
        if end - begin > _SPAN:  # one word that is longer than a portion
            out[a] = xxhash.xxh64_intdigest(data[begin:end].tobytes().rstrip(), seed - _SEED)
        else:
            at = starts[a:b] - begin
            values = letters[data[begin:end]] * _UP[: end - begin]
            out[a:b] = mixed(np.add.reduceat(values, at) * _DOWN[at])
        a = b
    return out


@dataclass
class Portion:
    """Texts laid end to end, all separators turned to spaces: their rows in the batch, numbers of words,
    the words' first bytes, and the words' hashes."""

    rows: np.ndarray
    lengths: np.ndarray
    blob: bytes
    starts: np.ndarray
    hashes: np.ndarray

    def stretch(self, first: int, stop: int) -> bytes:
        """Words first up to stop (exclusive), joined by one space."""
        end = len(self.blob) if stop == len(self.starts) else int(self.starts[stop])
        found = self.blob[self.starts[first] : end].rstrip(b" ")
        return b" ".join(found.split()) if b"  " in found else found


_TO_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def portions(texts: Iterable[bytes | None], size: int = 1 << 18) -> Iterator[Portion]:
    """All texts (null: empty), some bytes at a time: numpy calls then cost little even where texts are
    short. A text is never split between portions."""
    parts, first, held = [], 0, 0

    def laid() -> Portion:
        blob = b" ".join(parts).translate(_TO_SPACES)
        inside = np.concatenate([[False], np.frombuffer(blob, np.uint8) != 32])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        lengths = np.diff(np.searchsorted(starts, ends), prepend=0)
        return Portion(np.arange(first, first + len(parts)), lengths, blob, starts, word_hashes(blob, starts))

    for text in texts:
        parts.append(text or b"")
        held += len(parts[-1]) + 1
        if held >= size:
            yield laid()
            parts, first, held = [], first + len(parts), 0
    if parts:
        yield laid()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of `h`; empty when there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc = (acc ^ (acc >> np.uint64(29))) * _MIX + h[j : j + n]
    return mixed(acc)


def sliding(fn, x: np.ndarray, width: int) -> np.ndarray:
    """`fn` (np.minimum or np.maximum) over every `width` consecutive entries, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = fn(out[:-step], out[step:])
        have += step
    return out


def minimisers(h: np.ndarray, width: int, valid: np.ndarray | None = None) -> np.ndarray:
    """Positions that hold the smallest value of some window of `width` entries (all positions that
    tie), of windows where `valid` says so. Equal stretches of two texts choose equal positions."""
    if len(h) < width:
        return np.empty(0, np.int64)
    low = sliding(np.minimum, h, width)
    valid = np.ones(len(low), bool) if valid is None else valid
    edge = np.zeros(width - 1, np.uint64)
    # The largest of the smallest values of the windows around a position, and whether any of them counts.
    most = sliding(np.maximum, np.concatenate([edge, np.where(valid, low, edge.dtype.type(0)), edge]), width)
    covered = sliding(np.maximum, np.concatenate([edge > 0, valid, edge > 0]), width)
    return np.flatnonzero((most == h) & covered)


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> float | None:
    """The exact k-th largest value of a double column, found by narrowing a histogram; the driver
    sees `bins` counts a round, whatever the number of rows. None when there are fewer than k rows."""
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k <= 0 or n < k:
        return None
    above = 0
    while low < high:
        step = (high - low) / bins
        slot = F.least(F.lit(bins - 1), F.floor((F.col(col) - F.lit(low)) / F.lit(step)).cast("int"))
        if step <= 0 or low + step == low:
            break
        part = df.where(F.col(col).between(low, high)).groupBy(slot.alias("slot"))
        rows = part.agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["slot"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    return high
