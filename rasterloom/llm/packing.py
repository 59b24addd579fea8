"""Best-fit packing by patterns.

Texts become token ids with an end mark; only what exceeds a sequence is cut. The histogram of piece
lengths, at most one entry per possible length, is all the driver sees: it enumerates patterns of few
lengths that fill a sequence, fits their repeat counts to the histogram by non-negative least squares,
rounds, and packs the remaining counts best fit, longest first. Pieces then find their place by their
rank among the pieces of equal length.

A null text is empty (its end mark alone is packed); repeated rows are packed once each; equal lengths
are ranked by a hash of doc_id and piece, so that reruns agree; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.base import materialise

LENGTH = 2048
END = 0
#: Text of the vocabulary's one special token, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Lengths at most that take part in enumerated triples as their shortest.
TRIPLE_LENGTHS = 48

_ENCODERS: dict[str, object] = {}


def _encoder(path: str, pattern: str):
    """The vocabulary as a fast encoder; read once per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def vocabulary() -> tuple[str, str]:
    """Path of the byte-level vocabulary and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(text: str | None, encoder) -> np.ndarray:
    """Ids of a text, without its end mark."""
    parts = (text or "").split(SPECIAL)
    ids = [encoder.encode_to_numpy(parts[0], disallowed_special=())]
    for part in parts[1:]:
        ids += [np.array([SPECIAL_ID]), encoder.encode_to_numpy(part, disallowed_special=())]
    return (np.concatenate(ids) if len(ids) > 1 else ids[0]).astype("<u4")


def pieces(docs: DataFrame, length: int = LENGTH, vocab: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    vocab = vocab or vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(*vocab)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encode(text, encoder), np.array([END], "<u4"))
                first = (len(ids) - 1) % length + 1
                for i, start in enumerate([0, *range(first, len(ids), length)]):
                    part = ids[start : first if i == 0 else start + length]
                    rows.append((doc, i, start, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(counts: np.ndarray, length: int) -> np.ndarray:
    """Rows of three lengths (0: none), descending, that fill a sequence exactly: one, two or three
    lengths that occur. Triples are enumerated over the commonest short lengths."""
    have = np.flatnonzero(counts[: length + 1])
    found = [np.array([[length, 0, 0]])] if counts[length] else []
    low = have[(have <= length // 2) & (have > 0)]
    low = low[counts[length - low] > 0]
    found.append(np.stack([length - low, low, 0 * low], 1))
    short = have[(have <= length // 3) & (have > 0)]
    for c in sorted(short[np.argsort(-counts[short], kind="stable")][:TRIPLE_LENGTHS]):
        b = have[(have >= c) & (have <= (length - c) // 2)]
        b = b[counts[length - c - b] > 0]
        found.append(np.stack([length - c - b, b, 0 * b + c], 1))
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def fit_repeats(rows: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x that minimises |A x - counts|^2, A holding how often a pattern uses a length, by
    multiplicative updates (A and counts are non-negative, so x stays so)."""
    target = counts.astype(np.float64).copy()
    target[0] = 0
    used = rows > 0
    x = np.where(used, target[rows], np.inf).min(1) / 2 if len(rows) else np.empty(0)
    numerator = (target[rows] * used).sum(1)
    for _ in range(rounds if len(rows) else 0):
        made = np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), len(target))
        x = x * numerator / np.maximum((made[rows] * used).sum(1), 1e-12)
    return x


def plan(counts: np.ndarray, length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) that use up the histogram exactly."""
    left, out = counts.astype(np.int64).copy(), []
    rows = patterns(counts, length)
    x = fit_repeats(rows, counts)
    for i in np.argsort(-x, kind="stable"):
        lens, mult = np.unique(rows[i][rows[i] > 0], return_counts=True)
        n = int(min(np.rint(x[i]), (left[lens] // mult).min()))
        if n > 0:
            left[lens] -= n * mult
            out.append((n, tuple(int(v) for v in rows[i] if v)))
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for size in range(length, 0, -1):
        todo = int(left[size])
        while todo:
            spaces = [s for s in open_ if s >= size]
            space = min(spaces, default=length)
            n, held = open_[space].pop() if spaces else (todo, ())
            if spaces and not open_[space]:
                del open_[space]
            each = space // size
            full = min(n, todo // each)
            if full:
                open_.setdefault(space - each * size, []).append((full, held + (size,) * each))
                todo -= full * each
            if full < n and held:
                part = min(todo, each) if todo < each else 0
                if part:
                    open_.setdefault(space - part * size, []).append((1, held + (size,) * part))
                    todo -= part
                if n - full - (part > 0) > 0:
                    open_.setdefault(space, []).append((n - full - (part > 0), held))
            elif full < n and todo:
                open_.setdefault(space - todo * size, []).append((1, (size,) * todo))
                todo = 0
    return out + [group for groups in open_.values() for group in groups]


def places(planned: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Columns length, first rank, first sequence, pieces of that length per sequence, offset; sorted."""
    rows, used, sequence = [], {}, 0
    for n, lens in planned:
        offset = 0
        for size in sorted(set(lens), reverse=True):
            each = lens.count(size)
            rows.append((size, used.get(size, 0), sequence, each, offset))
            used[size] = used.get(size, 0) + n * each
            offset += each * size
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(found: DataFrame, n: int) -> DataFrame:
    """Adds `rank` among the pieces of equal length: a running count over hash slices of a few thousand
    rows plus a rank inside the slice, so that a common length never meets in one task. Slices go by the
    number of the row: repeated documents, and those without an id, spread as well."""
    slices = max(1, n // 4096)
    cut = found.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("length", "slice").agg(F.count("*").alias("n"))
    bases = bases.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "slice").orderBy("row")
    return (
        cut.withColumn("inside", F.row_number().over(inside) - 1)
        .join(bases, ["length", "slice"])
        .withColumn("rank", F.col("base") + F.col("inside"))
        .drop("slice", "base", "inside")
    )


def pack(docs: DataFrame, length: int = LENGTH, vocab: tuple[str, str] | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    found = materialise(pieces(docs, length, vocab).withColumn("row", F.monotonically_increasing_id()))
    counts = np.zeros(length + 1, np.int64)
    for r in found.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    table = docs.sparkSession.sparkContext.broadcast(places(plan(counts, length)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = table.value
        keys = at[:, 0] * (1 << 50) + at[:, 1]
        for batch in batches:
            size, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = at[np.searchsorted(keys, size * (1 << 50) + rank, "right") - 1]
            step = rank - row[:, 1]
            batch["sequence_id"] = row[:, 2] + step // row[:, 3]
            batch["offset"] = row[:, 4] + step % row[:, 3] * size
            yield batch.drop(columns="rank")

    kind = found.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(found, int(counts.sum())).select(*columns).mapInPandas(place, schema)
