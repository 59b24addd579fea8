"""Phrase collocation mining with double-array tries.

Texts become arrays of word identities (64-bit hashes of language and word), 0 standing between pieces, and
are written once, in short rows, so that batches stay small. Words with enough occurrences, then windows of
two, three and four of them, are counted by a 32-bit key of the window; the frequent keys form bit filters,
which let windows pass by mistake at times but never lose one. Observed windows of two to five words all of whose shorter windows pass are the candidates:
no other phrase can be frequent. They are dealt to double-array tries of bounded size, which are broadcast;
numpy moves the states of all places of a text on together, one word a level, and adds up the accepting
states. The sums of all tasks are the numbers of occurrences, overlaps included. What tasks have counted goes
to the sums as packed arrays, cut into a fixed number of slices, not as a row for each key.

Every phrase with at least `least` occurrences is cut after each of its words; the lowest cut counts. All
arithmetic is in whole numbers, decimals of 38 digits where 64 bits would not do.

A null text is empty; a null language is `und`; texts without words, repeated rows and very long texts need
no care; an empty table gives an empty result; other columns are ignored. Ties in a ranking go by number of
occurrences, then by the phrase's bytes. Word identities are checked against the words: should two words
ever meet in one, all is done again with another hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.base import materialise, mixed, word_hashes
from rasterloom.llm.recurring import bit_filter, passes

LEAST, LONGEST, SHARE, TOP = 100, 5, 100, 2000
#: Bytes of text laid out together, words in a written row (and those up to the end of a piece), windows
#: gathered before they are counted, phrases in a trie, bytes of tries that one pass over the corpus carries,
#: and slices in which a language is ranked first.
PORTION, ROW, WINDOWS, PHRASES, CARRIED, SLICES = 1 << 21, 128, 1 << 19, 1 << 18, 1 << 26, 64
#: Bits of a key that name its slice, and bits of a state within its slice.
KEY_SLICE, STATE_SLICE = 8, 14

_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: A-Z lower-cased, ends of pieces as line feeds, blanks as spaces.
_CLEAN = bytes(10 if b in _ENDS else 32 if b in _BLANKS else b for b in bytes(range(256)).lower())
_JOINED = bytes.maketrans(b"\n", b" ")
_ODD = np.uint64(0x9FB21C651E98DF25)
TOKENS = "ids binary, lang string, heads array<long>, words array<string>, times array<long>"


def _laid(texts: list[bytes], lang: str, seed: int) -> tuple:
    """Identities of all words of some texts of a language, 0 before each piece, and the distinct ones with
    their words and numbers."""
    blob = b"\n".join(texts).translate(_CLEAN)
    data = np.frombuffer(blob, np.uint8)
    inside = np.concatenate([[False], (data != 10) & (data != 32), [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    salt = np.uint64(xxhash.xxh64_intdigest(lang.encode(), seed))
    ids = np.maximum(mixed(word_hashes(blob.translate(_JOINED), starts, seed) ^ salt), np.uint64(1))
    piece = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.diff(piece, prepend=-1) > 0
    out = np.zeros(len(ids) + int(new.sum()), np.uint64)
    out[np.arange(len(ids)) + np.cumsum(new)] = ids
    heads, first, at, times = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
    lengths, lead = ends - starts, first[at]
    if (lengths == lengths[lead]).all():
        bytes_ = np.flatnonzero(inside[1:-1])
        if (data[bytes_] == data[bytes_ + np.repeat(starts[lead] - starts, lengths)]).all():
            words = [blob[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            return out, heads.view(np.int64), words, times
    # Different words in one identity: all of them are told.
    told = Counter((i, blob[a:b].decode()) for i, a, b in zip(ids.view(np.int64).tolist(), starts.tolist(), ends.tolist()))
    return out, np.array([i for i, _ in told], np.int64), [w for _, w in told], np.array(list(told.values()))


def _rows(x: np.ndarray) -> list[bytes]:
    """Identities cut before the first 0 from every `ROW` words on; each part begins with 0."""
    gaps = np.flatnonzero(x == 0)
    cuts = np.searchsorted(gaps, np.arange(ROW, len(x), ROW))
    at = [0, *gaps[np.unique(cuts[cuts < len(gaps)])].tolist(), len(x)]
    return [x[a:b].tobytes() for a, b in zip(at, at[1:]) if b > a]


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """The written rows laid together, up to a portion at a time."""
    for batch in batches:
        held, size = [], 0
        for ids in batch["ids"]:
            held.append(ids)
            size += len(ids)
            if size >= PORTION:
                yield np.frombuffer(b"".join(held), np.uint64)
                held, size = [], 0
        if held:
            yield np.frombuffer(b"".join(held), np.uint64)


def tokens(docs: DataFrame, seed: int) -> DataFrame:
    """Rows of word identities, 0 between pieces, and rows of the words of a portion of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang", sort=True)["text"]:
                held, size = [], 0
                for text in [*group, None]:
                    if text is not None:
                        held.append(text)
                        size += len(text)
                    if held and (text is None or size >= PORTION):
                        x, heads, words, times = _laid(held, lang, seed)
                        rows = _rows(x)
                        yield pd.DataFrame({"ids": rows, "lang": None, "heads": None, "words": None, "times": None})
                        if len(heads):
                            yield pd.DataFrame([(None, lang, heads, words, times)], columns=["ids", "lang", "heads", "words", "times"])
                        held, size = [], 0

    lang, text = F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return docs.select(lang, text).mapInPandas(run, TOKENS)


def vocabulary(table: DataFrame) -> DataFrame:
    """id, lang, word and n of every word."""
    each = table.where("ids is null").select("lang", F.explode(F.arrays_zip("heads", "words", "times")).alias("w"))
    return each.select(F.col("w.heads").alias("id"), "lang", F.col("w.words").alias("word"), F.col("w.times").alias("n")).groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(written tokens, written vocabulary), with an identity for each word of a language."""
    seed = 17
    while True:
        table = materialise(tokens(docs, seed))
        words = materialise(vocabulary(table))
        if words.groupBy("id").count().where("count > 1").isEmpty():
            return table, words
        seed += 1


def _short(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.uint32)


def _spread(short: np.ndarray) -> np.ndarray:
    """Short keys as well mixed 64-bit keys, for bit filters."""
    return mixed(short.astype(np.uint64)).view(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes, first those of lowest value, so that sorted and small numbers compress."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _flat(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _slices(of: np.ndarray, *arrays: np.ndarray) -> pd.DataFrame:
    """Rows (slice, packed arrays): arrays cut where the sorted slice numbers change."""
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    rows = [(int(of[a]), *[_planes(x[a:b]) for x in arrays]) for a, b in zip(cuts, [*cuts[1:], len(of)])]
    return pd.DataFrame(rows, columns=["slice", *"abc"[: len(arrays)]])


def _folded(packed: DataFrame, add, finish, schema: str) -> DataFrame:
    """All rows of a slice meet in one task, where `add` folds them one by one into what is held, and `finish`
    makes rows of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                held[row[0]] = add(held.get(row[0]), *row[1:])
        for of, state in held.items():
            yield from finish(of, state)

    n = min(1 << KEY_SLICE, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return packed.repartition(n, "slice").mapInPandas(run, schema)


def _windows(x: np.ndarray, filters: list[np.ndarray], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, 64-bit keys) of the windows of 2, 3, ... `longest` words all of whose shorter windows pass; the
    filters are those of 1, 2, ... words, and the last windows may have none of their own."""
    at = np.flatnonzero(x)
    at = at[passes(x[at].view(np.int64), filters[0])]
    keys = x[at]
    for size in range(2, longest + 1):
        both = np.flatnonzero(at[1:] == at[:-1] + 1)
        at = at[both]
        keys = mixed((keys[both] + np.uint64(size)) * _ODD + x[at + size - 1])
        if size <= len(filters):
            ok = passes(_spread(_short(keys)), filters[size - 1])
            at, keys = at[ok], keys[ok]
        yield at, keys


def frequent_keys(table: DataFrame, filters: list[Broadcast], least: int) -> DataFrame:
    """key, spread, of the windows one word longer than the filters that occur often enough. Short keys bound
    what a slice can hold: 2^24 numbers."""

    def counted(held: list[np.ndarray]) -> pd.DataFrame:
        keys, n = np.unique(_short(np.concatenate(held)), return_counts=True)
        return _slices((keys >> np.uint32(32 - KEY_SLICE)).astype(np.int64), keys, n.astype(np.uint32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, size = [f.value for f in filters], [], 0
        for x in _joined(batches):
            *_, (_, keys) = _windows(x, known, len(known) + 1)
            held.append(keys)
            size += len(keys)
            if size >= WINDOWS:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return [(keys, np.minimum(np.bincount(at, np.concatenate([n for _, n in parts])), least).astype(np.uint32))]

    def add(parts, keys: bytes, n: bytes):
        parts = [*(parts or []), (_flat(keys, np.uint32), _flat(n, np.uint32))]
        return added(parts) if sum(len(k) for k, _ in parts[1:]) > len(parts[0][0]) + (1 << 16) else parts

    def finish(_, parts) -> Iterator[pd.DataFrame]:
        keys, n = added(parts)[0]
        yield pd.DataFrame({"key": _spread(keys[n >= least])})

    packed = table.where("ids is not null").select("ids").mapInPandas(run, "slice long, a binary, b binary")
    return _folded(packed, add, finish, "key long")


def candidates(table: DataFrame, filters: list[Broadcast], longest: int) -> DataFrame:
    """ids of the distinct windows of 2 up to `longest` words all of whose shorter windows pass."""

    def distinct(rows: np.ndarray) -> np.ndarray:
        """Distinct rows of `longest` identities, 0 behind the last."""
        whole = np.ascontiguousarray(rows).view(f"V{8 * longest}").ravel()
        return np.unique(whole).view(np.uint64).reshape(-1, longest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = [f.value for f in filters], [np.empty(0, np.uint64) for _ in range(longest - 1)]
        for x in _joined(batches):
            for depth, (at, keys) in enumerate(_windows(x, known, longest)):
                # What this task has passed on lately need not be passed on again.
                new, first = np.unique(keys, return_index=True)
                fresh = ~np.isin(new, seen[depth], assume_unique=True)
                new, first = new[fresh], first[fresh]
                seen[depth] = new if len(seen[depth]) > WINDOWS else np.concatenate([seen[depth], new])
                if len(new):
                    rows = np.zeros((len(new), longest), np.uint64)
                    rows[:, : depth + 2] = x[at[first][:, None] + np.arange(depth + 2)]
                    yield _slices((new >> np.uint64(64 - KEY_SLICE)).astype(np.int64), rows)

    def add(parts, rows: bytes):
        parts = [*(parts or []), _flat(rows, f"V{8 * longest}").view(np.uint64).reshape(-1, longest)]
        return [distinct(np.concatenate(parts))] if sum(map(len, parts[1:])) > len(parts[0]) + (1 << 14) else parts

    def finish(_, parts) -> Iterator[pd.DataFrame]:
        rows = distinct(np.concatenate(parts))
        sizes = (rows != 0).sum(1)
        for a in range(0, len(rows), 20_000):
            yield pd.DataFrame({"ids": [r[:n] for r, n in zip(rows[a : a + 20_000].view(np.int64), sizes[a : a + 20_000])]})

    packed = table.where("ids is not null").select("ids").mapInPandas(run, "slice long, a binary")
    return _folded(packed, add, finish, "ids array<long>")


@dataclass
class Trie:
    """Double-array trie over 64-bit symbols: symbol c leads from state s to base[s] + c, if check there is
    s. Symbols are numbered from 1 by their place in `symbols`; state 0 is the root."""

    symbols: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        if not len(self.symbols):
            return np.zeros(len(x), np.int32)
        at = np.minimum(np.searchsorted(self.symbols, x), len(self.symbols) - 1)
        return np.where(self.symbols[at] == x, at + 1, 0).astype(np.int32)

    def counts(self, x: np.ndarray, longest: int) -> np.ndarray:
        """How often each accepting state is reached from any place of x: the states of all places move on
        together, a level at a time."""
        code = np.concatenate([self.codes(x), np.zeros(longest, np.int32)])
        at = np.flatnonzero(code)
        state, out = np.zeros(len(at), np.int32), np.zeros(len(self.base), np.int64)
        for depth in range(longest):
            c = code[at + depth]
            to = self.base[state] + c
            ok = (c > 0) & (self.check[to] == state)
            at, state = at[ok], to[ok]
            out += np.bincount(state[self.accept[state]], minlength=len(out))
        return out

    def phrase(self, state: int) -> np.ndarray:
        found = []
        while state:
            above = int(self.check[state])
            found.append(self.symbols[state - int(self.base[above]) - 1])
            state = above
        return np.array(found[::-1], np.uint64).view(np.int64)


def build(phrases: list[np.ndarray]) -> Trie:
    """The trie of distinct phrases. States with several children take the first gap where all of them fit,
    those with most children first; only children fill what is left."""
    symbols = np.unique(np.concatenate(phrases)) if phrases else np.empty(0, np.uint64)
    sizes = np.array([len(p) for p in phrases], np.int64)
    table = np.zeros((len(phrases), int(sizes.max(initial=1))), np.int64)
    for i, p in enumerate(phrases):
        table[i, : len(p)] = np.searchsorted(symbols, p) + 1
    order = np.lexsort(table.T[::-1])
    table, sizes = table[order], sizes[order]
    # Nodes of a level are the distinct beginnings of that length; a node's number grows by level.
    above, parent, code, ends, n = np.zeros(len(table), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], 1
    changed = np.arange(len(table)) == 0
    for depth in range(table.shape[1]):
        changed[1:] |= table[1:, depth] != table[:-1, depth]
        live = sizes > depth
        new = live & changed
        node = np.where(live, n - 1 + np.cumsum(new), 0)
        parent.append(above[new])
        code.append(table[new, depth])
        ends.append(node[sizes == depth + 1])
        above, n = np.where(live, node, above), n + int(new.sum())
    parent, code = np.concatenate(parent), np.concatenate(code)
    slot, base = np.zeros(n, np.int64), np.zeros(n, np.int64)
    used = np.zeros(4 * n + 2 * len(symbols) + 256, bool)
    used[0] = True
    by = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[by], np.arange(n + 1))
    degree, from_ = np.diff(first), 0
    many = np.flatnonzero(degree > 1)
    for p in many[np.argsort(-degree[many], kind="stable")].tolist():
        own = by[first[p] : first[p + 1]]
        c = code[own]
        while True:
            if from_ + 64 + len(symbols) >= len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
            fits = ~used[from_ + np.arange(64)[:, None] + c].any(1)
            if fits.any():
                break
            from_ += 64
        base[p] = from_ + int(fits.argmax())
        slot[own + 1] = base[p] + c
        used[base[p] + c] = True
    single = by[first[:-1][degree == 1]]
    # Gaps beyond the number of symbols, so that no base is negative.
    if len(used) < 2 * len(symbols) + 2 * n + 256:
        used = np.concatenate([used, np.zeros(2 * len(symbols) + 2 * n, bool)])
    gaps = len(symbols) + 1 + np.flatnonzero(~used[len(symbols) + 1 :])
    if len(gaps) < len(single):
        gaps = np.concatenate([gaps, len(used) + np.arange(len(single))])
    slot[single + 1] = gaps[: len(single)]
    base[parent[single]] = gaps[: len(single)] - code[single]
    size = int(max(base.max(initial=0), slot.max(initial=0))) + len(symbols) + 2
    bases, check, accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size, bool)
    bases[slot] = base
    check[slot[1:]] = slot[parent]
    if len(phrases):
        accept[slot[np.concatenate(ends)]] = True
    return Trie(symbols, bases, check, accept)


def tries(phrases: DataFrame, n: int, size: int) -> DataFrame:
    """Written tries of about `size` of the n phrases each, as rows of their arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.asarray(p, np.int64).view(np.uint64) for batch in batches for p in batch["ids"]]
        if held:
            t = build(held)
            yield pd.DataFrame([(t.symbols.tobytes(), t.base.tobytes(), t.check.tobytes(), t.accept.tobytes())], columns=["symbols", "base", "check", "accept"])

    dealt = phrases.repartitionByRange(max(1, -(-n // size)), "ids")
    return materialise(dealt.mapInPandas(run, "symbols binary, base binary, check binary, accept binary"))


def occurrences(table: DataFrame, written: DataFrame, longest: int) -> DataFrame:
    """ids and f, the number of occurrences of every phrase of the tries: as many tries as `CARRIED` bytes
    hold are broadcast together, each portion in a pass of its own over the corpus."""
    found: list[DataFrame] = []
    held: list[tuple] = []

    def counted() -> None:
        shared = table.sparkSession.sparkContext.broadcast(held.copy())

        def tries_() -> list[Trie]:
            return [Trie(*(np.frombuffer(b, k) for b, k in zip(arrays, (np.uint64, np.int32, np.int32, bool)))) for arrays in shared.value]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = tries_()
            sums = [np.zeros(len(t.base), np.int64) for t in known]
            for x in _joined(batches):
                for t, total in zip(known, sums):
                    total += t.counts(x, longest)
            for i, total in enumerate(sums):
                at = np.flatnonzero(total)
                if len(at):
                    yield _slices((i << 32) + (at >> STATE_SLICE), at & ((1 << STATE_SLICE) - 1), total[at])

        def add(total, at: bytes, n: bytes):
            total = np.zeros(1 << STATE_SLICE, np.int64) if total is None else total
            total[_flat(at, np.int64)] += _flat(n, np.int64)
            return total

        def finish(of: int, total: np.ndarray) -> Iterator[pd.DataFrame]:
            trie, at = tries_()[of >> 32], np.flatnonzero(total)
            first = (of & ((1 << 32) - 1)) << STATE_SLICE
            yield pd.DataFrame({"ids": [trie.phrase(first + s) for s in at.tolist()], "f": total[at]})

        packed = table.where("ids is not null").select("ids").mapInPandas(run, "slice long, a binary, b binary")
        found.append(materialise(_folded(packed, add, finish, "ids array<long>, f long")))

    for row in written.toLocalIterator():
        if held and sum(map(len, [b for r in held for b in r])) + sum(map(len, row)) > CARRIED:
            counted()
            held.clear()
        held.append(tuple(bytes(b) for b in row))
    if held:
        counted()
    out = found[0] if found else table.sparkSession.createDataFrame([], "ids array<long>, f long")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def frequent_phrases(table: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """ids and f of every phrase of one up to `longest` words with at least `least` occurrences."""
    frequent = materialise(words.where(F.col("n") >= least).select(F.col("id").alias("key"), "n"))
    filters = [bit_filter(frequent.select("key"))[0]]
    while len(filters) < longest - 1:
        filters.append(bit_filter(materialise(frequent_keys(table, filters, least)))[0])
    phrases = materialise(candidates(table, filters, longest))
    counted = occurrences(table, tries(phrases, phrases.count(), PHRASES), longest).where(F.col("f") >= least)
    return frequent.select(F.array("key").alias("ids"), F.col("n").alias("f")).unionByName(counted)


def _whole(c: str) -> str:
    return f"cast({c} as decimal(19, 0))"


def scored(found: DataFrame, heads: DataFrame) -> DataFrame:
    """ids, lang, a, l, r, n and score of every phrase of two words on: the lowest of its cuts."""
    first = heads.select(F.col("id").alias("head"), "lang", "total")
    cuts = found.where(F.size("ids") > 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.select("ids", F.col("f").alias("a"), "k", F.expr("slice(ids, 1, k)").alias("left"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(found.select(F.col("ids").alias(side), F.col("f").alias(name)), side)
    cuts = cuts.withColumn("head", F.col("ids")[0]).join(first, "head").withColumnRenamed("total", "n")
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {_whole('a')} * {_whole('n')}) div ({_whole('l')} * {_whole('r')})").cast("long")
    best = cuts.groupBy("ids").agg(F.min(F.struct(score.alias("score"), "k", "lang", "a", "l", "r", "n")).alias("cut"))
    return best.select("ids", "cut.lang", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def kept(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """Phrases that are not mostly part of a longer one: no longer phrase that holds one's words side by
    side has `share` hundredths of its occurrences."""
    inner = "flatten(transform(sequence(2, size(ids) - 1), s -> transform(sequence(1, size(ids) - s + 1), i -> slice(ids, i, s))))"
    parts = phrases.where(F.size("ids") > 2).select(F.explode(F.array_distinct(F.expr(inner))).alias("ids"), F.col("a").alias("longer"))
    most = parts.groupBy("ids").agg(F.max("longer").alias("longer"))
    return phrases.join(most, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def named(phrases: DataFrame, heads: DataFrame) -> DataFrame:
    """Adds `phrase`, the words joined by spaces."""
    each = phrases.select("ids", F.posexplode("ids").alias("at", "id")).join(heads.select("id", "word"), "id")
    words = each.groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    return phrases.join(words.select("ids", F.array_join("words.word", " ").alias("phrase")), "ids")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first of each language, ranked by slices before they are ranked together."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = phrases.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    for keys in (["lang", "slice"], ["lang"]):
        sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return sliced.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    table, words = identified(docs)
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    heads = materialise(words.where(F.col("n") >= least).join(total, "lang").select("id", "lang", "word", "total"))
    found = materialise(frequent_phrases(table, words, least, longest))
    return ranked(named(kept(materialise(scored(found, heads)), share), heads), top)


#: The same rows in DuckDB: all runs of up to five words counted as strings.
ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), sized AS (SELECT lang, words, unnest(range(1, {LONGEST + 1})) AS k FROM listed WHERE len(words) > 0
), placed AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM sized WHERE len(words) >= k
), counted AS (
  SELECT lang, words[i:i + k - 1] AS words, k, count(*) AS f FROM placed GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
), found AS (SELECT * FROM counted WHERE f >= {LEAST}
), cuts AS (
  SELECT c.lang, c.words, c.f AS a, x.f AS l, y.f AS r, t.n, j,
         CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM found WHERE k > 1) c
  JOIN found x ON x.lang = c.lang AND x.words = c.words[1:j]
  JOIN found y ON y.lang = c.lang AND y.words = c.words[j + 1:c.k]
  JOIN totals t ON t.lang = c.lang
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1
), inner_ AS (
  SELECT lang, words[i:i + s - 1] AS words, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM found WHERE k > 2)) GROUP BY ALL
), kept AS (
  SELECT s.lang, array_to_string(s.words, ' ') AS phrase, a, l, r, n, score
  FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.words = s.words
  WHERE i.longer IS NULL OR 100 * i.longer < {SHARE} * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= {TOP}
"""
