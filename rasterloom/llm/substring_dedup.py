"""Substring dedup by repeated-phrase automata.

A window is 13 consecutive words. Each window names an anchor, its smallest 5-word hash, so equal
windows name equal anchors. Anchors that occur in several documents are found first and put in a bit
filter of bounded size; stretches of text around such anchors are dealt by anchor to shards. Anchors
with very many occurrences are dealt window by window instead, by the window's own hash, so that no
shard grows with one phrase. A shard confirms the passages that recur, compiles them into an
Aho-Corasick automaton over words, streams every distinct stretch through it, and so learns of each
window the first document. Every occurrence of a stretch then takes over what was located in it, and
words under windows known from a smaller doc_id go.

Null texts hold no words; texts under 13 words keep all; repeated rows with the same id do not remove
each other, nor do rows without an id, which keep all their words; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.base import mixed, portions, sliding, window_hashes
from rasterloom.llm.recurring import Recurring, passes, recurring

WINDOW, ANCHOR = 13, 5
#: Occurrences from which an anchor is dealt by window, and stretches expected in a shard; an automaton
#: holds the recurring passages of one shard.
HOT, SHARD_ROWS = 20_000, 20_000


def runs(lengths: np.ndarray, h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, first window, last window) of every run of neighbouring windows with the same anchor,
    at most as many as a window has anchors, over texts laid end to end: their numbers of words and word
    hashes; windows are places in the whole."""
    span = window - ANCHOR + 1
    low = sliding(np.minimum, window_hashes(h, ANCHOR), span) if len(h) >= window else np.empty(0, np.uint64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.flatnonzero(text[: len(low)] == text[window - 1 :]) if len(low) else np.empty(0, np.int64)
    if not len(inside):
        return inside, low[inside], inside, inside
    key = low[inside]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (inside[1:] != inside[:-1] + 1)])
    begins = np.flatnonzero(new)
    along = np.arange(len(inside)) - np.repeat(begins, np.diff(np.append(begins, len(inside))))
    begin = np.flatnonzero(along % span == 0)
    first, last = inside[begin], inside[np.append(begin[1:], len(inside)) - 1]
    return text[first], key[begin], first, last


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for p in portions(batch["text"]):
                text, key, _, _ = runs(p.lengths, p.hashes)
                yield pd.DataFrame({"key": key.view(np.int64), "doc_id": ids[p.rows[text]]})

    return docs.mapInPandas(run, "key long, doc_id long")


def _candidates(p, found: Recurring) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, first window, last window) of the runs whose anchor may recur; runs of frequent anchors
    fall apart into windows, each under its own hash."""
    text, key, first, last = runs(p.lengths, p.hashes)
    ok = passes(key, found.filter.value)
    text, key, first, last = text[ok], key[ok], first[ok], last[ok]
    hot = passes(key, found.hot_filter.value) if found.hot else np.zeros(len(key), bool)
    if not hot.any():
        return text, key, first, last
    each = (last - first + 1)[hot]
    windows = np.repeat(first[hot], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    own = window_hashes(p.hashes, WINDOW)[windows]
    cool = ~hot
    join = lambda a, b: np.concatenate([a, b])
    return join(text[cool], np.repeat(text[hot], each)), join(key[cool], own), join(first[cool], windows), join(last[cool], windows)


def _stretches(docs: DataFrame, found: Recurring, with_text: bool) -> DataFrame:
    """Stretches around anchors that may recur: their text with its smallest and largest document in
    the batch, or the digest of the text with the place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, marks = batch["doc_id"].to_numpy(), batch["mark"].to_numpy()
            low: dict[tuple[int, bytes], int] = {}
            high: dict[tuple[int, bytes], int] = {}
            for p in portions(batch["text"]):
                text, key, first, last = _candidates(p, found)
                texts = list(map(p.stretch, first.tolist(), (last + WINDOW).tolist()))
                row = p.rows[text]
                if with_text:
                    for pair, doc in zip(zip(key.view(np.int64).tolist(), texts), ids[row].tolist()):
                        if doc < low.setdefault(pair, doc):
                            low[pair] = doc
                        if doc > high.setdefault(pair, doc):
                            high[pair] = doc
                else:
                    at = first - (np.cumsum(p.lengths) - p.lengths)[text]
                    yield pd.DataFrame({"digest": list(map(xxhash.xxh3_128_digest, texts)), "doc_id": ids[row], "mark": marks[row], "at": at.astype(np.int32)})
            if low:
                keys, texts = zip(*low)
                yield pd.DataFrame({"key": keys, "stretch": texts, "low": list(low.values()), "high": [high[p] for p in low]})

    schema = "key long, stretch binary, low long, high long" if with_text else "digest binary, doc_id long, mark long, at int"
    return docs.mapInPandas(run, schema)


class _Numbers(dict):
    """Word -> its number."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _spelled(numbers: np.ndarray, n_words: int) -> tuple[str, int]:
    """(string, characters per word): each number as so many digits to the base 64, every digit from its
    own alphabet, so that a match can only begin at a word and no number of words is too large."""
    width = max(1, -(-(n_words - 1).bit_length() // 6))
    places = np.arange(width)
    digits = (numbers[:, None] >> (6 * places)) & 63
    return (digits + 64 * places + 1).astype("<u4").tobytes().decode("utf-32-le"), width


def confirmed(numbers: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first document, recurs) of every window of stretches laid end to end. Windows are grouped by
    hash and every member of a group is compared with its first, word by word."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    n = len(numbers) - window + 1
    at = np.flatnonzero(text[:n] == text[window - 1 :]) if n > 0 else np.empty(0, np.int64)
    if not len(at):
        return at, at, np.empty(0, bool)
    h = window_hashes(mixed(numbers.astype(np.uint64)), window)[at]
    order = np.argsort(h, kind="stable")
    group = np.cumsum(np.concatenate([[True], h[order][1:] != h[order][:-1]])) - 1
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    head = at[order][begin][group]
    if any((numbers[at[order] + j] != numbers[head + j]).any() for j in range(window)):
        rows = numbers[at[:, None] + np.arange(window)]
        group = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(group, kind="stable")
        group = group[order]
        begin = np.flatnonzero(np.diff(group, prepend=-1))
    owner = text[at]
    first = np.empty(len(at), np.int64)
    first[order] = np.minimum.reduceat(low[owner][order], begin)[group]
    last = np.empty(len(at), np.int64)
    last[order] = np.maximum.reduceat(high[owner][order], begin)[group]
    return at, first, first < last


def locate(stretches: list[bytes], low: np.ndarray, high: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], list[int]]]:
    """For each distinct stretch, with the smallest and largest document it occurs in, the windows that a
    smaller document repeats: (offsets in words, first documents). The automaton's phrases are the passages
    all of whose windows recur."""
    known = _Numbers()
    words = b" ".join(stretches).split(b" ") if stretches else []
    numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    lengths = np.fromiter((s.count(b" ") + 1 for s in stretches), np.int64, len(stretches))
    at, first, recurs = confirmed(numbers, lengths, np.asarray(low), np.asarray(high), window)
    at, first = at[recurs], first[recurs]
    if not len(at):
        return [([], []) for _ in stretches]
    spelled, width = _spelled(numbers, len(known))
    text = np.searchsorted(np.cumsum(lengths), at, "right")
    begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])]))
    stops = np.append(begin[1:], len(at))
    automaton = ahocorasick.Automaton()
    for a, b in zip(begin.tolist(), stops.tolist()):
        automaton.add_word(spelled[at[a] * width : (at[b - 1] + window) * width], (int(at[b - 1] - at[a]) + window, a, b))
    automaton.make_automaton()
    firsts, out, where = first.tolist(), [], 0
    for n, most in zip(lengths.tolist(), np.asarray(high).tolist()):
        here: dict[int, int] = {}
        for end, (size, a, b) in automaton.iter(spelled[where * width : (where + n) * width]):
            start = (end + 1) // width - size
            here.update((start + i - a, firsts[i]) for i in range(a, b) if firsts[i] < most)
        out.append((list(here), list(here.values())))
        where += n
    return out


def _located(stretches: DataFrame, shards: int) -> DataFrame:
    """digest, offsets, firsts: what `locate` says of every distinct stretch. Equal stretches fold before
    the shuffle, so a passage of very many documents is a few rows here, and one shuffle by shard serves
    both the folding after it and the automata."""
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    dealt = stretches.select(shard, "key", "stretch", "low", "high").repartition("shard")
    distinct = dealt.groupBy("shard", "key", "stretch").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = locate(list(part["stretch"]), part["low"].to_numpy(), part["high"].to_numpy())
        rows = [(xxhash.xxh3_128_digest(s), *f) for s, f in zip(part["stretch"], found) if f[0]]
        return pd.DataFrame(rows, columns=["digest", "offsets", "firsts"])

    return distinct.groupBy("shard").applyInPandas(run, "digest binary, offsets array<int>, firsts array<long>")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), starts: windows of a document that a smaller doc_id has too."""
    texts = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text")
    )
    found = recurring(_anchors(texts.drop("mark")), HOT)
    rows = found.rows + found.hot * (WINDOW - ANCHOR + 1)
    located = _located(_stretches(texts, found, True), max(8, rows // SHARD_ROWS))
    pairs = F.arrays_zip("offsets", "firsts")
    old = F.filter(pairs, lambda p: p["firsts"] < F.col("doc_id"))
    starts = F.transform(old, lambda p: p["offsets"] + F.col("at"))
    hits = _stretches(texts, found, False).join(located, "digest").select("doc_id", "mark", starts.alias("starts"))
    return hits.where(F.size("starts") > 0).groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row, and the kept words if asked for."""
    hits = repeated_windows(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.xxhash64("text").alias("mark"))
    joined = rows.join(hits, ["doc_id", "mark"], "left").select("doc_id", "text", "starts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, starts in zip(batch["text"], batch["starts"]):
                words = text.split()
                kept = words
                if starts is not None:
                    edge = np.zeros(len(words) + 1, np.int64)
                    starts = np.unique(np.asarray(starts, np.int64))
                    edge[starts] += 1
                    edge[starts + WINDOW] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                whole = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode() if with_text else None))
            made = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"], index=batch.index)
            made.insert(0, "doc_id", batch["doc_id"])
            yield made if with_text else made.drop(columns="kept")

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    return joined.mapInPandas(run, schema + (", kept string" if with_text else ""))
