"""Ranked lexical search: document FP-trees walked by depth-first branch and bound.

Every document is cut down to the terms that some item asks for, with their numbers of occurrences, most
frequent term first. Some documents at a time are laid in a trie, so that equal beginnings share a path;
a node keeps the largest number of occurrences of each term below it and the smallest length norm m, which
bound the score of all documents below. For each item the trie is walked depth-first, best child first,
leaving out what cannot reach the item's k-th score so far; a bound of one document is its score. The best
of all tasks meet in one ranking per item.

Scores: w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, and a document's score is the
sum of w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, in 64-bit integers. Weights stand for
whole counts: N and L count all documents, whatever the items.

Null and empty texts, and those without any term, are no documents: they count nowhere and are not found.
An item without a term of any document gives no row. Equal scores go by ascending doc_id, rows without an
id last; repeated rows are documents of their own, as are items that share an id. Empty tables give an empty
result; other columns are ignored. Items are taken `ITEMS` at a time, or fewer where they bring over `TERMS`
terms (a single larger item goes alone), each portion in a pass of its own over the documents.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from rasterloom.llm.base import materialise

TOP = 10
#: Bounds of a portion of items, cells of a trie's table, and documents that are looked at one by one.
ITEMS, TERMS, CELLS, LEAF = 256, 1 << 14, 1 << 22, 16
_SLICE = 1 << 20

#: Bytes of UTF-8 text: A-Z lower-cased, all other ASCII but digits and letters to spaces.
_CLEAN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of every term of a UTF-8 text; long texts are split at spaces a slice at a time."""
    clean, found, a = (text or b"").translate(_CLEAN), Counter(), 0
    while a < len(clean):
        b = len(clean) if len(clean) - a <= _SLICE else clean.find(b" ", a + _SLICE)
        b = len(clean) if b < 0 else b
        found.update(clean[a:b].split())
        a = b
    return found


def portions(items: DataFrame) -> Iterator[list[tuple[Row, list[bytes]]]]:
    """Items with their distinct terms, a bounded number at a time."""
    held, terms = [], 0
    for row in items.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        own = sorted(term_counts(row["text"]))
        if held and (len(held) == ITEMS or terms + len(own) > TERMS):
            yield held
            held, terms = [], 0
        held.append((row, own))
        terms += len(own)
    if held:
        yield held


def restricted(docs: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats) and, of the asked terms, codes and occurrences, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            n, terms, times = [], [], []
            for text in batch.column("text"):
                found = term_counts(text.as_py())
                own = {asked[t]: k for t, k in found.items() if t in asked}
                n.append(found.total())
                terms.append(np.fromiter(own.keys(), np.int32, len(own)).tobytes())
                times.append(np.fromiter(own.values(), np.int32, len(own)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], ["doc_id", "n", "terms", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms binary, times binary")


def document_frequencies(docs: DataFrame, n_terms: int) -> np.ndarray:
    """Number of documents that hold each asked term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for r in docs.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


@dataclass
class Question:
    """What tasks need of a portion of items: terms of each item, a term's weight and its place in the order
    of falling document frequency, and the totals behind m."""

    items: list[np.ndarray]
    weights: np.ndarray
    place: np.ndarray
    n_docs: int
    n_terms: int


def _parts(times: np.ndarray, norms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A term's part of a score; grows with its occurrences and falls with the norm."""
    times = times.astype(np.int64)
    return weights * ((1_000_000_000 * times) // (1000 * times + 8 * norms))


class Tree:
    """Trie of documents: rows 0 up to the number of documents are documents in the order of their paths,
    further ones are nodes; `children` lists the rows below each node, the root first."""

    def __init__(self, ids: list, norms: np.ndarray, terms: list[np.ndarray], times: list[np.ndarray], question: Question):
        paths = []
        for t, k in zip(terms, times):
            order = np.argsort(question.place[t], kind="stable")
            paths.append((question.place[t][order].astype(">u4").tobytes(), t[order], k[order]))
        order = sorted(range(len(ids)), key=lambda i: paths[i][0])
        self.ids = [ids[i] for i in order]
        keys = [paths[i][0] for i in order]
        self.terms, columns = np.unique(np.concatenate([paths[i][1] for i in order]), return_inverse=True)
        lengths = np.array([len(k) // 4 for k in keys])
        shared = np.array([0] + [_common(a, b) for a, b in zip(keys, keys[1:])], np.int64)
        self.children: list[np.ndarray] = []
        stack = [(0, len(ids), 0)]
        self.children.append(np.empty(0, np.int64))
        while stack:
            low, high, node = stack.pop()
            inside = shared[low + 1 : high]
            cuts = low + 1 + np.flatnonzero(inside == inside.min()) if len(inside) else np.empty(0, np.int64)
            rows = []
            for a, b in zip([low, *cuts.tolist()], [*cuts.tolist(), high]):
                if b - a <= LEAF:
                    rows.append(np.arange(a, b))
                else:
                    rows.append(np.array([len(ids) + len(self.children)]))
                    stack.append((a, b, len(self.children)))
                    self.children.append(np.empty(0, np.int64))
            self.children[node] = np.concatenate(rows)
        n, size = len(ids), len(ids) + len(self.children)
        most = np.zeros((size, len(self.terms)), np.int32)
        most[np.repeat(np.arange(n), lengths), columns] = np.concatenate([paths[i][2] for i in order])
        least = np.empty(size, np.int64)
        least[:n] = norms[order]
        # A node is listed before those below it.
        for node in range(len(self.children) - 1, -1, -1):
            most[n + node] = most[self.children[node]].max(0)
            least[n + node] = least[self.children[node]].min()
        weights = question.weights[self.terms]
        self.bounds = np.empty((len(self.terms), size), np.int64)
        for a in range(0, size, 256):
            self.bounds[:, a : a + 256] = _parts(most[a : a + 256], least[a : a + 256, None], weights).T

    def search(self, terms: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        """`best`, the (score, without id, id) of up to k documents, improved by those of this tree."""
        n = len(self.ids)
        rows = np.searchsorted(self.terms, terms)
        rows = rows[(rows < len(self.terms)) & (self.terms[np.minimum(rows, len(self.terms) - 1)] == terms)]
        if not len(rows):
            return best
        stack, own = [(int(self.bounds[rows, n].sum()), n)], None
        while stack:
            bound, node = stack.pop()
            least = max(1, -best[-1][0] if len(best) == k else 1)
            if bound < least:
                continue
            own = self.bounds[rows] if own is None else own
            below = self.children[node - n]
            sums = own[:, below].sum(0)
            ok = np.flatnonzero(sums >= least)
            below, sums = below[ok], sums[ok]
            docs = below < n
            if docs.any():
                found = [(-s, self.ids[i] is None, self.ids[i]) for i, s in zip(below[docs].tolist(), sums[docs].tolist())]
                best = sorted(best + found, key=_order)[:k]
            order = np.argsort(sums[~docs], kind="stable")
            stack.extend(zip(sums[~docs][order].tolist(), below[~docs][order].tolist()))
        return best


def _order(found: tuple) -> tuple:
    return found[0], found[1], 0 if found[1] else found[2]


def _common(a: bytes, b: bytes) -> int:
    """Number of places at the beginning that two paths share."""
    n = min(len(a), len(b)) // 4
    differ = np.flatnonzero(np.frombuffer(a, ">u4", n) != np.frombuffer(b, ">u4", n))
    return int(differ[0]) if len(differ) else n


def _trees(batches: Iterator[pa.RecordBatch], question: Question) -> Iterator[Tree]:
    """Tries of as many documents as fit a table of `CELLS`."""
    ids, lengths, terms, times, seen = [], [], [], [], np.zeros(len(question.weights), bool)

    def tree() -> Tree:
        norms = 10 + (90 * np.array(lengths, np.int64) * question.n_docs) // question.n_terms
        return Tree(ids, norms, terms, times, question)

    width = 0
    for batch in batches:
        for doc_id, n, t, k in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "times")]):
            t = np.frombuffer(t, np.int32)
            if ids and (len(ids) + 1) * (width + int((~seen[t]).sum())) > CELLS:
                yield tree()
                ids, lengths, terms, times, width = [], [], [], [], 0
                seen[:] = False
            width += int((~seen[t]).sum())
            seen[t] = True
            ids.append(doc_id)
            lengths.append(n)
            terms.append(t)
            times.append(np.frombuffer(k, np.int32))
    if ids:
        yield tree()


def _found(docs: DataFrame, question: Question, k: int) -> DataFrame:
    """item (its number), doc_id and score of each task's best documents."""
    shared = docs.sparkSession.sparkContext.broadcast(question)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question = shared.value
        best: list[list[tuple]] = [[] for _ in question.items]
        for tree in _trees(_typed(batches), question):
            for i, terms in enumerate(question.items):
                best[i] = tree.search(terms, best[i], k)
        rows = [(i, b[2], -b[0]) for i, each in enumerate(best) for b in each]
        if rows:
            item, doc_id, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, types[0]), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    types: list[pa.DataType] = []

    def _typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types[:] = [batch.schema.field("doc_id").type]
            yield batch

    return docs.mapInArrow(run, f"item int, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents."""
    spark = docs.sparkSession
    kinds = {c: t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id"))}
    done: list[DataFrame] = []
    for portion in portions(items):
        codes = {t: i for i, t in enumerate(sorted({t for _, terms in portion for t in terms}))}
        kept = materialise(restricted(docs, codes).where("n > 0"))
        totals = kept.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
        if not codes or not totals["n"]:
            continue
        df = document_frequencies(kept, len(codes))
        weights = np.array([math.floor(1000 * math.log((2 * totals["n"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        place = np.empty(len(df), np.int64)
        place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        question = Question([np.array([codes[t] for t in terms], np.int64) for _, terms in portion], weights, place, totals["n"], totals["terms"])
        found = _found(kept.where(F.length("terms") > 0), question, k)
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, row["item_id"]) for i, (row, _) in enumerate(portion)], f"item int, item_id {kinds['item_id']}")
        done.append(materialise(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")))
    out = done[0] if done else spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    for more in done[1:]:
        out = out.unionByName(more)
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The same rows in DuckDB: every item against every document that shares a term.
ORACLE_SQL = f"""
WITH listed AS (
  SELECT doc_id, row_number() OVER () AS d, {_TERMS.format(string.ascii_uppercase, string.ascii_lowercase)} AS terms FROM documents
), held AS (SELECT doc_id, d, terms, len(terms) AS n FROM listed WHERE len(terms) > 0
), totals AS (SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L FROM held
), occurrences AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM held) GROUP BY d, term
), weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * N_ + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM occurrences, totals GROUP BY term, N_
), asked AS (
  SELECT DISTINCT item_id, i, unnest(terms) AS term
  FROM (SELECT item_id, row_number() OVER () AS i, {_TERMS.format(string.ascii_uppercase, string.ascii_lowercase)} AS terms FROM benchmark)
), scored AS (
  SELECT item_id, i, h.doc_id, h.d,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * N_) // L)))) AS BIGINT) AS score
  FROM asked JOIN weighed USING (term) JOIN occurrences o USING (term) JOIN held h ON h.d = o.d, totals
  GROUP BY item_id, i, h.doc_id, h.d
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
