"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean of its subword vectors (its character n-grams with word ends, and the
word itself, hashed into a fixed number of buckets), so unseen misspellings share vectors with what
they resemble. The vectors of 16 neighbouring words are averaged and put through a softmax of two
classes; a text's score is that of its most toxic stretch, in training as in scoring, so a few words
in a very long text count as they do in a short one.

Nulls and empty texts hold no word and get the score of the bias alone; repeated rows are scored
alike, and learnt from once per id, by the smallest text; rows of `labels` with a null label, or whose document is missing, are not learnt from; without
labels of both classes every score is the share of toxic labels (0 without any). Other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.base import window_hashes

WINDOW = 16
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
#: Bound of the training sample: labelled documents of each class at most.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 3000
PREDICT_AT = 0.7

_EDGES = b".,;:!?\"'()[]{}*$%&#|<>-_=+/\\~`@^"


def subwords(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of every subword of the words, all computed at once, by code points."""
    marked = [f"<{(w.strip(_EDGES) or w).decode('utf-8', 'replace')}>" for w in words]
    blob = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4")
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), lengths)
    letters = blob.astype(np.uint64) + np.uint64(0x51ED27)
    owners, found = [], []
    for k in GRAMS:
        h = window_hashes(letters, k)
        inside = owner[: len(h)] == owner[k - 1 :] if len(h) else np.empty(0, bool)
        owners.append(owner[: len(h)][inside])
        found.append(h[inside])
    # The whole word: a sum of its letters scrambled by their place.
    place = np.arange(len(blob)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letter = (letters + (place.astype(np.uint64) << np.uint64(24))) * np.uint64(0x9E3779B97F4A7C15)
    letter ^= letter >> np.uint64(31)
    letter *= np.uint64(0xBF58476D1CE4E5B9)
    starts = np.cumsum(lengths) - lengths
    owners.append(np.arange(len(marked)))
    found.append(np.add.reduceat(letter, starts) if len(marked) else np.empty(0, np.uint64))
    return np.concatenate(owners), (np.concatenate(found) >> np.uint64(20)).astype(np.int64) % buckets


@dataclass
class Model:
    """Bucket vectors and the two class vectors with their biases."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def bucket_logits(self) -> np.ndarray:
        """Each bucket's part of the log-odds: averaging is linear, so scoring needs no more."""
        return self.vectors @ (self.weights[1] - self.weights[0])


def word_logits(logits: np.ndarray, owner: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, logits[bucket], n) / np.maximum(np.bincount(owner, minlength=n), 1)


def _stretches(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every stretch over texts laid end to end, and the first stretch of each text."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    counts = np.maximum(lengths - width + 1, 1)
    firsts = np.cumsum(counts) - counts
    starts = np.arange(counts.sum()) - np.repeat(firsts - begins, counts)
    return starts, np.minimum(starts + width, np.repeat(ends, counts)), firsts


def train(texts: list[bytes], labels: np.ndarray, dim: int = 8, warm: int = 20, epochs: int = 100, lr: float = 1.0, seed: int = 7) -> Model:
    """Full-batch descent on vectors, class weights and biases together; each step is scaled by its
    largest entry, so that rare subwords move less than common ones. The first `warm` rounds average
    whole texts; the others use each text's most toxic stretch at that time."""
    ids: dict[bytes, int] = {}
    rows, kept = [], []
    for text, label in zip(texts, labels):
        if words := (text or b"").split():
            rows.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
            kept.append(label)
    y = np.array(kept, np.float64)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.02, (BUCKETS, dim)).astype(np.float32)
    weights = rng.normal(0, 0.3, (2, dim)).astype(np.float32)
    share = float(y.mean()) if len(y) else 0.0
    bias = np.array([0.0, np.log(max(share, 1e-6) / max(1 - share, 1e-6))])
    if not 0 < share < 1:
        return Model(vectors * 0, weights, bias)
    owner, bucket = (x.astype(np.int32) for x in subwords(list(ids)))
    per_word = np.maximum(np.bincount(owner, minlength=len(ids)), 1)
    tokens = np.concatenate(rows)
    lengths = np.array([len(r) for r in rows])
    ends = np.cumsum(lengths)
    pieces = _stretches(lengths, WINDOW)
    whole = (ends - lengths, ends, np.arange(len(rows)))
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    params = [vectors, weights, bias]
    speed = [np.zeros_like(p) for p in params]
    for step in range(1, warm + epochs + 1):
        starts, stops, firsts = whole if step <= warm else pieces
        delta = weights[1] - weights[0]
        per_token = (np.bincount(owner, (vectors @ delta)[bucket], len(ids)) / per_word)[tokens]
        running = np.concatenate([[0.0], np.cumsum(per_token)])
        means = (running[stops] - running[starts]) / (stops - starts)
        best = np.maximum.reduceat(means, firsts)
        at = np.flatnonzero(means == np.repeat(best, np.diff(np.append(firsts, len(means)))))
        of = np.searchsorted(firsts, at, "right") - 1
        at, of = at[np.unique(of, return_index=True)[1]], np.unique(of)
        error = np.zeros(len(y))
        error[of] = (1 / (1 + np.exp(-np.clip(best + bias[1] - bias[0], -50, 50))) - y)[of] * balance[of]
        edge = np.zeros(len(tokens) + 1)
        share_of = error[of] / (stops[at] - starts[at])
        np.add.at(edge, starts[at], share_of)
        np.add.at(edge, stops[at], -share_of)
        g_word = np.bincount(tokens, np.cumsum(edge[:-1]), len(ids)) / per_word
        g_bucket = np.bincount(bucket, g_word[owner], BUCKETS).astype(np.float32)
        g_weight = g_bucket @ vectors
        grads = [np.outer(g_bucket, delta), np.stack([-g_weight, g_weight]), np.array([-error.sum(), error.sum()])]
        for p, g, v in zip(params, grads, speed):
            v += 0.1 * (g - v)
            p -= lr * (1 - step / (warm + epochs + 1)) * v / (np.abs(v).max() + 1e-12)
    return Model(*params)


def training_rows(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN) -> DataFrame:
    """Whole texts of a bounded sample of labelled documents outside the held-out third, chosen by a
    hash of the id; the sampled ids are at most n_toxic + n_clean, so they can be broadcast."""
    learnable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(_fold(F.col("doc_id")) != 1)
    ids = learnable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda cls, n: ids.where(F.col("toxic") == cls).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, n_toxic).unionAll(pick(0, n_clean))
    # One text per id, the smallest, before anything reaches the driver.
    texts = docs.select("doc_id", F.lower("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels).toPandas().sort_values("doc_id")
    return train(list(rows["text"]), rows["toxic"].to_numpy(np.float64))


class _WordScores(dict):
    """Log-odds part of each word met lately."""

    def __init__(self, logits: np.ndarray, keep: int = 400_000):
        super().__init__()
        self.logits, self.keep = logits, keep

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.keep:
            self.clear()
            new = list(words)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.update(zip(part, word_logits(self.logits, *subwords(part), len(part)).tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; texts are scored where they lie."""
    logits, offset = model.bucket_logits().astype(np.float32), float(model.bias[1] - model.bias[0])
    shared = docs.sparkSession.sparkContext.broadcast(logits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordScores(shared.value)
        for batch in batches:
            out = np.full(len(batch), offset)
            for i, text in enumerate(batch["text"]):
                words = text.split() if text else []
                if not words:
                    continue
                try:
                    s = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                except KeyError:
                    known.learn(set(words))
                    s = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                width = min(WINDOW, len(words))
                running = np.concatenate([[0.0], np.cumsum(s)])
                out[i] += (running[width:] - running[:-width]).max() / width
            p = 1 / (1 + np.exp(-np.clip(out, -50, 50)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": p})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.lower("text").cast("binary").alias("text")).mapInPandas(run, f"doc_id {kind}, score double")
    return rows.select(
        "doc_id",
        F.coalesce(_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"),
    )
