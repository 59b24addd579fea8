"""N-gram Jaccard join by MinHash banding.

Copies (equal word sequences) fold into one representative first. Representatives get a MinHash
signature cut into bands, whose number and rows are chosen for a target recall at the threshold; band
hashes are shuffled and each bucket points its members at its smallest, so buckets cost rows, not
pairs. The connected parts of that graph hold every pair that shares a bucket. Inside a part the full
n-gram sets decide. A part is compared as one where that is no more work than its buckets one by one;
else (long chains of texts) bucket by bucket, a pair counting in its first common band only, so that
no more pairs are verified than share a bucket. Both ways compare block against block in numpy,
whatever the size, and what leaves a block is a link count and a spanning forest, never the pairs.

A text with fewer words than an n-gram is one n-gram; null texts and texts without words link to
nothing; repeated rows are copies of each other; rows that share an id but not a text share their
links; rows without an id get no result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.base import Portion, materialise, portions, window_hashes
from rasterloom.llm.graph import components
from rasterloom.llm.recurring import bit_filter, passes

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Members of a part compared at once.
BLOCK = 256


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest chance candidates, whose bands reach the
    recall for a pair exactly at the threshold with at most `most` hashes."""
    best = (most, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def grams(p: Portion, n: int = N) -> Iterator[tuple[np.ndarray, bytes]]:
    """(hashes of the n-grams, repeats included; words joined by one space) of every text of a portion."""
    whole, at = window_hashes(p.hashes, n), 0
    for words in p.lengths.tolist():
        stop = at + words
        own = whole[at : stop - n + 1] if words >= n else window_hashes(p.hashes[at:stop], words) if words else whole[:0]
        yield own, p.stretch(at, stop) if words else b""
        at = stop


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N) -> DataFrame:
    """doc_id, key (of the word sequence; null without words) and one hash per band."""
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    salts = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, found = [], []
            for g, text in (pair for p in portions(batch["text"]) for pair in grams(p, n)):
                if not len(g):
                    keys.append(None)
                    found.append(None)
                    continue
                low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(g), 1024):
                    np.minimum(low, ((g[i : i + 1024, None] ^ salts) * factors).min(0), out=low)
                cut = low.reshape(bands, rows)
                mixed = np.arange(bands, dtype=np.uint64) + np.uint64(1)
                for j in range(rows):
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + cut[:, j]
                keys.append(xxhash.xxh3_128_digest(text))
                found.append((mixed ^ (mixed >> np.uint64(32))).view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": keys, "bands": found})

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInPandas(run, f"doc_id {kind}, key binary, bands array<bigint>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by products of 0/1 columns; n-grams that one
    set alone holds are dropped first."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, inverse = owner[counts[inverse] > 1], inverse[counts[inverse] > 1]
    if not len(inverse):
        return out + np.diag(sizes)
    column = np.unique(inverse, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 8192
    edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        x = np.zeros((m, width), np.float32)
        x[owner[a:b], column[a:b] - i * width] = 1
        x = x[:, : column[b - 1] - i * width + 1] if b > a else x[:, :0]
        out += x @ x.T
    np.fill_diagonal(out, sizes)
    return out


def _linked(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links and forest of one part or bucket, or of two blocks of one (then only across them). In a bucket
    of band t, pairs that agree in an earlier band give no link: they were counted there."""
    sets = [np.frombuffer(b, np.uint64) for b in part["grams"]]
    sizes = np.array([len(s) for s in sets], np.float64)
    common = shared_counts(sets)
    union = sizes[:, None] + sizes[None, :] - common
    hit = common >= threshold * union - 1e-6
    np.fill_diagonal(hit, False)
    side = part["side"].to_numpy()
    if part["i"].iat[0] != part["j"].iat[0]:
        hit &= side[:, None] != side[None, :]
    turn = part["turn"].iat[0]
    if turn > 0:
        for band in np.stack(part["bands"])[:, :turn].T:
            hit &= band[:, None] != band[None, :]
    nodes = part["node"].to_numpy()
    links = hit @ part["copies"].to_numpy(np.float64)
    up = np.arange(len(nodes))
    while True:  # smallest reachable position, by spreading minima
        spread = np.where(hit, up[None, :], len(nodes)).min(1)
        new = np.minimum(up, spread)
        new = np.minimum(new, new[new])
        if (new == up).all():
            break
        up = new
    return pd.DataFrame({"node": nodes, "links": links.astype(np.int64), "up": nodes[up]})


def comparisons(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, key, copies, part, turn, bands, blocks, own: where each node is to be compared. `parts` has
    node, key, copies, bands and component. A component of at most `block` members, or whose members
    squared are no more than its buckets' members squared, is one part (turn -1); of the others every
    shared bucket is a part, under the number of its band."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("members")).where("members > 1")
    large = sizes.where(F.col("members") > block)
    by_band = parts.join(large.hint("merge"), "component").select("component", "members", "node", "key", "copies", "bands", F.posexplode("bands").alias("turn", "band"))
    buckets = by_band.groupBy("component", "members", "turn", "band").agg(F.count("*").alias("n")).where("n > 1")
    work = buckets.groupBy("component", "members").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    sparse = materialise(work.where(F.col("pairs") < F.col("members") * F.col("members")).select("component"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int").alias("blocks")
    none = F.lit(None).cast("array<bigint>").alias("bands")
    whole = parts.join(sizes, "component").join(sparse.hint("merge"), "component", "left_anti")
    whole = whole.select("node", "key", "copies", F.col("component").alias("part"), F.lit(-1).alias("turn"), none, blocks("members"))
    cut = by_band.join(sparse.hint("merge"), "component", "left_semi").join(buckets.drop("members"), ["component", "turn", "band"])
    cut = cut.select("node", "key", "copies", F.xxhash64("component", "turn", "band").alias("part"), "turn", "bands", blocks("n"))
    return whole.unionByName(cut).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def verified(docs: DataFrame, parts: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """node, links, up: for each block pair of each part, what the full n-gram sets link.

    A part of more than `block` members is dealt by hash into blocks, and every two blocks meet in one
    group; smaller parts share groups of bounded size."""
    placed = materialise(comparisons(parts, block))
    # A bit filter of the parts' ids keeps other texts from being shuffled; what it lets through by
    # chance goes in the join.
    filter_, n_nodes = bit_filter(placed.select(F.xxhash64("node").alias("key")).distinct())

    def to_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[passes(batch["hash"].to_numpy(), filter_.value)]
            made = [(np.unique(g).tobytes(), xxhash.xxh3_128_digest(t)) for p in portions(batch["text"]) for g, t in grams(p, n)]
            yield pd.DataFrame({"node": batch["node"], "key": [k for _, k in made], "grams": [g for g, _ in made]})

    texts = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("node"), F.xxhash64(F.col("doc_id").cast("long")).alias("hash"), F.col("text").cast("binary").alias("text")
    )
    sets = (
        texts.mapInPandas(to_grams, "node long, key binary, grams binary")
        .dropDuplicates(["node", "key"])
        .join(placed.hint("merge"), ["node", "key"])
        .drop("key")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": F.col("own")})
    )
    # Small parts share groups of about four blocks' members; a pair of blocks is a group of its own.
    groups = max(64, n_nodes // (4 * block))
    home = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("part"), F.lit(groups))).otherwise(
        F.xxhash64("part", "i", "j")
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out = [_linked(p, threshold) for _, p in group.groupby(["part", "turn", "i", "j"], sort=False) if len(p) > 1]
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "up": []}, dtype="int64")

    sets = sets.withColumn("home", home).drop("other", "own", "blocks")
    return sets.groupBy("home").applyInPandas(compare, "node long, links long, up long")


def link(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (smallest id reachable over links and copies) and n_links (documents at or above
    the threshold, copies included) of every row."""
    bands, rows = choose_bands(threshold, recall)
    signed = materialise(signatures(docs.where("doc_id is not null"), bands, rows, n))
    texts = signed.where("key is not null")
    reps = texts.groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("first"), F.count("*").alias("copies"))
    reps = materialise(reps.select(F.col("first.doc_id").cast("long").alias("node"), "key", "copies", "first.bands"))
    banded = reps.select("node", F.explode("bands").alias("band"))
    lows = banded.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = banded.join(lows, "band").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    parts = components(edges)
    parts = materialise(parts.join(reps, "node"))
    found = materialise(verified(docs, parts, n, threshold))
    labels = components(found.select(F.col("node").alias("a"), F.col("up").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = (
        reps.select("node", "key", "copies")
        .join(labels, "node", "left")
        .join(counts, "node", "left")
        .select(
            "key",
            F.coalesce("component", "node").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    return signed.join(classes, "key", "left").select(
        "doc_id",
        F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, **kwargs) -> DataFrame:
    """The rows of `docs` that stay when one document of each class is kept, the one with the smallest
    id; of rows with that same id one stays. Rows without an id stay."""
    classes = link(docs.select("doc_id", "text"), **kwargs)
    losers = classes.where("doc_id <> class_id").select("doc_id").distinct()
    # The losers grow with the corpus: never a broadcast.
    known = docs.where("doc_id is not null")
    rest = known.join(losers.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    return rest.dropDuplicates(["doc_id"]).unionAll(docs.where("doc_id is null"))
