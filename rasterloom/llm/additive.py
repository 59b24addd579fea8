"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one from each residual codebook, found by beam
search; its norm and that of what the code leaves over are stored beside it. Codes, without the vectors,
are kept in cells named by their first codewords; a query visits the cells whose codewords promise the
largest inner products, as many as a sample of queries, searched exactly, needs for the wanted recall, and
more where these hold too few vectors. It scores the codes there by table look-up of its inner products with
all codewords. What may, with a margin for the stored remainder, be among the query's best is scored again
from the original vectors, in double precision, by the task that looked it up.

Codebooks are learnt in numpy from a bounded sample. Equal vectors are searched once, under their smallest
ids, of which k + 1 are kept; every other vector is coded and every cell is searched whole, in blocks of
several cells. A block gives no more than k + 1 vectors a query. Many blocks are searched in rounds, each of
GROWTH times the vectors of all before it: as what a round has found bounds the next one, each gives a
query some (k + 1) * GROWTH vectors, whatever the size of the table. Equal vectors' ids are listed at the end.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part. Rows that share an id count once, by their smallest vector; ties in the score go to the smaller
id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.base import materialise

BOOKS, WORDS, BEAM = 8, 256, 4
#: Bound of the training sample, and of the queries that are searched exactly to choose the probes.
SAMPLE, TRIALS = 8192, 64
#: Share of true neighbours that the visited cells should hold, over the trial queries.
RECALL = 0.98
#: Least vectors per cell, on average, and most codewords in a cell's name.
CELL_ROWS, CELL_BOOKS = 64, 2
#: Margin of the exact second look, in standard deviations of what the code leaves over.
MARGIN = 2.5
#: Rows and queries of a block, and the fewest queries of one where there are fewer blocks than cores.
ROW_BLOCK, QUERY_BLOCK, LEAST_QUERIES = 8192, 8192, 256
#: Blocks of the first round; how much more vectors than all rounds before it a round ends with.
GROWTH = 8
#: What single precision may lose of a look-up score, as a share of the vectors' norms.
ROUNDING = 1e-5


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x @ book.T - 0.5 * (book**2).sum(1)).argmax(1)


def learn(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Codebooks (books, words, dim): k-means on residuals, then two joint least-squares refits."""
    rng = np.random.default_rng(seed)
    words = min(words, len(x))
    out, rest = np.zeros((books, words, x.shape[1]), np.float32), x.copy()
    for m in range(books):
        book = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            at = _nearest(rest, book)
            n = np.bincount(at, minlength=words)
            sums = np.zeros_like(book)
            np.add.at(sums, at, rest)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rest[rng.choice(len(rest), words)])
        out[m] = book
        rest = rest - book[_nearest(rest, book)]
    for _ in range(2):
        codes = encode(x, out)[0].astype(np.int64)
        rest = x - out[np.arange(books), codes].sum(1)
        for m in range(books):  # each book refitted while the others stand
            n = np.bincount(codes[:, m], minlength=words)
            sums = np.zeros_like(out[m])
            np.add.at(sums, codes[:, m], rest)
            step = sums / np.maximum(n, 1)[:, None]
            out[m] += step
            rest -= step[codes[:, m]]
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, what they leave over): after each book the `beam` best partial sums of a vector stay."""
    n, dim = x.shape
    rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for book in books:
        half = (book**2).sum(1)
        gain = 2 * rest @ book.T - half  # squared distance saved
        cost = ((rest**2).sum(2)[:, :, None] - gain).reshape(n, -1)
        k = min(beam, cost.shape[1])
        best = np.argpartition(cost, k - 1, 1)[:, :k] if k < cost.shape[1] else np.tile(np.arange(k), (n, 1))
        came, word = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        rest = rest[rows, came] - book[word]
        codes = np.concatenate([codes[rows, came], word[:, :, None].astype(np.uint8)], 2)
    last = (rest**2).sum(2).argmin(1)
    return codes[np.arange(n), last], rest[np.arange(n), last]


def cell_books(n: int) -> int:
    """How many first codewords name a cell, so that cells keep CELL_ROWS vectors on average."""
    return max(b for b in range(CELL_BOOKS + 1) if b == 0 or WORDS**b * CELL_ROWS <= n)


def cell_order(queries: np.ndarray, books: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """For every query, the places of all cells (rows of codewords) by falling inner product."""
    score = np.zeros((len(queries), len(cells)), np.float32)
    for m in range(cells.shape[1]):
        score += (queries @ books[m].T)[:, cells[:, m]]
    return np.argsort(-score, 1, kind="stable")


def cells_seen(order: np.ndarray, sizes: np.ndarray, n_probes: int, least: int) -> np.ndarray:
    """(queries, cells): whether a query visits a cell. It goes through its `n_probes` first cells, and on until
    they hold `least` vectors."""
    enough = (np.cumsum(sizes[order], 1) < least).sum(1) + 1
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order, np.arange(order.shape[1]) < np.maximum(n_probes, enough)[:, None], 1)
    return out


def blocks(sizes: list[float]) -> list[tuple[int, int, int]]:
    """(first cell, cell after the last, parts): neighbouring cells together up to ROW_BLOCK rows; a larger cell
    stands alone, in as many parts as it needs."""
    out, first, held = [], 0, 0.0
    for i, n in enumerate([*sizes, float("inf")]):
        if held + n > ROW_BLOCK and i > first:
            out.append((first, i, max(1, -int(-held // ROW_BLOCK))))
            first, held = i, 0.0
        held += n
    return out


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, books: np.ndarray, k: int) -> pd.DataFrame:
    """Per query, the k best rows of those in the cells it sees, by their exact score, ties to the smaller `vec`:
    of what the look-up scores, and how high the true ones may be, leave possible. Rows whose exact score is
    under the query's `floor` are left out."""
    none = pd.DataFrame({"query": [], "vec": [], "approx": [], "score": []}).astype({"query": "int64", "vec": "int64"})
    if not len(queries) or not len(rows):
        return none
    rows = rows.sort_values("vec")
    ids, at = rows["vec"].to_numpy(), rows["place"].to_numpy()
    x = np.ascontiguousarray(np.stack(rows["vector"]).astype(np.float64).T)
    codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
    norm = rows["norm"].to_numpy()
    scale = (norm / np.maximum(rows["coded"].to_numpy(), 1e-12)).astype(np.float32)
    spread = (MARGIN * rows["left"].to_numpy() / np.sqrt(len(x)) + ROUNDING * norm).astype(np.float32)
    queries = queries.sort_values("seen")  # alike queries go together, past the cells that none of them sees
    out = []
    for a in range(0, len(queries), 128):
        part = queries.iloc[a : a + 128]
        q = np.stack(part["vector"]).astype(np.float64)
        q32, qt = q.astype(np.float32), np.ascontiguousarray(q.T)
        seen = np.unpackbits(np.frombuffer(b"".join(part["seen"]), np.uint8).reshape(len(part), -1), axis=1).astype(bool)
        use = np.flatnonzero(seen.any(0)[at])
        if not len(use):
            continue
        tables = np.einsum("qd,mwd->mwq", q32, books, optimize=True)
        approx = np.zeros((len(use), len(part)), np.float32)
        for m in range(len(books)):
            approx += tables[m][codes[use, m]]
        approx = np.ascontiguousarray((approx * scale[use, None]).T)
        mine = seen[:, at[use]]
        approx[~mine] = -np.inf
        limit = part["limit"].to_numpy()
        if len(use) >= k:
            limit = np.maximum(limit, np.partition(approx, len(use) - k, 1)[:, len(use) - k])
        high = approx + spread[use] * np.sqrt((q32**2).sum(1))[:, None]
        c, r = np.nonzero((high >= limit[:, None]) & mine)
        found = use[r]
        # One fixed order of addition, so equal vectors tie exactly.
        score = np.zeros(len(c))
        for d in range(len(x)):
            score += qt[d][c] * x[d][found]
        ends = np.searchsorted(c, np.arange(len(part) + 1))
        least = part["floor"].to_numpy().copy()
        for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
            if hi - lo > k:
                least[i] = max(least[i], np.partition(score[lo:hi], hi - lo - k)[hi - lo - k])
        keep = np.flatnonzero(score >= least[c])
        keep = keep[np.lexsort((found[keep], -score[keep], c[keep]))]
        turn = np.arange(len(keep)) - np.searchsorted(c[keep], c[keep])
        keep = keep[turn < k]
        out.append(pd.DataFrame({"query": part["query"].to_numpy()[c[keep]], "vec": ids[found[keep]], "approx": approx[c[keep], r[keep]], "score": score[keep]}))
    return pd.concat(out) if out else none


def _folded(rows: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, int] | None:
    """(distinct vectors: vec, vector, ids; queries: query_id, vec; number of distinct vectors). `vec` is the
    smallest id of a vector, `ids` its k + 1 smallest."""
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    valid = picked.where(F.col("id").isNotNull() & usable(F.col("vector")))
    sized = valid.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sized is None:
        return None
    valid = valid.where(F.size("vector") == sized["dim"])
    # Zeros of either sign are one value.
    valid = valid.withColumn("vector", F.transform("vector", lambda x: x + 0))
    single = valid.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    single = materialise(single.withColumn("mark", F.sha2(F.to_json(F.struct("vector")), 256)))
    order = Window.partitionBy("mark").orderBy("id")
    first = single.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    each = first.groupBy("mark").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("vector", "id").alias("vector"))
    vectors = materialise(each.select("mark", F.get("ids", F.lit(0)).alias("vec"), "vector", "ids"))
    queries = single.where("asks").select(F.col("id").alias("query_id"), "mark").join(vectors.select("mark", "vec").hint("merge"), "mark")
    return vectors.drop("mark"), queries.select("query_id", "vec"), vectors.count()


def probes(coded: DataFrame, asking: DataFrame, books: np.ndarray, cells: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Number of cells a query visits: over trial queries, the least that hold the wanted share of their
    exact k nearest vectors. One pass over all vectors; the driver gets TRIALS * k rows."""
    if len(cells) < 2:
        return 1
    trial = asking.orderBy(F.xxhash64("vec"), "vec").limit(TRIALS).select("vec", "vector").collect()
    own = np.array([r["vec"] for r in trial])
    q = np.array([r["vector"] for r in trial], np.float64)
    shared = coded.sparkSession.sparkContext.broadcast((own, q))
    width = cells.shape[1]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q = shared.value
        for batch in batches:
            score = np.stack(batch["vector"]).astype(np.float64) @ q.T
            score[batch["vec"].to_numpy()[:, None] == own] = -np.inf
            top = np.argpartition(-score, min(k, len(score)) - 1, 0)[:k]
            names = [c[:width] for c in batch["code"]]
            yield pd.DataFrame({
                "trial": np.tile(np.arange(len(own)), len(top)), "cell": [names[i] for i in top.ravel()],
                "score": np.take_along_axis(score, top, 0).ravel(),
            })

    found = coded.select("vec", "vector", "code").mapInPandas(best, "trial int, cell binary, score double")
    order = Window.partitionBy("trial").orderBy(F.desc("score"))
    kept = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("trial", "cell").collect()
    place = {bytes(c): i for i, c in enumerate(cells.tolist())}
    turn = np.argsort(cell_order(q.astype(np.float32), books, cells), 1)
    needed = sorted(int(turn[r["trial"], place[bytes(r["cell"])]]) for r in kept)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] + 1 if needed else 1


def _round(asked: DataFrame, rows: DataFrame, books: Broadcast, names: list[bytes], cells: np.ndarray, sizes: np.ndarray, share: float, n_probes: int, n_queries: int, k: int) -> DataFrame:
    """(query, vec, approx, score): of every block of the coded `rows`, which are a `share` of all, the k best of
    what the queries (vec, vector, limit, floor) see there."""
    spark, vector = rows.sparkSession, rows.schema["vector"].dataType.simpleString()
    made = blocks((sizes * share).tolist())
    starts = np.cumsum([0] + [parts for *_, parts in made]).tolist()
    plan = spark.sparkContext.broadcast((cells, sizes, made, starts))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, sizes, made, starts = plan.value
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256].rename(columns={"vec": "query"}).reset_index(drop=True)
                seen = cells_seen(cell_order(np.stack(part["vector"]).astype(np.float32), books.value, cells), sizes, n_probes, k)
                for (first, last, parts), start in zip(made, starts):
                    some = np.flatnonzero(seen[:, first:last].any(1))
                    if len(some):
                        bits = np.packbits(seen[some, first:last], axis=1)
                        at = part.iloc[some].assign(seen=[b.tobytes() for b in bits])
                        for block in range(start, start + parts):
                            yield at.assign(block=block)

    # Queries are dealt in blocks, and a block's rows copied to each.
    cores = spark.sparkContext.defaultParallelism
    q_blocks = max(-(-n_queries // QUERY_BLOCK), min(n_queries // LEAST_QUERIES, 2 * cores // starts[-1]), 1)
    slot = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), n).cast("int")
    left = asked.mapInPandas(visit, f"query long, vector {vector}, limit double, floor double, seen binary, block int").withColumn("qb", slot("query", F.lit(q_blocks), 1))
    numbers = [(bytearray(names[i]), i - first, start, parts) for (first, last, parts), start in zip(made, starts) for i in range(first, last)]
    facts = F.broadcast(spark.createDataFrame(numbers, "cell binary, place int, start int, parts int"))
    right = rows.join(facts, "cell").withColumn("block", F.col("start") + slot("vec", F.col("parts"), 2))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).select("vec", "vector", "code", "norm", "left", "coded", "place", "block", "qb")

    def meet(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return search_block(queries, rows, books.value, k)

    both = left.groupBy("block", "qb").cogroup(right.groupBy("block", "qb"))
    return both.applyInPandas(meet, "query long, vec long, approx float, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by inner product to each row that `is_query`
    marks, other than itself."""
    spark = rows.sparkSession
    folded = _folded(rows, is_query, k, id_col, vector_col)
    if folded is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors, queries, total = folded
    sample = vectors.select("vector", F.xxhash64("vec").alias("h"))
    wide = 1 << 40
    sample = sample.where(F.pmod("h", F.lit(wide)) < max(1, int(min(1.0, SAMPLE / total) * wide))).orderBy("h").limit(2 * SAMPLE)
    x = np.array([r["vector"] for r in sample.collect()], np.float32)
    if not len(x):
        x = np.array([r["vector"] for r in vectors.limit(WORDS).collect()], np.float32)
    books = learn(x)
    shared = spark.sparkContext.broadcast(books)
    width = cell_books(total)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.iloc[i : i + 1024].copy()
                x = np.stack(part["vector"]).astype(np.float32)
                codes, rest = encode(x, shared.value)
                yield part.assign(
                    code=[c.tobytes() for c in codes],
                    norm=np.sqrt((x**2).sum(1)),
                    left=np.sqrt((rest**2).sum(1)),
                    coded=np.sqrt(((x - rest) ** 2).sum(1)),
                )

    kind = vectors.schema["vector"].dataType.simpleString()
    coded = materialise(vectors.select("vec", "vector").mapInPandas(code, f"vec long, vector {kind}, code binary, norm float, left float, coded float"))
    named = coded.withColumn("cell", F.substring("code", 1, width))
    # One row per cell, at most WORDS ** CELL_BOOKS.
    counted = {bytes(r["cell"]): r["count"] for r in named.groupBy("cell").count().collect()}
    names = sorted(counted)
    cells = np.array([list(c) for c in names], np.int64).reshape(len(names), width)
    sizes = np.array([counted[c] for c in names], np.int64)
    asking = materialise(queries.select("vec").distinct().join(coded.select("vec", "vector"), "vec"))
    n_probes, n_queries = probes(coded, asking, books, cells, k, recall), asking.count()
    found, done = None, 0.0
    while done < 1:
        share = min(1.0, GROWTH * (done or ROW_BLOCK / total))
        if found is None:
            asked = asking.withColumns({"limit": F.lit(float("-inf")), "floor": F.lit(float("-inf"))})
        else:
            kth = lambda c: F.coalesce(F.get(F.sort_array(F.collect_list(c), False), F.lit(k)).cast("double"), F.lit(float("-inf")))
            known = found.groupBy(F.col("query").alias("vec")).agg(kth("approx").alias("limit"), kth("score").alias("floor"))
            asked = asking.join(known.hint("merge"), "vec", "left").fillna(float("-inf"), ["limit", "floor"])
        place = F.pmod(F.xxhash64("vec", F.lit(5)), F.lit(wide))
        part = named if done == 0 and share == 1 else named.where((place >= int(done * wide)) & (place < int(share * wide)))
        now = materialise(_round(asked, part, shared, names, cells, sizes, share - done, n_probes, n_queries, k + 1))
        found, done = now if found is None else found.unionAll(now), share
    # A vector behind k + 1 others is behind their smallest ids with all of its own.
    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec")
    scored = found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).select("query", "vec", "score")
    ids = scored.join(vectors.select("vec", "ids"), "vec").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    own = queries.join(lists.withColumnRenamed("query", "vec").hint("merge"), "vec")
    others = F.slice(F.filter("near", lambda r: r["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "r")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "r.vec_id", "r.score")
