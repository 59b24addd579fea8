"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, shuffled by a hash, are laid end to end and cut into blocks of equal token
count: `BLOCK` words, or fewer where that is more than a small part of the source or of its target. Slot
n of the mix takes the n-th van der Corput point, the bits of n in reverse; where it falls in the
cumulative numbers of slots that the sources need names the source, and the slot's rank among that source's
slots names the block, starting over when the blocks are used up. The schedule runs on until every source
has the slots that it needs; slots that fall to a source past its need stay empty, so that every source meets
its target within one block. `first_slot` tells where a document first comes up, and the mixed corpus is
written in the order of the slots. Token counts are numbers of words.

A null text has size 0; the null source is a source of its own, after all others; documents of size 0
take part with nothing to take and no slot; rows without an id, repeated rows and rows that share an id are
documents of their own, laid by their hash of id and text (equal ones one after another, numbered by the part
of the table that they lie in); an empty table gives an empty result; other columns are ignored. The driver
holds one row per source.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.base import materialise, word_count

#: Bits of a point, and so of the numbers of slots.
BITS = 48
#: Most words in a block, least blocks in a source and in its target, slots ranked together, and bits
#: of the cells in which a point looks for its source.
BLOCK, PARTS, CHUNK, CELL_BITS = 512, 1000, 1 << 15, 12
#: Documents of a source laid together, about.
SLICE = 1024
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Share sum(sizes) by weight; what would pass `most` times a source's size is shared again."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.remove(i)
    return out


def cut(size: int, target: float, block: int = BLOCK) -> tuple[int, int, int]:
    """(words in a block, number of blocks, number of slots that take `target` words) of a source; the last
    block of a pass may hold fewer words, so whole passes are counted by the source's size."""
    block = int(max(1, min(block, size // PARTS, target // PARTS)))
    n_blocks = max(1, -(-size // block))
    passes = int(target // size) if size else 0
    return block, n_blocks, passes * n_blocks + min(n_blocks, math.floor((target - passes * size) / block + 0.5))


def _prefix(df: DataFrame, by: list[str], order: str, col: str, out: str) -> DataFrame:
    """Exclusive running sum of `col`."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(col).over(w), F.lit(0)))


def _shuffled(prefix: str = "") -> Column:
    """Place of a row in the shuffle of its source."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(f"{prefix}doc_id").cast("string"), F.lit("")), F.coalesce(f"{prefix}text", F.lit(""))))


def lay_out(sized: DataFrame, n_docs: int) -> DataFrame:
    """Adds `at`, the words of the source laid before a row in the order of `mixed`.

    Sources are cut into slices by the first digits of the hash, some hundred documents each, so that
    neither a large source nor the corpus passes through one task: sums per slice, then sums inside it. Equal
    rows of one part of the table are laid as one, and counted in their part."""
    digits = max(0, math.ceil(math.log(max(n_docs / SLICE, 1), 16)))
    keys, same = ["source_no", "slice"], ["source_no", "mixed", "size", "part"]
    folded = sized.groupBy(*same).agg(F.count("*").alias("n")).withColumn("slice", F.substring("mixed", 1, digits))
    words = F.col("size") * F.col("n")
    bases = _prefix(folded.groupBy(*keys).agg(F.sum(words).alias("sum")), ["source_no"], "slice", "sum", "base")
    inside = Window.partitionBy(*keys).orderBy("mixed", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = folded.withColumn("before", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(bases.drop("sum"), keys)
    placed = placed.select(*same, (F.col("base") + F.col("before")).alias("first"))
    turn = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))) - 1
    return sized.withColumn("turn", turn).join(placed, same).withColumn("at", F.col("first") + F.col("turn") * F.col("size")).drop("turn", "first", "part")


_REVERSED = [int(f"{b:08b}"[::-1], 2) for b in range(256)]


def point(slot: Column) -> Column:
    """Van der Corput point of a slot, in units of 2^-BITS: the bits of its number in reverse."""
    byte = lambda i: F.get(F.lit(_REVERSED), F.shiftright(slot, 8 * i).bitwiseAND(F.lit(255)).cast("int")).cast("long")
    return sum((F.shiftleft(byte(i), BITS - 8 - 8 * i) for i in range(1, BITS // 8)), F.shiftleft(byte(0), BITS - 8))


def schedule(spark: SparkSession, needs: list[int]) -> DataFrame:
    """slot, source_no and rank (from 0) of the slots that sources with the given needs take.

    The sources' ends in the unit interval are listed under the cells they reach into, so that a point
    meets the few sources of its cell, however many there are. Every stretch of the interval as long as
    1 / sum(needs) holds a point of any 4 sum(needs) in a row, so the rounds end."""
    total = sum(needs)
    if total == 0:
        return spark.createDataFrame([], "slot long, source_no int, rank long")
    ends = [(stop << BITS) // total for stop in itertools.accumulate(needs, initial=0)]
    shift = BITS - CELL_BITS

    def drawn(first: int, stop: int, wanted: list[int]) -> DataFrame:
        rows = [(cell, i, ends[i], ends[i + 1]) for i in wanted for cell in range(ends[i] >> shift, ((ends[i + 1] - 1) >> shift) + 1)]
        listed = spark.createDataFrame(rows, "cell long, source_no int, low long, high long")
        slots = spark.range(first, stop).select(F.col("id").alias("slot"), point(F.col("id")).alias("point"))
        hit = slots.withColumn("cell", F.shiftright("point", shift)).join(F.broadcast(listed), "cell")
        return hit.where("low <= point and point < high").select("slot", "source_no")

    have, first, stop = [0] * len(needs), 0, total + total // 16 + 64
    found: DataFrame | None = None
    while wanted := [i for i, n in enumerate(needs) if have[i] < n]:
        if first > 16 * total + 1024:
            raise ValueError("the points leave out a source")
        part = drawn(first, stop, wanted)
        found = part if found is None else found.unionAll(part)
        for r in part.groupBy("source_no").count().collect():
            have[r["source_no"]] += r["count"]
        first, stop = stop, stop + stop // 2
    keys = ["chunk", "source_no"]
    cut_up = found.withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    bases = _prefix(cut_up.groupBy(*keys).agg(F.count("*").alias("n")), ["source_no"], "chunk", "n", "base")
    ranked = cut_up.withColumn("inside", F.row_number().over(Window.partitionBy(*keys).orderBy("slot")) - 1)
    ranked = ranked.join(bases.drop("n"), keys).select("slot", "source_no", (F.col("base") + F.col("inside")).alias("rank"))
    most = spark.createDataFrame(list(enumerate(needs)), "source_no int, need long")
    return ranked.join(F.broadcast(most), "source_no").where("rank < need").select("slot", "source_no", "rank")


def taken_words(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, schedule): the columns of `sized` (a written table: row, source, size, mixed, part) with
    source_size, target, `taken`, `first_slot`, and `rest`, what goes beyond whole copies of the row: it is
    taken from the row's beginning; `first` and `n_blocks` are the row's first block and its source's blocks.
    The schedule (slot, source_no, rank) is a written table."""
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
    cuts = [cut(n, t, block) for n, t in zip(sizes, aims)]
    rows = [(r["source"], i, r["size"], float(aims[i]), *cuts[i]) for i, r in enumerate(found)]
    table = spark.createDataFrame(rows, f"source {sized.schema['source'].dataType.simpleString()}, source_no int, source_size long, target double, words long, n_blocks long, need long")
    numbered = sized.join(F.broadcast(table), sized["source"].eqNullSafe(table["source"])).drop("source", "target", "words", "n_blocks", "need", "source_size")
    laid = lay_out(numbered, sum(r["n"] for r in found))

    # How often each block is used, and where first: rank r of a source takes block r mod its number of blocks.
    facts = table.drop("source")
    ranks = materialise(schedule(spark, [need for _, _, need in cuts]))
    block_of = F.pmod("rank", "n_blocks").alias("block")
    uses = ranks.join(F.broadcast(facts), "source_no").groupBy("source_no", block_of).agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
    first, last = F.expr("at div words"), F.expr("(at + size - 1) div words")
    cut_up = laid.where("size > 0").join(F.broadcast(facts.select("source_no", "words")), "source_no")
    pieces = cut_up.select("source_no", "at", "size", "words", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.col("block") * F.col("words")
    overlap = F.least(F.col("at") + F.col("size"), begin + F.col("words")) - F.greatest("at", begin)
    # Rows that hold a word are told apart by their place.
    got = pieces.join(uses, ["source_no", "block"]).groupBy("source_no", "at", "size").agg(F.sum(overlap * F.col("times")).alias("taken"), F.min("slot").alias("first_slot"))
    taken = F.coalesce("taken", F.lit(0).cast("long"))
    rest = F.when(F.col("size") > 0, taken % F.col("size")).otherwise(0)
    # Rows without a word share places with others.
    slot = F.when(F.col("size") > 0, F.col("first_slot"))
    full = laid.join(got, ["source_no", "at", "size"], "left").join(F.broadcast(facts), "source_no")
    return full.withColumns({"taken": taken, "rest": rest, "first_slot": slot, "first": first}), ranks


def _sized(rows: DataFrame, *keep: str, prefix: str = "") -> DataFrame:
    """The written table that the mix is made of."""
    text = F.col(f"{prefix}text")
    return materialise(rows.select(*keep, F.col(f"{prefix}source").alias("source"), word_count(text).alias("size"), _shuffled(prefix).alias("mixed"), F.spark_partition_id().alias("part")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot of every row."""
    rows, _ = taken_words(_sized(docs, "doc_id"), weights, block)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def materialise_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mixed corpus, sorted by slot: every row as often as the mix takes it whole, and the first words of
    a row that is taken in part; n_chars, where there is one, follows the new text. A copy stands at the slot
    in which its first block comes up once more. Rows are numbered and written, so that rows without an id
    and repeated rows find their own share again."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # The texts lie on disk three times here, once as this table and in two shuffles.
    numbered = materialise(docs.select(row, F.monotonically_increasing_id().alias("n")), "zstd")
    found, ranks = taken_words(_sized(numbered, "n", prefix="row."), weights)
    copies = F.expr("array_repeat(false, int(taken div size))")
    parts = F.when(F.col("rest") > 0, F.concat(copies, F.array(F.lit(True)))).otherwise(copies)
    each = found.where("taken > 0").select("n", "source_no", "first", "n_blocks", "rest", F.posexplode(parts).alias("turn", "part"))
    placed = each.withColumn("rank", F.col("first") + F.col("turn") * F.col("n_blocks")).join(ranks, ["source_no", "rank"]).select("n", "slot", "part", "rest")
    drawn = numbered.join(placed.hint("merge"), "n")
    words = F.array_remove(F.split("row.text", r"[\x20\x09-\x0D]+"), "")
    text = F.when(F.col("part"), F.array_join(F.slice(words, F.lit(1), F.col("rest").cast("int")), " ")).otherwise(F.col("row.text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("part"), F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    done = drawn.withColumn("text", text)
    made = F.struct(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]).alias("made")
    # Only what is returned goes to the ranges of slots.
    return done.select("slot", made).repartitionByRange("slot").sortWithinPartitions("slot").select("made.*")


#: The same rows in DuckDB: a source's need is met by whole passes over its blocks and by its first blocks.
ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS mixed
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (ARRAY[{", ".join(map(str, WEIGHTS))}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight,
         sum(source_size) OVER () AS total
  FROM sources
), levels AS (
  SELECT *, {MOST_REPEATS} * source_size AS most,
         (total - coalesce(sum({MOST_REPEATS} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source)
), aimed AS (
  SELECT *, CASE WHEN unit * weight > most THEN CAST(most AS DOUBLE)
                 ELSE max(unit) FILTER (unit * weight <= most) OVER () * weight END AS target
  FROM levels
), blocks AS (
  SELECT source, source_size, CAST(target AS DOUBLE) AS target,
         CAST(greatest(1, least({BLOCK}, source_size // {PARTS}, floor(target / {PARTS}))) AS BIGINT) AS words,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes
  FROM aimed
), needs AS (
  SELECT *, greatest(1, (source_size + words - 1) // words) AS n_blocks FROM blocks
), cuts AS (
  SELECT *, passes * n_blocks + least(n_blocks, CAST(floor((target - passes * source_size) / words + 0.5) AS BIGINT)) AS need FROM needs
), ends AS (
  SELECT source, need, sum(need) OVER () AS total, sum(need) OVER (ORDER BY source NULLS LAST) AS stop FROM cuts WHERE need > 0
), stretches AS (
  SELECT source, need, ((stop - need)::HUGEINT << {BITS}) // total AS low, (stop::HUGEINT << {BITS}) // total AS high FROM ends
), points AS (
  SELECT slot, list_sum(list_transform(range({BITS}), lambda i: ((slot >> i) & 1) << ({BITS} - 1 - i))) AS point
  FROM (SELECT unnest(range(0, 17 * (SELECT sum(need)::BIGINT FROM cuts) + 1024)) AS slot)
), slots AS (
  SELECT source, need, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM points JOIN stretches ON low <= point AND point < high
), laid AS (
  SELECT s.*, c.* EXCLUDE (source),
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY mixed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sized s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
)
SELECT l.doc_id, CAST(l.size AS BIGINT) AS size, l.source_size, l.target,
       CAST(l.size * (l.need // l.n_blocks) + greatest(0, least(l.size, (l.need % l.n_blocks) * l.words - l.place)) AS BIGINT) AS taken,
       CASE WHEN l.size > 0 THEN s.slot END AS first_slot
FROM laid l LEFT JOIN slots s ON l.source IS NOT DISTINCT FROM s.source AND s.rank = l.place // l.words AND s.rank < s.need
"""
