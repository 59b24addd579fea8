"""Secret scans: fixed patterns plus character Markov models, in built-in expressions only.

Two first-order character models, one of random strings and one of ordinary identifiers, are counted
from labelled samples; a long token whose log-likelihood ratio speaks for random is a span of kind
`markov`, unless a span of the fixed patterns holds it whole. Positions are code points of the whole text,
ends exclusive. Places, and the reach of spans before a place, are running sums and maxima taken block by
block, so that a very long text full of matches costs little more than its length.

A null text is empty and holds nothing; repeated rows are scanned alike; an empty table gives an empty
result; columns of the input never clash with those made here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns in the order of their kinds. `assign` wants 12 or more characters in group 2; the
#: lengths of the others are part of their patterns, which end at the same characters.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_.=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")

#: Characters of tokens lie between + and z.
LOW, WIDE, ALPHABET = 43, 80, 66
#: Expected number of documents that give labelled samples.
SAMPLE_DOCS = 1000
#: Entries of an array that are summed up together.
RUN = 128
SMOOTHING = 0.5
#: A token is random from this log-likelihood ratio per character pair on, and in total.
PER_PAIR, TOTAL = 0.6, 12.0


def labelled_samples(docs: DataFrame, bound: int = SAMPLE_DOCS) -> DataFrame:
    """(sample, label): 1 random, 0 ordinary, from about `bound` documents chosen by a hash of the id.

    Random: what the fixed patterns find there, and digests of the texts in the alphabets of keys.
    Ordinary: the texts' words, plain and joined as identifiers, paths and file names are, and numbers as
    dates, order and telephone numbers, book numbers, versions, dated paths and UUIDs are written."""
    n = docs.count()
    part = min(1.0, bound / max(n, 1))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40)) < max(1, int(part * (1 << 40))))
    texts = chosen.select(F.coalesce("text", F.lit("")).alias("body"))
    digest = F.sha2("body", 256)
    found = F.concat(
        F.regexp_extract_all("body", F.lit(ASSIGN), F.lit(2)),
        F.regexp_extract_all("body", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("body", F.lit(HEX), F.lit(0)),
        F.array(F.sha1("body"), F.rtrim(F.base64(F.unhex(digest)), F.lit("=")), F.base64(F.unhex(F.sha2("body", 384)))),
        F.array(F.translate(F.upper(digest), "01289", "GQSXZ"), F.lower(F.base64(F.unhex(F.sha2("body", 512))))),
    )
    random = texts.select(F.explode(F.filter(found, lambda s: F.length(s) >= 12)).alias("sample"), F.lit(1).alias("label"))
    plain = lambda w: w.rlike(r"^[A-Za-z]{2,}$") | w.rlike(r"^[A-Za-z][A-Za-z0-9_.-]{0,24}$") & ~w.rlike(r"[0-9a-f]{12}")
    words = texts.select(F.filter(F.split("body", r"[\s,;:!?@\"'()]+"), plain).alias("words"))
    triple = lambda sep, i: F.concat_ws(sep, *[F.get("words", i + k) for k in range(3)])
    joined = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3, F.lit(3)),
        lambda i: F.array(
            F.lower(triple("_", i)), triple("/", i), F.upper(triple("_", i)), F.lower(triple(".", i)),
            F.replace(F.initcap(triple(" ", i)), F.lit(" "), F.lit("")), F.lower(triple("-", i)),
        ),
    )
    joined = F.when(F.size("words") >= 3, F.flatten(joined)).otherwise(F.array().cast("array<string>"))
    ordinary = words.select(F.explode(F.concat("words", joined)).alias("sample"), F.lit(0).alias("label"))
    ordinary = ordinary.unionAll(texts.select(F.explode(_numbers(digest)).alias("sample"), F.lit(0).alias("label")))
    return random.unionAll(ordinary)


#: Ordinary numbers: `d` stands for a digit, `x` for a hexadecimal one, months and days are near enough.
NUMBERS = (
    "20dd-0d-1d", "20dd-1d-2d-0ddddd", "20dd/0d/1d", "20dd0d1ddddddd", "dddddddddddddddd", "ddd-ddddddd-ddddddd", "+dd-dd-dddddddd",
    "0dd-dddddddd", "978-d-dd-dddddd-d-ddddddd", "978ddddddddddd", "d.dd.dd-20dd0d1d", "v1.d.d-rc.d.20dd1d2d", "archive/20dd/0d/ddddddd.html",
    "dd.dd.20dd-dd.dd.20dd", "ORD-20dd-dddddddd", "INV-ddddddd-dd", "dddd-dddd-dddd-dddd", "xxxxxxxx-xxxx-4xxx-axxx-xxxxxxxxxxxx",
    *["xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxxxxxx"] * 5,
)


def _numbers(digest: Column) -> Column:
    """One sample of every form, filled with the digits of a digest, each form from another place on."""
    hexes = F.concat(digest, digest)
    digits = F.translate(hexes, "abcdef", "314159")

    def written(form: str, at: int) -> Column:
        parts = [F.substring(digits if c == "d" else hexes, 1 + (at + i) % 64, 1) if c in "dx" else F.lit(c) for i, c in enumerate(form)]
        return F.concat(*parts)

    return F.array(*[written(form, 3 * k) for k, form in enumerate(NUMBERS)])


def fit(samples: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """log p(next | char, random) - log p(next | char, ordinary) for every pair of characters. The driver
    receives one count per pair and label. Equal samples are counted before they fall into pairs."""
    clean = samples.where(F.col("sample").rlike(r"^[A-Za-z0-9+/_.=-]{2,}$")).groupBy("label", "sample").count()
    pairs = clean.select("label", "count", F.split("sample", "").alias("c")).select(
        "label",
        "count",
        F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.concat(F.get("c", i), F.get("c", i + 1)))).alias("pair"),
    )
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.sum("count").alias("n")).collect()}
    totals: dict[tuple[int, str], int] = {}
    for (label, pair), n in counts.items():
        totals[label, pair[0]] = totals.get((label, pair[0]), 0) + n

    def log_p(label: int, a: str, b: str) -> float:
        seen = counts.get((label, a + b), 0) + smoothing
        return math.log(seen / (totals.get((label, a), 0) + smoothing * ALPHABET))

    letters = [chr(LOW + i) for i in range(WIDE)]
    return [round(log_p(1, a, b) - log_p(0, a, b), 4) for a in letters for b in letters]


def _ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of a token, summed over its pairs of neighbouring characters."""
    code = lambda c, i: F.ascii(F.get(c, i)) - LOW
    total = lambda c: F.aggregate(
        F.sequence(F.lit(0), F.size(c) - 2),
        F.lit(0.0),
        lambda acc, i: acc + F.get(table, code(c, i) * WIDE + code(c, i + 1)),
    )
    return F.get(F.transform(F.array(F.split(token, "")), total), 0)


def _later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _running(values: Column, op) -> Column:
    """Every prefix of an array of ints put through `op` (sum or greatest): within blocks of RUN entries,
    and over the blocks, so that no array is built entry by entry at its full length."""
    ints = lambda: F.array().cast("array<int>")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def scan(items: Column, base: Column) -> Column:
        step = lambda acc, v: state(op(acc["at"], v), F.concat(acc["out"], F.array(op(acc["at"], v))))
        return F.aggregate(items, state(base, ints()), step, lambda acc: acc["out"])

    last = F.floor((F.size(values) - 1) / RUN).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * RUN + 1, F.lit(RUN)))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), op))
    bases = F.concat(F.array(F.lit(0)), scan(totals, F.lit(0)))
    each = F.zip_with(blocks, bases, lambda x, base: F.when(x.isNotNull(), scan(x, base)).otherwise(ints()))
    return F.when(F.size(values) > 0, F.flatten(each)).otherwise(ints())


def with_spans(docs: DataFrame, table: list[float], text_col: str = "text") -> DataFrame:
    """Columns `row` (the input row), `body` (its text), `base` and `all`: sorted spans."""
    model = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    patterns = (ASSIGN, ACCESS, HEX, TOKEN)
    kinds = range(len(patterns))
    found = body.select("row", "body", *[F.regexp_extract_all("body", F.lit(p), F.lit(0)).alias(f"m{i}") for i, p in enumerate(patterns)])
    # The text between the matches, by the same pattern, gives their places by adding lengths.
    gaps = lambda i: F.when(F.size(f"m{i}") > 0, F.split("body", patterns[i])).otherwise(F.array().cast("array<string>"))
    both = lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))
    sized = found.select("*", *[F.zip_with(gaps(i), F.col(f"m{i}"), both).alias(f"w{i}") for i in kinds])
    ended = sized.select("row", "body", *[f"m{i}" for i in kinds], *[_running(F.col(f"w{i}"), lambda a, b: a + b).alias(f"e{i}") for i in kinds])

    def random(m: Column) -> Column:
        ratio = _ratio(m, model)
        return ratio >= F.greatest(F.lit(TOTAL), (F.length(m) - 1) * PER_PAIR)

    yes = lambda m: F.lit(True)
    keep = (lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12, yes, yes, random)

    def spans(i: int) -> Column:
        span = lambda m, stop: F.when(
            m.isNotNull() & keep[i](m), F.struct((stop - F.length(m)).alias("start"), F.lit(i).alias("kind"), stop.alias("stop"))
        )
        return F.array_compact(F.zip_with(f"m{i}", f"e{i}", span))

    placed = ended.select("row", "body", *[spans(i).alias(f"s{i}") for i in kinds])
    based = placed.select("row", "body", F.sort_array(F.concat("s0", "s1", "s2")).alias("base"), F.sort_array(F.concat("s0", "s1", "s2", "s3")).alias("merged"))
    # A span of the models stays unless one of the patterns' that starts no later reaches its end.
    own = F.transform("merged", lambda s: F.when(s["kind"] < 3, s["stop"]).otherwise(0))
    reached = based.select("row", "body", "base", "merged", _running(own, _later).alias("reach"))
    adds = F.zip_with("merged", "reach", lambda s, r: F.when((s["kind"] < 3) | (r < s["stop"]), s))
    return reached.select("row", "body", "base", F.array_compact(adds).alias("all"))


def _written(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    text = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])
    return F.array_join(F.transform(spans, text), ",")


def scan(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, counts by kind, digest of the fixed patterns' spans, and all spans as text."""
    table = table or fit(labelled_samples(docs))
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    return with_spans(docs.select("doc_id", "text"), table).select(
        "row.doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_written("base"), 256).alias("base_sha256"),
        _written("all").alias("spans"),
    )


def redact(docs: DataFrame, table: list[float] | None = None, mask: str = "[SECRET]") -> DataFrame:
    """The rows of `docs` with every span of their texts masked, overlapping spans by one mask; n_chars,
    where there is one, follows the new text."""
    table = table or fit(labelled_samples(docs))
    spans = with_spans(docs, table)
    reached = spans.select("row", "body", "all", _running(F.transform("all", lambda s: s["stop"]), _later).alias("reach"))
    before = F.concat(F.array(F.lit(0)), F.col("reach"))

    def masked_by(part) -> Column:
        """Each text before a span that begins beyond all earlier ones, with its mask; then the rest."""
        fresh = lambda s, r: F.when(s.isNull(), part(r, F.length("body"))).when(s["start"] >= r, F.concat(part(r, s["start"]), F.lit(mask))).otherwise("")
        return F.array_join(F.zip_with("all", before, fresh), "")

    # Cutting a text by place walks it from its start, so where spans are many its letters are laid out.
    few = masked_by(lambda a, b: F.substring("body", a + 1, b - a))
    letters = reached.select("*", F.when(F.size("all") > RUN, F.split("body", "")).alias("letters"))
    many = masked_by(lambda a, b: F.array_join(F.slice("letters", a + 1, b - a), ""))
    masked = F.when(F.size("all") > RUN, many).otherwise(few)
    text = F.when(F.size("all") > 0, masked).otherwise(F.col("row.text"))
    done = letters.select("row", text.alias("new_text"), (F.size("all") > 0).alias("hit"))
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("hit"), F.length("new_text").cast(kind)).otherwise(F.col("row.n_chars"))
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
