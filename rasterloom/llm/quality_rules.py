"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Nulls count as empty texts, which fail the base rules; repeated rows and ties are judged row by row,
an empty table gives an empty result, and columns of the input other than the two named are ignored.
Whole texts are measured; nothing here is a user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Window, in words, of the repetition measure.
REPEAT_WINDOW = 8
#: Frequent function words of the four languages (lower case).
STOP_WORDS = (
    "the of and to in that was is for with on as at by it a an are be this from or not "  # English
    "der die das und ist ein eine von zu mit den dem des im nicht auf für als sich auch "  # German
    "le la les de des et un une du est en que qui dans pour par sur au pas ce elle il "  # French
    "el los las y del que es por con una su se al lo como para más no"  # Spanish
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes when its metric lies between low and high (None: open)."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are per word, but for line ratios, which are per line with a word.
RULES = (
    Rule("n_words", low=20),
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbol_ratio", high=0.15),
    Rule("shout_ratio", high=0.3),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("repeat_ratio", high=0.3),
)


def _arrays(text: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return {"words": F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), "lines": lines}


def _repeated_words() -> Column:
    """Words inside 8-word windows that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hash. Sorting (hash, start) puts equal windows side by side; the
    sorted starts of repeated windows then add up to covered words. Texts without an equal pair of
    windows, nearly all of them, stop at the distinct count."""
    k = REPEAT_WINDOW
    starts = F.sequence(F.lit(0), F.size("words") - k)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get("word_hashes", i + j) for j in range(k)]))
    return F.when(F.size("words") >= k, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered() -> Column:
    k = REPEAT_WINDOW
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        same = lambda a, i: F.get(pairs, i)["h"] == a["h"]
        hit = F.transform(
            pairs, lambda a, i: F.when((i > 0) & same(a, i - 1) | (i < last) & same(a, i + 1), a["i"])
        )
        return F.array_sort(F.array_compact(hit))

    # A let-binding by a one-element array keeps the sorted arrays from being computed per element.
    hits = F.get(F.transform(F.array(pairs), starts), 0)
    count = F.get(
        F.transform(
            F.array(hits),
            lambda s: F.aggregate(
                F.sequence(F.lit(0), F.size(s) - 1),
                F.lit(0),
                lambda acc, j: acc + F.least(F.lit(k), F.coalesce(F.get(s, j + 1) - F.get(s, j), F.lit(k))),
            ),
        ),
        0,
    )
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    return F.when(repeated, count).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, five base counts and the ratios that rules may name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("body"))
    arrays = base.select("doc_id", "body", *[c.alias(n) for n, c in _arrays(F.col("body")).items()])
    hashed = arrays.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    windows = hashed.withColumn("windows", _repeated_words())
    n_words = F.size("words")
    counted = windows.select(
        "doc_id",
        n_words.cast("long").alias("n_words"),
        F.length(F.translate("body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered().alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("body", F.lit("!")).alias("n_shouts"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(sorted(set(STOP_WORDS))))).alias("n_stop_words"),
    )
    per_word = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_words")), F.lit(0.0))
    return counted.withColumns(
        {
            "mean_word_chars": per_word("word_chars"),
            "symbol_ratio": per_word("n_symbols"),
            "shout_ratio": per_word("n_shouts"),
            "stop_word_ratio": per_word("n_stop_words"),
            "repeat_ratio": per_word("n_repeat_words"),
            "dup_line_ratio": F.coalesce(
                F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines")), F.lit(0.0)
            ),
        }
    )


def compile_rules(rules=RULES) -> Column:
    """The table as one boolean expression over the measured columns."""
    passed = F.lit(True)
    for rule in rules:
        value = F.col(rule.metric)
        if rule.low is not None:
            passed = passed & (value >= rule.low)
        if rule.high is not None:
            passed = passed & (value <= rule.high)
    return passed


def judge(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of every row with `base_failed` and the verdict `kept`."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measure(docs, id_col, text_col).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"),
    )


def _sql_condition(rule: Rule) -> str:
    parts = [f"{rule.metric} >= {rule.low}" if rule.low is not None else "", f"{rule.metric} <= {rule.high}" if rule.high is not None else ""]
    return " AND ".join(p for p in parts if p)


#: The same rows in DuckDB; repeated windows are compared as texts.
ORACLE_SQL = rf"""
WITH bodies AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS body FROM documents
), split AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM bodies
), windows AS (
  SELECT n, i, array_to_string(words[i : i + {REPEAT_WINDOW - 1}], ' ') AS w
  FROM (SELECT n, words, unnest(range(1, len(words) - {REPEAT_WINDOW - 2})) AS i FROM split)
), repeated AS (
  SELECT n, i FROM windows QUALIFY count(*) OVER (PARTITION BY n, w) > 1
), covered AS (
  SELECT n, sum(least({REPEAT_WINDOW}, coalesce(step, {REPEAT_WINDOW}))) AS n_repeat_words
  FROM (SELECT n, lead(i) OVER (PARTITION BY n ORDER BY i) - i AS step FROM repeated) GROUP BY n
), counted AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(body, '!')) AS n_shouts,
         len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}))) AS n_stop_words
  FROM split LEFT JOIN covered c USING (n)
), measured AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
         coalesce(n_shouts / nullif(n_words, 0), 0) AS shout_ratio, coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_word_ratio,
         coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM counted
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(map(_sql_condition, RULES))} AS kept
FROM measured
"""
