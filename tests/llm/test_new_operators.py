"""Collocations, ranked search and url rules against brute force, with odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import collocations, lexical, urls

from .conftest import SCHEMA, odd_texts, prose, rows_of

# -- collocations


def grams(docs, longest):
    """Occurrences of all runs of words per language."""
    out = {}
    for lang, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                out.setdefault(lang or "und", Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return out


def plain_collocations(docs, least, longest, share, top):
    rows = []
    for lang, f in grams(docs, longest).items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        found = {g: v for g, v in f.items() if v >= least}
        covered = Counter()
        for g, v in found.items():
            for s in range(2, len(g)):
                for i in range(len(g) - s + 1):
                    covered[g[i : i + s]] = max(covered[g[i : i + s]], v)
        scored = []
        for g, a in found.items():
            if len(g) > 1 and not (g in covered and 100 * covered[g] >= share * a):
                score, _, l, r = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), l, r))
        rows += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(rows)


def spoken(rng, n):
    """Texts of few words with fixed phrases in them, so that all lengths recur."""
    words, out = [f"w{i}" for i in range(40)], []
    phrases = [["the", "quick", "brown", "fox", "jumps"], ["New", "york"], ["a", "b", "a", "b", "a", "b"], ["x"] * 6]
    for _ in range(n):
        text = []
        for _ in range(rng.randrange(1, 40)):
            text += rng.choice(phrases) if rng.random() < 0.2 else [rng.choice(words)]
            if rng.random() < 0.1:
                text[-1] += rng.choice([".", ",", "?", "\n", "\x0b", "\r\n", ";", ":", "!"])
        out.append((rng.choice(["en", "de", None, "é"]), rng.choice([" ", "\t", "  "]).join(text)))
    return out


def mined(spark, docs, **kw):
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({"doc_id": F.lit(1).cast("long"), "ids": F.lit("x"), "n": F.lit(2), "rank": F.lit(0)})
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.mine(df, **kw).collect())


@pytest.mark.parametrize("least,share,top,phrases", [(5, 100, 2000, 1 << 18), (3, 80, 7, 50), (2, 100, 2000, 300)])
def test_collocations_match_brute_force(spark, monkeypatch, least, share, top, phrases):
    """Also where several tries, carried one at a time, hold the candidates and texts come in small portions."""
    monkeypatch.setattr(collocations, "PHRASES", phrases)
    if phrases < 1000:
        monkeypatch.setattr(collocations, "CARRIED", 1)
        monkeypatch.setattr(collocations, "PORTION", 200)
        monkeypatch.setattr(collocations, "ROW", 5)
        monkeypatch.setattr(collocations, "WINDOWS", 64)
    docs = spoken(random.Random(least), 120) + [("en", None), (None, ""), ("en", " \t\n"), ("en", ". . .")]
    assert mined(spark, docs, least=least, share=share, top=top) == plain_collocations(docs, least, 5, share, top)


def test_collocations_of_odd_tables(spark, odd, empty):
    assert collocations.mine(empty).count() == 0
    docs = [(r.lang, r.text) for r in odd.collect()]
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.mine(odd, least=4).collect())
    assert got == plain_collocations(docs, 4, 5, 100, 2000)
    # Every row repeated: all counts double.
    twice = collocations.mine(odd.unionAll(odd), least=8).select("phrase", (F.col("a") / 2).cast("long").alias("a")).collect()
    assert {(r.phrase, r.a) for r in twice} == {(p, a) for _, _, p, a, *_ in plain_collocations(docs, 4, 5, 100, 2000)}


def test_collocations_retry_when_words_meet_in_one_identity(spark, monkeypatch):
    docs = spoken(random.Random(1), 60)
    real, seeds = collocations.word_hashes, []

    def poor(blob, starts, seed):
        seeds.append(seed)
        return real(blob, starts, seed) & np.uint64(3) if seed == 17 else real(blob, starts, seed)

    # In the driver's own process: rows by hand, as workers import the module anew.
    def laid(seed):
        x, heads, found, times = collocations._laid([t.encode() for _, t in docs], "en", seed)
        rows = [(bytearray(r), None, None, None, None) for r in collocations._rows(x)]
        return spark.createDataFrame([*rows, (None, "en", heads.tolist(), found, times.tolist())], collocations.TOKENS)

    monkeypatch.setattr(collocations, "word_hashes", poor)
    monkeypatch.setattr(collocations, "tokens", lambda _, seed: laid(seed))
    table, words = collocations.identified(spark.createDataFrame([], "lang string, text string"))
    assert words.count() == len({w for _, t in docs for w in re.findall(r"[^\s.,;:!?]+", t.lower())}) and set(seeds) == {17, 18}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000_017
    found = spark.createDataFrame([([1], big - 5), ([2], big - 11), ([1, 2], big - 1000)], "ids array<long>, f long")
    heads = spark.createDataFrame([(1, "en", "a", 5 * big + 3), (2, "en", "b", 5 * big + 3)], "id long, lang string, word string, total long")
    assert collocations.scored(found, heads).first()["score"] == 1000 * (big - 1000) * (5 * big + 3) // ((big - 5) * (big - 11))


def test_tries_count_like_a_scan():
    rng = np.random.default_rng(5)
    assert collocations.build([]).counts(np.arange(3, dtype=np.uint64), 5).sum() == 0
    for _ in range(20):
        x = rng.integers(0, 7, 400).astype(np.uint64) * np.uint64(1 << 59)
        phrases = [p for p in {tuple(rng.choice(x, rng.integers(2, 6)).tolist()) for _ in range(60)} if 0 not in p]
        trie = collocations.build([np.array(p, np.uint64) for p in phrases])
        got = trie.counts(x, 5)
        counted = {tuple(trie.phrase(s).view(np.uint64).tolist()): int(got[s]) for s in np.flatnonzero(got)}
        rows = x.tolist()
        assert counted == {p: c for p in phrases if (c := sum(tuple(rows[i : i + len(p)]) == p for i in range(len(rows))))}


# -- ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, found = set(terms_of(text)), []
        for i, c in held:
            m = 10 + 90 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda f: (f[0], f[1], 0 if f[1] else f[2]))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


def searched(docs, items, **kw):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(docs, items, **kw).collect()), key=repr)


@pytest.mark.parametrize("cells,items,terms,leaf", [(1 << 22, 256, 1 << 14, 16), (2000, 256, 1 << 14, 2), (30, 3, 5, 1)])
def test_search_matches_brute_force(spark, monkeypatch, cells, items, terms, leaf):
    for name, v in (("CELLS", cells), ("ITEMS", items), ("TERMS", terms), ("LEAF", leaf)):
        monkeypatch.setattr(lexical, name, v)
    rng = random.Random(cells)
    copy = prose(rng, 60, 80)
    texts = odd_texts() + [prose(rng, rng.randrange(1, 120), 80) for _ in range(150)] + [copy] * 40 + ["ß É-e_f", "A" * 5000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[5] = ids[9] = None
    rows = rows_of(texts, ids)
    asked = [(1, prose(rng, 30, 80)), (2, None), (3, "zz-nowhere"), (4, copy), (4, "w1 W1 w2"), (None, "é ß"), (7, prose(rng, 300, 5000))]
    docs, items_ = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "item_id long, text string")
    assert searched(docs, items_.withColumn("rank", F.lit(1))) == plain_search([(r[0], r[1]) for r in rows], asked)


def test_search_over_every_worker_size(spark):
    """Trees of one task and of many give the same ranking, in the process itself."""
    rng = random.Random(2)
    docs = [(i, prose(rng, rng.randrange(1, 60), 50)) for i in range(300)]
    question = lexical.Question([np.arange(8), np.array([3, 20, 31])], np.arange(50, dtype=np.int64) * 7 + 1, np.random.default_rng(1).permutation(50), len(docs), 9000)
    codes = {f"w{i}".encode(): i for i in range(50)}
    terms = [Counter({codes[t]: n for t, n in lexical.term_counts(text.encode()).items()}) for _, text in docs]
    arrays = [(np.array(list(c), np.int32), np.array(list(c.values()), np.int32)) for c in terms]
    norms = np.array([10 + c.total() for c in terms], np.int64)
    for size in (300, 17, 1):
        for item in question.items:
            best, want = [], []
            for a in range(0, 300, size):
                part = slice(a, a + size)
                tree = lexical.Tree([i for i, _ in docs[part]], norms[part], [t for t, _ in arrays[part]], [k for _, k in arrays[part]], question)
                best = tree.search(item, best, 10)
            for (i, _), c, m in zip(docs, terms, norms.tolist()):
                s = sum(int(question.weights[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in item.tolist() if t in c)
                if s:
                    want.append((-s, False, i))
            assert best == sorted(want)[:10]


def test_search_of_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "one a b")], "item_id long, text string")
    assert lexical.search(empty, items).count() == 0 and lexical.search(odd, items.limit(0)).count() == 0
    assert lexical.search(odd.where("text is null"), items).count() == 0
    assert lexical.search(odd, items).columns == ["item_id", "rank", "doc_id", "score"]


# -- url rules

URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.example.com/en", "http://example.com", "ftp://net/es/a",
    "http://b.net/es/", "http://b.net/ES/", "http://xnet/fr/", "http://c.net/fr/?casino", "http://play-casino.org/", "http://casinos.org/", "http://x.org/casino-royale/",
    "http://x.org/a?PHPSESSID=1", "http://x.org/a?b=1&sessionid=4", "http://x.org/cart/7/checkout/", "http://x.org/wp-login.php", "http://é.org/adult/education?adult",
    "http://x.org/adult-education", "a://b://c/d", "http://x.org:80/poker#poker", "http://x.org/payday-loans", "http://x.org/\n/casino\n", "//x.net/fr/", "://net/fr/://com/",
]


def plain_judge(url, rules):
    after = (url or "").split("://", 1)
    rest = after[1] if len(after) == 2 else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    whole, best = lower(rest), None
    host = lower(host)
    fits = {"allow": [], "block": []}
    for r in rules:
        if r.site:
            rule_host, rule_path = r.text[: r.host_length], r.text[r.host_length :]
            if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
                best = max(best or (0, 0, "", ""), (len(r.text), r.host_length, r.verdict, r.text))
        elif re.search(r.pattern, whole):
            fits[r.verdict].append(r.text)
    if best:
        return host, path, best[3], best[2], None
    blocked = bool(fits["block"]) and not fits["allow"]
    pattern = min(fits["block"], default=None) if blocked else min(fits["allow"], default=None)
    return host, path, None, "block" if blocked else "allow", pattern


def judged(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("h"), "rule": F.lit("r"), "size": F.lit(1), "html": F.lit(None).cast("string")})
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.pattern) for r in urls.judge(df, **kw).collect()), key=repr)


EXTRA = (urls.site_rule("block", "example.org", ""), urls.site_rule("allow", "example.org", "/p"), urls.site_rule("block", "a.example.org", "/p"), urls.site_rule("block", "example.org", "/p")) + tuple(
    urls.pattern_rule("block", f"^bad{i}^") for i in range(40)
) + (urls.pattern_rule("block", "ugly"), urls.pattern_rule("allow", "ug*y^ok"))


@pytest.mark.parametrize("rules,at_once", [(urls.RULE_LIST, 20_000), (urls.RULE_LIST + EXTRA, 7), (EXTRA, 1), ((), 5)])
def test_urls_are_judged_like_all_rules_on_all_urls(spark, monkeypatch, rules, at_once):
    monkeypatch.setattr(urls, "RULES", at_once)
    more = ["http://example.org", "http://example.orgx/p", "http://a.example.org/page", "http://b.example.org/p?ugly", "http://x.org/bad7/", "http://x.org/bad70/", "http://x.org/uglyduck", "http://x.org/ug-y-ok/ugly"]
    rows = [(i, u) for i, u in enumerate(URLS + more)] + [(None, "http://casino.org"), (1, "http://b.net/es/"), (1, "http://b.net/es/")]
    assert judged(spark, rows, rules=tuple(rules)) == sorted(((i, *plain_judge(u, rules)) for i, u in rows), key=repr)


def test_rules_are_listed_by_their_rarest_whole_token():
    rules = (urls.pattern_rule("block", "^cheap^pharmacy^"), urls.pattern_rule("block", "^payday^loan"), urls.site_rule("allow", "example.com", "/en"), urls.pattern_rule("block", "open"))
    index = urls.listed(rules, {"cheap": 9, "pharmacy": 2, "payday": 50, "loan": 0, "example": 7, "com": 7, "en": 1})
    assert {t: [r.text for r in rs] for t, rs in index.items()} == {"pharmacy": ["^cheap^pharmacy^"], "payday": ["^payday^loan"], "example": ["example.com/en"], None: ["open"]}


def test_only_fetched_rules_run(spark):
    """A rule whose token no url holds never runs its expression."""
    wrong = urls.Rule("never", "block", "(", ("tokenthatisnowhere",))
    assert {r[4] for r in judged(spark, [(1, "http://x.org/a")], rules=(wrong,))} == {"allow"}


def test_urls_of_an_empty_table(spark):
    assert judged(spark, []) == []
