"""Operators that judge single texts: toxicity, perplexity, language, quality rules, main text."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import language_id, main_text, perplexity, quality_rules, toxicity
from tracewright.llm.textarrays import Chunk, windows, bounds

WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " \n\t", "one", "\x85word\xa0x \x0b y", "a b a b a b\na b\na b\n\n", "é" * 3000 + " #$ <x>", "w " * 20000, "a b a b a b\na b\na b\n\n"]


def test_words_and_hashes_equal_those_of_python():
    chunk = Chunk(pa.array(ODD))
    rows, starts, ends = chunk.words()
    raw = chunk.data.tobytes()
    found = [[] for _ in ODD]
    for r, s, e in zip(rows, starts, ends):
        found[r].append(raw[s:e].decode())
    want = [re.findall(WORD, t or "") for t in ODD]
    assert found == want
    h = chunk.hashes(starts, ends, chunk.sums())
    flat = [w for t in want for w in t]
    assert len(set(h.tolist())) == len(set(flat)) and len({(a, b) for a, b in zip(h.tolist(), flat)}) == len(set(flat))
    grams, row = windows(h, bounds(rows, len(ODD)), 5, short=True)
    assert [int(n) for n in np.bincount(row, minlength=len(ODD))] == [max(len(w) - 4, min(len(w), 1)) for w in want]


def counted(t):
    t = t or ""
    w = re.findall(WORD, t)
    tri, covered, seen, again = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for k in range(len(w) - 2):
        if tri[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    for line in t.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered)


def test_quality_counts_and_rules(spark):
    good = ["Word number %d of a text, and more of it. " % k * 1 + " ".join(f"w{k}x{j}" for j in range(60)) for k in range(80)]
    bad = " ".join(f"w{j}###$$$" for j in range(60))
    rows = [(k, t, None if k % 2 else "en", "s", 9) for k, t in enumerate([*ODD, *good, bad, bad])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, counts int").repartition(3)
    got = {r.doc_id: r for r in quality_rules.counts(docs, name="c").collect()}
    for k, t, *_ in rows:
        assert tuple(got[k].c)[:5] == counted(t), t and t[:40]
    kept = quality_rules.judge(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(ODD), len(ODD) + 80))
    assert quality_rules.judge(docs.limit(0)).count() == 0


@pytest.mark.parametrize("x", [0, 1, 15, 16, 17, 31, 32, 33, 1000, 12345, 10**9])
def test_buckets_hold_their_numbers(spark, x):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,)], "_x long").select("_x", quality_rules.bucket(F.col("_x")).alias("_b"))
    r = df.select("_b", quality_rules.bucket_top(F.col("_b")).alias("top")).first()
    assert x <= r.top <= x + x / 16


LANGS = {"aa": "the cat sat on the mat and saw the dog", "bb": "le chat est sur la table et voit le chien"}


def test_language(spark):
    rows = [(k, LANGS["aa" if k % 2 else "bb"] + f" {k}", "aa" if k % 2 else "bb", "x") for k in range(40)]
    more = [(100, None, "aa", "x"), (101, "12 34 !", "bb", "x"), (102, "", None, "x"), (103, "chatte tablette chienne", None, "x"), (104, "matting cats dogs", None, "x"), (1, rows[1][1], "aa", "x"), (105, "the cat " * 50000, None, "x")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, score string")
    model = language_id.fit(docs)
    assert model.langs == ["aa", "bb"]
    got = [(r.doc_id, r.p.lang, r.p.score) for r in docs.select("doc_id", language_id.predicted(docs, model).alias("p")).collect()]
    assert len(got) == len(rows) + len(more)
    lang = {d: x for d, x, _ in got}
    assert all(lang[k] == ("aa" if k % 2 else "bb") for k in range(40))
    assert [lang[k] for k in range(100, 106)] == ["und", "und", "und", "bb", "aa", "aa"]
    assert all(0 <= s <= 1 for *_, s in got)
    nothing = language_id.fit(docs.limit(0))
    assert {r.p.lang for r in docs.select(language_id.predicted(docs, nothing).alias("p")).collect()} == {"und"}


def test_backoff_takes_the_longest_known_grams():
    from tracewright.llm.letters import Letters

    texts = pa.array(["abc abd", None, "xyz", "é"])
    letters = Letters(texts)
    hashes, first, _ = letters.words()
    one = Letters(pa.array(["abc"])).words()[0]
    gram, _ = Letters(pa.array(["abd"])).grams(np.array([0]), 2)
    keys = [one, np.zeros(0, np.uint64), np.sort(gram), *[np.zeros(0, np.uint64)] * 3]
    logs = [np.array([[-1.0, -2.0]]), np.zeros((0, 2)), np.full((len(gram), 2), [-3.0, -5.0]), *[np.zeros((0, 2))] * 3]
    s = language_id.Model(["a", "b"], keys, logs).scores(letters)
    assert s[0].tolist() == [-2.0, -3.5] and np.isnan(s[1]).all() and s[2].tolist() == [language_id.UNSEEN] * 2


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(1)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]

    def text(bad):
        return " ".join([*rng.choice(words, 30), *(rng.choice(["vilex", "vilely", "nastium"], 3) if bad else [])])

    rows = [(k, text(k % 5 == 0), 1 if k % 5 == 0 else (0 if k % 2 else None), 0.0) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double")
    model = toxicity.fit(docs.where("doc_id < 400"))
    extra = spark.createDataFrame([(900, None, None, 0.0), (901, "", None, 0.0), (902, "so vilest " + "wai wbj " * 30000, None, 0.0)], docs.schema)
    scored = docs.where("doc_id >= 400").unionByName(extra)
    got = {r.doc_id: r.s for r in scored.select("doc_id", toxicity.scored(scored, model).alias("s")).collect()}
    called = {k for k, s in got.items() if s >= toxicity.CALLED}
    toxic = {k for k in range(400, 600) if k % 5 == 0}
    assert len(called & toxic) >= 0.95 * len(toxic) and len(called - toxic - {902}) == 0
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    for none in (docs.where("toxic = 0"), docs.limit(0)):
        model = toxicity.fit(none)
        assert all(r.s < 1e-6 for r in docs.limit(3).select(toxicity.scored(docs, model).alias("s")).collect())


def test_negative_risk_is_not_pushed_below_zero():
    # One feature that all confirmed rows and half of the others have: the hidden toxic half must not be called clean.
    positive = np.array([True] * 50 + [False] * 100)
    has = [[0]] * 50 + [[0]] * 50 + [[]] * 50
    indptr = np.concatenate([[0], np.cumsum([len(x) for x in has])])
    w, b = toxicity.train(indptr, np.concatenate([np.array(x, int) for x in has]), positive, 0.5, 1)
    assert w[0] + b > 0 > b


def kneser_ney(texts, order):
    """A direct dictionary version; the probability of the last character of a string after the others."""
    lead = " " * (order - 1)
    grams = Counter(t[k : k + order] for t in (lead + " ".join(x.split()) for x in texts) for k in range(len(t) - order + 1))
    tables = [grams]
    for _ in range(order - 1):
        tables.insert(0, Counter(g[1:] for g in tables[0]))

    def discount(table, c):
        n1, n2, n3, n4 = (sum(v == k for v in table.values()) for k in (1, 2, 3, 4))
        if not n1 or not n2:
            return (0.5, 0.75, 0.9)[min(c, 3) - 1]
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)[min(c, 3) - 1]
        return min(max(d, 0.1), min(c, 3) - 0.05)

    def p(g):
        table = tables[len(g) - 1]
        after = {k: c for k, c in table.items() if k[:-1] == g[:-1]}
        low = p(g[1:]) if len(g) > 1 else 1 / (len(table) + 1)
        if not after:
            return low
        total = sum(after.values())
        own = max(0, table[g] - discount(table, table[g])) if g in table else 0
        return own / total + sum(discount(table, c) for c in after.values()) / total * low

    return p


def test_perplexity_equals_a_direct_version(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "SHARD", 40)  # several shards, and several partial counts in a task
    texts = ["abab abba aab", "abc  abd\nabab", "bab cab dab", "aaaa bbbb abab abc", "cab abba", None, "", "zz abab", "abab abba aab"]
    docs = spark.createDataFrame([(k, t, "x" if k % 2 else None, 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, n int")
    docs = docs.unionByName(docs.where("doc_id = 0"))
    monkeypatch.setattr(perplexity, "HELD_BACK", 10**6)
    trusted = spark.createDataFrame([(k,) for k in range(4)], "doc_id long")
    got = perplexity.scores(docs, trusted).collect()
    assert len(got) == 10
    order = perplexity.ORDER
    p = kneser_ney([*texts[:4], texts[0]], order)
    for r in got:
        t = " " * (order - 1) + " ".join((texts[r.doc_id] or "").split())
        logs = [np.log(p(t[k : k + order])) for k in range(len(t) - order + 1)]
        assert r.n == len(logs)
        assert (r.log_perplexity is None) if not logs else r.log_perplexity == pytest.approx(-np.mean(logs), rel=1e-5)
    judged = {r.doc_id: r.kept for r in perplexity.judged(perplexity.scores(docs, trusted.limit(0))).collect()}
    assert judged[0] and not judged[5] and not judged[6]
    assert perplexity.judged(perplexity.scores(docs.limit(0), trusted)).count() == 0


def cut_cost(labels, content, boilerplate, edges):
    return sum(c if x else b for x, c, b in zip(labels, content, boilerplate)) + sum(w for u, v, w in edges if labels[u] != labels[v])


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        content, boilerplate = rng.integers(0, 6, n).tolist(), rng.integers(0, 6, n).tolist()
        edges = [(int(u), int(v), int(rng.integers(1, 4))) for u in range(n) for v in range(u) if rng.random() < 0.4]
        labels = main_text.minimum_cut(content, boilerplate, edges)
        best = min(cut_cost([m >> k & 1 for k in range(n)], content, boilerplate, edges) for m in range(1 << n))
        assert cut_cost(labels, content, boilerplate, edges) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this site better, and you agree.</p></div><script>var x = "<p>no</p>";</script>
<main><article class="post"><header><h1>The  title</h1></header><p>First &amp; <b>best</b> &#233;&nbsp;text.<br>Same block.<p>Second, which runs on
and on for some time.<form><label>Mail</label><button>Go</button></form><ul><li>An item<li>Another item</ul></article>
<section class="comments"><h2>Comments</h2><p>I think that this is a very good article indeed, and I say so at length.</p></section></main>
<aside><p>About the author, who is known for many other texts of this kind.</p></aside><footer>&copy; us</footer>"""


def test_main_text(spark):
    want = "The title\nFirst & best é text. Same block.\nSecond, which runs on and on for some time.\nAn item\nAnother item"
    long = "<article>" + "<p>Some words of a long page.</p>" * 5000 + "</article>"
    rows = [(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "<nav><a href=x>y</a></nav>", "x"), (5, "<p>a < b, <3 and more words here.", "x"), (6, long, "x"), (1, PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r.page_id, r.text) for r in main_text.extract(pages).collect())
    assert got == [(1, want), (1, want), (2, ""), (3, ""), (4, ""), (5, "a < b, <3 and more words here."), (6, "\n".join(["Some words of a long page."] * 5000))]
    assert main_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<script>for(i=0;i<n;i++) f(i);</script>{}",
    "<script>s = '<!--'; t = \"<style>\";</SCRIPT >{}<script>u = 1;</script>",
    "<style>a > b::after { content: '<p' }</style>{}",
    "<html><head><title>x</title><meta charset=utf-8><body>{}",
    "<head><title>x</title>{}",
    "<head><title>x</title></head>{}<svg><title>no</title></svg>",
    "<body><noscript>{}",
    "<svg class=icon>{}",
    "{}<script>var unclosed = '<p>Not a text, but code of a script.</p>';",
])
def test_main_text_behind_scripts_and_open_heads(page):
    article = "<article><p>Some words of a page that has to be told whole.</p><p>And more of them.</p></article>"
    assert main_text.main_text(page.replace("{}", article)) == "Some words of a page that has to be told whole.\nAnd more of them."


def test_unclosed_elements_cost_no_second_search():
    page = "<select>" * 200_000 + "<article><p>Some words of a page.</p></article>"
    assert main_text.main_text(page) == "Some words of a page."


def test_texts_are_counted_once_for_a_condition_on_their_counts(spark):
    rows = [("en", "a", "one two three " * 30), ("en", "a", None), (None, None, "x")]
    counted = quality_rules.counts(spark.createDataFrame(rows, "lang string, source string, text string")).drop("text")
    out = counted.where(~quality_rules.base_failed("counts")).select("lang", *[v.alias(k) for k, v in quality_rules.ratios("counts").items()])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert counted.orderBy("counts.n_words").selectExpr("counts.n_words").toPandas()["n_words"].tolist() == [0, 1, 90]
