"""Inputs that the tables lack: ids beyond 2^53 beside null ids, odd markup, junk sources, clashing names, rare languages."""

import random
import time

import pytest

import corpus_pipeline
from tracewright.llm import language_id, main_text, packing, quality_rules, toxicity


def test_packing_keeps_large_ids_beside_null_ids(spark):
    ids = [9007199254740993, 9007199254740995, -9007199254740993, None, None, 0, 7]
    docs = spark.createDataFrame([(i, "some words " * k, 1) for k, i in enumerate(ids)], "doc_id long, text string, missing int")
    got = packing.pack(packing.pieces(docs)).collect()
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in got)
    length = {(r.doc_id, r.length) for r in got}
    assert length == {(r.doc_id, r.length) for r in packing.pieces(docs).collect()}


TWO = "<p>Some words of a page that has to be told whole.</p>"


@pytest.mark.parametrize("page", [
    "<article><p class=it's>Some words of a page that has to be told whole.</p><p>Don't lose it.</p></article>",
    "<article><!-->" + TWO + "<p>Don't lose it.</p><!-- b --></article>",
    "<article><!--->" + TWO + "<p>Don't lose it.</p></article>",
    "<article><!-- a --!>" + TWO + "<p>Don't lose it.</p></article>",
    "<article><p data-x = 'a>b' title=\"c>d\" hidden2 x=>Some words of a page that has to be told whole.<p =y z==\"q>Don't lose it.</p></article>",
    "<article>" + TWO + "<p>Don't lose it.</p></article><p hidden class=x>This is not shown to anybody at all, it is said.</p>",
    "<article>" + TWO + "<p>Don't lose it.</p></article><p class=x hidden=''>This is not shown to anybody at all, it is said.</p>",
])
def test_markup_as_browsers_read_it(page):
    assert main_text.main_text(page) == "Some words of a page that has to be told whole.\nDon't lose it."


def test_the_cut_of_alternating_blocks_is_not_quadratic():
    def page(n):
        return "".join(f"<div><p>Some words of a text block number {k}, which go on.</p><a href=x>link {k}</a></div>" for k in range(n))

    def took(n):
        t = time.process_time()
        main_text.main_text(page(n))
        return time.process_time() - t

    took(100)
    assert took(8000) < 30 * max(took(800), 0.02)


def lines(rng, n, share, of=20):
    """``n`` lines of five words, of which a share repeats earlier lines."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    new = [" ".join(word() for _ in range(5)) for _ in range(n - round(n * share))]
    return "\n".join(new + [rng.choice(new) for _ in range(round(n * share))])


def words(rng, n, share):
    """``n`` words of which a share lies in three-word windows that stand twice."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    block = [word() for _ in range(round(n * share / 2))]
    return " ".join([word() for _ in range(n - 2 * len(block))] + block + [word()] + block)


@pytest.mark.parametrize("make", [lines, words])
def test_a_few_junk_rows_in_a_clean_source_go(spark, make):
    rng = random.Random(1)
    rows = [(k, make(rng, 100, 0), "en", "s") for k in range(300)]
    rows += [(1000 + k, make(rng, 100, s), "en", "s") for k, s in enumerate([0.27, 0.35, 0.45])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality_rules.judge(docs).collect()} == set(range(300))


@pytest.mark.parametrize("make", [lines, words])
def test_a_source_of_which_a_third_is_junk(spark, make):
    rng = random.Random(2)
    rows = [(k, make(rng, 100, 0), "en", "s") for k in range(200)] + [(1000 + k, make(rng, 100, 0.39), "en", "s") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality_rules.judge(docs).collect()} == set(range(200))


def test_a_source_that_repeats_by_its_nature_has_wider_bounds(spark):
    rng = random.Random(3)
    rows = [(k, lines(rng, 40, rng.choice([0.1, 0.13, 0.15, 0.18, 0.2])), "en", "verse") for k in range(200)]
    rows += [(1000 + k, lines(rng, 40, 0), "en", "prose") for k in range(200)] + [(2000, lines(rng, 40, 0.27), "en", "prose"), (2001, lines(rng, 40, 0.2), "en", "verse")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality_rules.judge(docs).collect()} == set(range(200)) | set(range(1000, 1200)) | {2001}


NAMES = ["_id", "_hash", "_group", "_bound", "_rows", "_lang", "_n", "group", "stay_id", "taken_hash", "counts", "kept", "language", "turn"]


def test_pipeline_stages_with_clashing_names(spark):
    rng = random.Random(4)
    rows = [(k, words(rng, 80, 0), "aa", "s", 1, *NAMES) for k in range(30)]
    rows += [(100, rows[0][1], "aa", "s", 1, *NAMES), (0, rows[0][1], "aa", "s", 1, *NAMES)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"{c} string" for c in NAMES]]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        assert got.select(*NAMES).distinct().collect() == [tuple(NAMES)], name


def test_samples_of_rows_without_an_id(spark):
    rows = [(None, f"text number {k} of many", "en", 0) for k in range(20_000)] + [(5, f"text {k} of one id", "de", 0) for k in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)
    got = {r.lang: r["count"] for r in language_id.sample(docs, "lang", "doc_id", "text").groupBy("lang").count().collect()}
    assert all(1700 < got[x] < 2300 for x in ("en", "de"))
    assert 850 < toxicity.sample(docs.where("doc_id is null"), 20_000, 1000, "x").count() < 1150


def test_a_rare_language_keeps_its_words(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ENTRIES", 600)
    rng = random.Random(5)
    sound = {x: [a + b for a in f"bcdfg{x}{x}" for b in "aeiou"] for x in "klmnp"}
    word = lambda x: "".join(rng.choice(sound[x]) for _ in range(3))
    own = {x: [word(x) for _ in range(200)] for x in sound}
    rare = [w[::-1] for w in own["k"][:60]]
    text = lambda w: " ".join(rng.choices(w, k=40))
    rows = [(k, text(own[x]), x * 2) for k, x in enumerate("klmnp" * 200)] + [(5000 + k, text(rare), "zz") for k in range(8)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, text(rare)), (2, text(own["m"]))], "doc_id long, text string")
    got = {r.doc_id: r.lang for r in docs.select("doc_id", language_id.predicted(docs, model)["lang"].alias("lang")).collect()}
    assert got == {1: "zz", 2: "mm"}
