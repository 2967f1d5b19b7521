"""Periodic runs, divergence of sources and SimHash links, held against direct versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash

from tracewright.llm import divergence, periodic, queries, simhash

SF = "/root/testdata/sf0.001"


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# Periodic runs


def runs_of(w):
    """All runs, by comparing words at every distance."""
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        same = np.array([w[i] == w[i + q] for i in range(n - q)])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(int), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            length = b + q - a
            if length >= max(6, 4 * q) and not any((w[a : a + length - p] == w[a + p : a + length]) for p in range(1, q)):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_of(w, runs):
    gone = {k for a, length, q in runs for k in range(a + q, a + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic_texts():
    rng = random.Random(4)
    texts = []
    for _ in range(150):
        w = []
        while len(w) < rng.randrange(1, 120):
            kind = rng.randrange(4)
            if kind == 0:
                w += [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            elif kind == 1:
                w += [rng.choice("abc") for _ in range(rng.randrange(1, 24))] * rng.randrange(1, 8)
            elif kind == 2 and w:
                w += w[rng.randrange(len(w)) :][: rng.randrange(1, 30)]
            else:
                x, y = ["a"], ["a", "b"]  # words of Fibonacci, full of cubes
                for _ in range(rng.randrange(1, 7)):
                    x, y = y, y + x
                w += y
        texts.append(w)
    return texts


def test_runs_equal_those_of_all_distances():
    texts = periodic_texts()
    at = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
    text, start, length, period = periodic.runs(np.array([ord(x) for w in texts for x in w], np.uint64), at)
    for k, w in enumerate(texts):
        mine = text == k
        assert list(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist())) == runs_of(w)


def test_run_query_against_a_direct_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert got.keys() == docs.keys()
    altered = 0
    for i, t in docs.items():
        w = words_of(t)
        if len(w) > 3000:
            continue
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, altered = [w[k if k < a else a + (k - a) % p] for k in range(n)], altered + 1
        runs, r = runs_of(w), got[i]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (best[1] * 1000 // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed_of(w, runs).encode()).hexdigest()
    assert altered > 5


def test_runs_of_odd_tables(spark):
    long = "x " * 300_000 + "a bc " * 100_000
    rows = [(None, None, 1), (1, "", 1), (1, " \n\t", 1), (2, "a a a a a a", 1), (2, "a a a a a", 1), (3, "Ä ä Ä ä  Ä ä Ä ä", 1), (4, "\na\nb a b\ta b a b a", 1), (5, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(2)
    got = {(r.doc_id, r.n_words, r.collapsed): [tuple(x) for x in r.runs] for r in periodic.find(docs).collect()}
    assert got == {
        (None, 0, ""): [], (1, 0, ""): [], (2, 6, "a"): [(0, 6, 1)], (2, 5, "a a a a a"): [],
        (3, 8, "Ä ä Ä ä  Ä ä Ä ä"): [], (4, 9, "a b"): [(0, 9, 2)], (5, 500_000, "x a bc"): [(0, 300_000, 1), (300_000, 200_000, 2)],
    }
    assert periodic.find(docs.limit(0)).count() == 0


def test_synchronising_sets_are_sparse_and_leave_no_gap():
    rng = np.random.default_rng(3)
    w = np.tile(rng.integers(0, 500, 4000), 2).astype(np.uint64)
    names = [periodic.named(np.zeros(8000, np.int64), np.unique(w, return_inverse=True)[1])]
    while (names[-1] >= 0).any():
        names.append(periodic.doubled(names[-1], 1 << (len(names) - 1)))
    for k in (3, 5, 7):
        at = periodic.chosen(names, k, periodic.regions(names, k))
        at = at[at < 3000]
        assert np.diff(at).max() <= 1 << k and len(at) < 5 * 3000 / (1 << k)


# Divergence


def divergence_of(rows):
    texts = [(a or "", b or "", [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for t, a, b in rows]
    out = []
    for lang in {a for a, _, _ in texts}:
        df = Counter(x for a, _, w in texts if a == lang for x in set(w))
        kept = sorted(x for x in df if df[x] >= 10)
        count = {s: Counter(x for a, b, w in texts if (a, b) == (lang, s) for x in w if x in set(kept)) for s in {b for a, b, _ in texts if a == lang}}
        p = lambda c: {x: 1 + 10**9 * (c[x] + 2) // (sum(c.values()) + 2 * len(kept)) for x in kept}
        whole = p(sum(count.values(), Counter()))
        of = {s: p(c) for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pair = [(o, sum(f(of[s][x], of[o][x]) for x in kept)) for o in count if o != s]
            term = [(x, f(of[s][x], whole[x])) for x in kept if count[s][x] and of[s][x] > whole[x]]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda e: (-e[1], e[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(found, 1) if part == "pair" or r <= 10]
    return sorted(out)


@pytest.mark.parametrize(("tile", "block"), [(1024, 64), (4, 2)])
def test_divergence(spark, monkeypatch, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(8)
    vocab = "The the été Été naïve x1y a_b Zoo zoo ß Ω don't e-mail 日本 語".split() + [f"w{chr(97 + k)}" for k in range(26)] * 2
    rows = [(" ".join(rng.choices(vocab, k=rng.randrange(0, 40))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "ü", None, "hot", "hot"])) for _ in range(250)]
    rows += [("rare words", "xx", "a"), (None, "xx", "b"), ("", "xx", None), (None, None, None), ("the " * 5000, "en", "hot"), ("1 2 3", "en", "none")] + [rows[0]] * 3
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, value int").repartition(3)
    got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs).collect())
    assert got == divergence_of(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_long_terms_of_two_letters_stay_apart(spark):
    a = "a"
    for _ in range(11):  # the Thue-Morse word, which sums modulo 2^64 can't tell from its complement
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(k, f"{a} {b} other", "en", "st"[k % 2]) for k in range(12)] + [(20 + k, a, "en", "s") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs).collect())
    assert got == divergence_of([r[1:] for r in rows])


def test_a_pair_is_the_same_one_in_every_tile():
    runs = [{"start": 0, "length": 1, "occurs": 5}]
    part = pd.DataFrame({
        "lang": "en", "i": 0, "j": 0, "side": 0, "source": ["s", "t"], "size": 3, "total": 5, "terms": 3, "runs": [runs, None],
    })
    for rows in (part, part[::-1]):
        assert divergence.pair_values(rows)[["a", "b"]].values.tolist() == [["s", "t"]]


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (5, 17, 3), (9_300_000_000, 40_000_000_000, 12_345_678), (10**14, 10**14 + 7, 10**8), (123_456_789_012, 10**14, 999_999_999)]
    want = [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]
    assert [int(divergence.shares(np.array([c]), n, v)[0]) for c, n, v in cases] == want
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(cases)], "k int, c long, n long, v long")
    from pyspark.sql import functions as F

    got = df.select("k", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).orderBy("k").collect()
    assert [r.p for r in got] == want


# SimHash


def fingerprint_of(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(t)]
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def linked(rows):
    """(id, fingerprint, component) of every row, by comparing all pairs of fingerprints."""
    fp = [fingerprint_of(t) for _, t in rows]
    some = sorted(set(fp))
    root = {x: x for x in some}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(some, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(b)] = find(a)
    low = {}
    for (i, _), x in zip(rows, fp):
        if i is not None:
            low[find(x)] = min(i, low.get(find(x), i))
    return sorted(((i, f"{x:016x}", low.get(find(x))) for (i, _), x in zip(rows, fp)), key=str)


def test_golay_code_is_perfect_and_near_words_share_a_key():
    code = simhash.Golay()
    assert len(np.unique(code.remainder(code.error))) == 1 << 11  # each remainder has one error of weight up to 3
    assert np.bitwise_count(code.error).max() == 3
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 21, 300)
    own = code.around(words, 21)
    for a, b in combinations(range(21), 2):
        other = code.around(words ^ (1 << a) ^ (1 << b), 21)
        assert all(set(x[x >= 0].tolist()) & set(y[y >= 0].tolist()) for x, y in zip(own, other))


def test_keys_lose_no_link():
    rng = np.random.default_rng(7)
    fp = rng.integers(0, 1 << 64, 400, dtype=np.uint64, endpoint=False)
    row, key = simhash.keys_of(fp)
    for k in range(400):
        x = fp[k]
        for b in rng.choice(64, 1 + k % 4, replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        assert np.isin(simhash.keys_of(np.array([x]))[1], key[row == k]).any()


@pytest.mark.parametrize("block", [6, 4096])
def test_links_equal_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # with 6, keys of a dozen fingerprints go by blocks
    monkeypatch.setattr(simhash, "SAMPLED", 1 if block == 6 else 64)
    monkeypatch.setattr(simhash, "PIECE", 200)
    real, called = simhash.blocked, []
    monkeypatch.setattr(simhash, "blocked", lambda *a: called.append(1) or real(*a))
    rng = random.Random(9)
    word = lambda: f"{rng.choice('ABcdefgh')}{rng.randrange(99)}"
    rows = []
    for c in range(6):
        base = [word() for _ in range(400)]
        for k in range(40):
            t = list(base)
            for _ in range(rng.randrange(12)):
                t[rng.randrange(len(t))] = word()
            rows.append((100 * c + k, rng.choice([" ", "  ", "\n"]).join(t)))
    rows += [(700 + k, " ".join(word() for _ in range(rng.randrange(6)))) for k in range(40)]
    rows += [(800, None), (801, ""), (802, " \t"), (None, None), (803, "É Ü a"), (803, "É Ü A"), (None, "no id but text here"), (804, rows[3][1]), (804, rows[50][1]), (805, "a b c d " * 20_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(3)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.link(docs).collect()), key=str)
    assert got == linked(rows)
    assert len({c for _, _, c in got}) < len({f for _, f, _ in got}) and bool(called) == (block == 6)
    assert simhash.link(docs.limit(0)).count() == 0


def test_link_query_against_a_direct_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in queries.op13_simhash(spark, SF).collect()), key=str)
    assert got == linked(rows)
