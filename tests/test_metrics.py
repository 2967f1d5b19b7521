import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import metrics as me


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_rouge_l_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [(" ".join(rng.choices("abcde", k=rng.randint(0, 9))), " ".join(rng.choices("abcde", k=rng.randint(1, 9)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "h string, r string")
    p, r, f = me.rouge_l(F.col("h"), F.col("r"))
    for row in df.select("h", "r", p.alias("p"), r.alias("rc"), f.alias("f")).collect():
        a, b = row.h.split(), row.r.split()
        n = lcs(a, b)
        assert row.p == pytest.approx(n / len(a) if a else 0) and row.rc == pytest.approx(n / len(b))
        assert row.f == pytest.approx(2 * n / (len(a) + len(b)) if n else 0)


def test_rouge_2_uses_distinct_pairs(spark):
    df = spark.createDataFrame([("a b a b", "a b c"), ("a", "a b")], "h string, r string")
    p, r, f = me.rouge_2(F.col("h"), F.col("r"))
    got = df.select(p.alias("p"), r.alias("r"), f.alias("f")).collect()
    assert (got[0].p, got[0].r, got[0].f) == (0.5, 0.5, 0.5) and (got[1].p, got[1].r, got[1].f) == (0, 0, 0)


def test_verdicts(spark):
    texts = ["x The trace is normal.</s>", "none", "The trace is odd.</s>", "The trace is anomalous.</s> The trace is normal.</s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    said = me.verdict(F.col("t"))
    got = [(r.s, r.v) for r in df.select(said.alias("s"), me.valid_verdict(said).alias("v")).collect()]
    assert got == [("normal", "normal"), ("", "normal"), ("odd", "normal"), ("anomalous", "anomalous")]


def test_stated_cause(spark):
    df = spark.createDataFrame([(" \\n The activity 'a' is late.</s>",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(me.stated_cause(F.col("t"))).collect()] == ["The activity 'a' is late.", ""]


def test_auc_and_curve_with_ties(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 1), rng.randint(0, 12)) for _ in range(200)]
    df = spark.createDataFrame(rows, "true_label int, score int")
    slot = lambda c: F.floor(c / 4)
    auc = me.roc_auc(df, [], slot).first().roc_auc
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(want)
    curve = me.precision_recall(df, [], slot, "true_label", "score")
    best, aupr, seen = (0, 0), 0.0, 0.0
    for th in sorted({s for _, s in rows}, reverse=True):
        picked = [t for t, s in rows if s >= th]
        p, r = sum(picked) / len(picked), sum(picked) / len(pos)
        aupr += (r - seen) * p
        seen = r
        best = max(best, (round(2 * p * r / (p + r), 12) if p + r else 0, -th))
    got = me.best_f1(curve, []).first()
    assert got.f1 == pytest.approx(best[0]) and got.score == -best[1]
    assert me.average_precision(curve, []).first().aupr == pytest.approx(aupr)
