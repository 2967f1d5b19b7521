from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import embeddings as em
from tracewright.plans.detection import Run


@pytest.fixture(scope="module")
def grouped(spark):
    """Cases of which each keeps to the ten activities of one of six groups, with a few from elsewhere."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        trace = [f"g{i % 6}a{x}" if rng.random() > 0.05 else f"g{rng.integers(6)}a{x}" for x in rng.integers(0, 10, 9)]
        rows.append((f"c{i}", 9, trace))
    return spark.createDataFrame(rows, "case_id string, n int, trace array<string>")


def dense(cases, window=5):
    count = Counter()
    for r in cases.collect():
        for i, a in enumerate(r.trace):
            for j, b in enumerate(r.trace):
                if i != j and abs(i - j) <= window and a is not None and b is not None:
                    count[a, b] += 1
    names = sorted({a for a, _ in count})
    c = np.array([[count[a, b] for b in names] for a in names], float)
    with np.errstate(divide="ignore"):
        return names, np.maximum(np.log(c * c.sum() / np.outer(c.sum(1), c.sum(0))), 0)


def test_mutual_information_equals_the_dense_table(grouped):
    names, m = dense(grouped)
    got = {(r.activity, r.near): r.value for r in em.mutual_information(grouped).collect()}
    want = {(names[i], names[j]): m[i, j] for i, j in zip(*np.nonzero(m))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_leading_factors_and_neighbours_equal_a_dense_decomposition(grouped):
    names, m = dense(grouped)
    values, u = np.linalg.eigh(m)
    lead = np.argsort(-np.abs(values))[:6]
    found, got = em.factors(em.mutual_information(grouped), 6)
    assert np.allclose(got, values[lead], rtol=1e-3)
    rows = {r.activity: np.array(r.u) for r in found.collect()}
    mine = np.stack([rows[n] for n in names])
    assert np.allclose(mine.T @ mine, np.eye(6), atol=1e-8)
    assert np.linalg.norm(mine @ mine.T - u[:, lead] @ u[:, lead].T, 2) < 0.05
    vec = {r.activity: np.array(r.vec) for r in em.learnt_vectors(grouped, 6).collect()}
    x = np.stack([vec[n] for n in names])
    other = u[:, lead] * np.sqrt(np.abs(values[lead]))
    other /= np.linalg.norm(other, axis=1)[:, None]
    nearest = lambda v: [set(np.argsort(-r)[:10]) for r in v @ v.T]
    shared = [len(a & b) for a, b in zip(nearest(x), nearest(other))]
    assert np.mean(shared) > 9.5
    group = np.array([n[:2] for n in names])
    assert all((group[list(s)] == group[i]).all() for i, s in enumerate(nearest(x)))


def test_small_tables_nulls_and_lone_activities(spark):
    make = lambda *traces: spark.createDataFrame([(f"c{i}", len(t), list(t)) for i, t in enumerate(traces)], "case_id string, n int, trace array<string>")
    odd = make(["a", "b"], ["a", None, "b"], ["z"], [], ["c", "d", "c"])
    names, m = dense(odd)
    found, values = em.factors(em.mutual_information(odd))
    rows = {r.activity: np.array(r.u) for r in found.collect()}
    u = np.stack([rows[n] for n in names])
    assert np.allclose(u * values @ u.T, m, atol=1e-9)
    vec = {r.activity: np.array(r.vec) for r in em.learnt_vectors(odd, 8).collect()}
    assert set(vec) == {"a", "b", "c", "d", "z"} and all(len(v) == 8 for v in vec.values())
    assert not vec["z"].any() and np.linalg.norm(vec["a"]) == pytest.approx(1, abs=1e-6)
    empty = odd.where("false")
    found, values = em.factors(em.mutual_information(empty))
    assert found.count() == 0 and len(values) == 0 and em.learnt_vectors(empty).count() == 0


def test_detection_with_learnt_embeddings(grouped):
    flagged = grouped.withColumn("flags", F.array_repeat(F.lit(0), 9)).withColumn("anomaly", F.lit("normal"))
    run = Run(flagged, encoding="word2vec", embedding="learnt", bottleneck=4)
    assert run.verdicts.count() == run.test.count() and run.verdicts.where("score is not null").count() > 0
