import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import detect as dt
from tracewright.operators import linear as ln
from tracewright.operators import metrics as me
from tracewright.operators import prefixes as px
from tracewright.plans.detection import Run, score_slot


def flagged(spark, traces):
    rows = [(f"c{i:03d}", len(t), list(t), [f] * len(t), "normal" if f == 0 else "odd") for i, (t, f) in enumerate(traces)]
    return spark.createDataFrame(rows, "case_id string, n int, trace array<string>, flags array<int>, anomaly string")


@pytest.fixture(scope="module")
def run(spark):
    normal = [("abcd", 0)] * 30 + [("abd", 0)] * 15 + [("acbd", 0)] * 10
    odd = [("xbcd", 1), ("dcba", 1), ("abcdabcdabcd", 1), ("x", 1)]
    return Run(flagged(spark, normal + odd))


def test_split_is_disjoint_and_complete(run):
    train, test = run.train, run.test
    assert train.count() == int(0.8 * 55)
    assert train.join(test, "case_id").count() == 0 and train.count() + test.count() == 59
    assert test.where("anomaly = 'odd'").count() == 4


def test_normal_tails_choose_the_first_percentile(run):
    assert {r.p for r in run.chosen.collect()} == {80}


def test_best_threshold_with_anomalous_tail(spark):
    candidates = spark.createDataFrame([(1, 80, 0.1), (1, 81, 0.3), (1, 82, 0.5)], "prefix_len int, p int, threshold double")
    errors = spark.createDataFrame(
        [(1, 0.2, True, 0, 5), (1, 0.4, True, 1, 2), (1, 0.9, True, 1, 1)],
        "prefix_len int, score double, in_tail boolean, label int, w bigint",
    )
    best = dt.best_thresholds(candidates, errors).first()
    assert (best.p, best.threshold, best.f1) == (81, 0.3, 1.0)


def test_scores_equal_the_dense_error(run):
    vocab = [r.activity for r in run.vocabulary.orderBy("idx").collect()]
    cut = {r.prefix_len: r.cut for r in run.cuts.collect()}
    train = run.train.select("trace", dt.sample_hash().alias("h")).collect()

    def onehot(trace):
        return np.array([[float(a == v) for v in vocab] for a in trace])

    variants = dt.variant_table(run.cases)
    got = {(r.tid, r.prefix_len): r.score for r in run.model.score(variants).collect()}
    texts = {r.tid: r.trace for r in variants.collect()}
    assert got
    for (tid, k), score in got.items():
        fit = [onehot(r.trace[:k]) for r in train if len(r.trace) >= k and r.h <= cut[k]]
        x = onehot(texts[tid][:k])
        assert score == pytest.approx(np.mean((x - np.mean(fit, axis=0)) ** 2), abs=1e-9)


def test_long_unknown_and_unscored_cases(run):
    verdicts = {tuple(r.trace): r for r in run.verdicts.join(run.test.select("case_id", "trace"), "case_id").collect()}
    assert verdicts[tuple("abcdabcdabcd")].score is not None
    assert verdicts[tuple("xbcd")].predicted == 1
    longest = run.cuts.agg(F.max("prefix_len")).first()[0]
    assert longest == 4
    assert dt.prefix_records(run.found).agg(F.max("prefix_len")).first()[0] == 4


def test_case_without_model_is_normal_without_score(spark, run):
    found = dt.detect(run.test, run.model, run.chosen.where("prefix_len > 1"))
    row = dt.case_verdicts(found).where("n = 1").first()
    assert row.predicted == 0 and row.score is None
    auc = me.roc_auc(dt.case_verdicts(found), [], score_slot).first()
    assert auc.unscored == 1


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.random(137), 9)
    rows = [(1, float(v), False, 0, 1 + i % 3) for i, v in enumerate(values)]
    errors = spark.createDataFrame(rows, "prefix_len int, score double, in_tail boolean, label int, w bigint")
    all_values = np.repeat(values, [1 + i % 3 for i in range(len(values))])
    for r in dt.thresholds(errors).collect():
        assert r.threshold == pytest.approx(np.percentile(all_values, r.p), abs=1e-11)


def dense_scores(train, cuts, cases, x_of):
    """(trace, length) -> error, by a solve over all samples of each length."""
    cut = {r.prefix_len: r.cut for r in cuts.collect()}
    rows = train.select("trace", dt.sample_hash().alias("h")).collect()
    out = {}
    for t in {tuple(r.trace) for r in cases.collect()}:
        for k in range(1, len(t) + 1):
            if k in cut:
                x = np.array([x_of(r.trace[:k]) for r in rows if len(r.trace) >= k and r.h <= cut[k]])
                sigma = min(0.3, 0.3 / max(1, k / 3))
                w = np.linalg.solve(x.T @ x + len(x) * sigma**2 * np.eye(x.shape[1]), x.T @ x)
                p = x_of(t[:k])
                out[t, k] = np.mean((p - w @ p) ** 2)
    return out


def folded(x, width):
    out = np.zeros(min(len(x), width))
    for f, v in enumerate(x):
        out[f % width] += v * ln.signs(f // width + 1)[f // width]
    return out


@pytest.mark.parametrize("width", [1024, 7])
def test_linear_scores_equal_the_dense_solve(run, monkeypatch, width):
    monkeypatch.setattr(ln, "GROUP", 10)
    vocab = [r.activity for r in run.vocabulary.orderBy("idx").collect()]
    model = ln.linear_model(run.train, run.cuts, run.vocabulary, width=width)
    want = dense_scores(run.train, run.cuts, run.cases, lambda t: folded([float(a == v) for a in t for v in vocab], width))
    texts = {r.tid: tuple(r.trace) for r in dt.variant_table(run.cases).collect()}
    got = {(texts[r.tid], r.prefix_len): r.score for r in model.score(dt.variant_table(run.cases)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)


def test_many_activities_are_embedded(spark):
    rng = np.random.default_rng(4)
    traces = [[f"a{a}" for a in rng.integers(0, 1500, 12)] for _ in range(400)]
    rows = [(f"c{i}", 12, t, [0] * 12, "normal") for i, t in enumerate(traces)]
    run = Run(spark.createDataFrame(rows, "case_id string, n int, trace array<string>, flags array<int>, anomaly string"), encoding="word2vec")
    assert run.vocabulary.count() > 1024
    vec = {r.activity: np.array(r.vec) for r in px.word_vectors(run.train).collect()}
    zero = np.zeros(32)
    x_of = lambda t: np.concatenate([vec.get(a, zero) for a in t])
    some = run.cases.where("case_id in ('c0', 'c1', 'c2')")
    want = dense_scores(run.train, run.cuts, some, x_of)
    texts = {r.tid: tuple(r.trace) for r in dt.variant_table(some).collect()}
    got = {(texts[r.tid], r.prefix_len): r.score for r in run.model.score(dt.variant_table(some)).collect()}
    assert len(got) == len(want) == 36 and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)
    assert all(np.isclose(np.linalg.norm(v), 1, atol=1e-6) for v in vec.values())


def scores_of(run, model):
    texts = {r.tid: tuple(r.trace) for r in dt.variant_table(run.cases).collect()}
    return {(texts[r.tid], r.prefix_len): r.score for r in model.score(dt.variant_table(run.cases)).collect()}


def test_bottleneck_equals_the_dense_reduced_rank_solve(run):
    vocab = [r.activity for r in run.vocabulary.orderBy("idx").collect()]
    got = scores_of(run, ln.linear_model(run.train, run.cuts, run.vocabulary, bottleneck=2))
    cut = {r.prefix_len: r.cut for r in run.cuts.collect()}
    rows = run.train.select("trace", dt.sample_hash().alias("h")).collect()
    x_of = lambda t: np.array([float(a == v) for a in t for v in vocab])
    assert got
    for (t, k), score in got.items():
        x = np.array([x_of(r.trace[:k]) for r in rows if len(r.trace) >= k and r.h <= cut[k]])
        sigma = min(0.3, 0.3 / max(1, k / 3))
        # Ridge regression, then a projection of its fit onto the leading right singular vectors of the widened data.
        wide = np.vstack([x, np.sqrt(len(x)) * sigma * np.eye(x.shape[1])])
        full = np.linalg.lstsq(wide, np.vstack([x, np.zeros((x.shape[1],) * 2)]), rcond=None)[0]
        _, s, vt = np.linalg.svd(wide @ full)
        used = int((s >= s[1] * (1 - 1e-6)).sum())
        w = full @ vt[:used].T @ vt[:used]
        p = x_of(t[:k])
        assert score == pytest.approx(np.mean((p - p @ w) ** 2), abs=2e-8)


def test_full_bottleneck_is_the_plain_model(run):
    plain = scores_of(run, ln.linear_model(run.train, run.cuts, run.vocabulary))
    wide = scores_of(run, ln.linear_model(run.train, run.cuts, run.vocabulary, bottleneck=10_000))
    assert plain.keys() == wide.keys() and all(plain[k] == pytest.approx(wide[k], abs=2e-9) for k in plain)
    for wrong in (dict(bottleneck=2), dict(embedding="other")):
        with pytest.raises(ValueError):
            Run(run.cases, **wrong)
    with pytest.raises(ValueError):
        ln.linear_model(run.train, run.cuts, run.vocabulary, bottleneck=0)


def test_mixed_flags_from_csv_to_verdicts(spark, tmp_path):
    """A case with any normal event trains with its normal events only."""
    lines = ["case_id,name,isAnomaly,anomaly"]
    for i in range(40):
        flags = [0, 1, 0] if i % 4 == 0 else [0, 0, 0]
        lines += [f"c{i},{a},{f},{'odd' if 1 in flags else 'normal'}" for a, f in zip("axb" if 1 in flags else "acb", flags)]
    lines += [f"z{i},{a},1,odd" for i in range(4) for a in "xyz"]
    (tmp_path / "log.csv").write_text("\n".join(lines) + "\n")
    from tracewright.sources.readers import read_csv_log

    run = Run(px.flagged_cases(read_csv_log(spark, str(tmp_path / "log.csv")), "anomaly"))
    train = [(r.trace, r.flags) for r in run.train.collect()]
    assert len(train) == 32 and all(f == [0] * len(t) and "x" not in t for t, f in train)
    assert {len(t) for t, _ in train} == {2, 3}
    verdicts = {r.case_id: r for r in run.verdicts.collect()}
    assert all(verdicts[f"z{i}"].predicted == 1 and verdicts[f"z{i}"].true_label == 1 for i in range(4))


def test_padding(spark):
    df = spark.sql("select array(1.0D, 2.0D) v, 4 n")
    assert df.select(px.pad(F.col("v"), F.col("n")).alias("p")).first().p == [1.0, 2.0, 0.0, 0.0]
    with pytest.raises(Exception, match="longer"):
        df.select(px.pad(F.col("v"), F.lit(1)).alias("p")).collect()


def test_wrong_arguments(spark):
    with pytest.raises(ValueError):
        Run(None, encoding="bytes")


def test_prefix_tree_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    traces = [tuple(rng.choice(["a", "b", None], rng.integers(0, 7))) for _ in range(60)] * 2 + [("a",) * 200]
    rows = [("xy"[i % 2], f"c{i}" if i % 7 else None, len(t), list(t)) for i, t in enumerate(traces)]
    cases = spark.createDataFrame(rows, "log string, case_id string, n int, trace array<string>")
    want = {}
    for log, _, n, t in rows:
        for k in range(1, n + 1):
            at = want.setdefault((log, tuple(t[:k])), [0, 0])
            at[0] += 1
            at[1] += k == n
    children = {}
    for log, p in want:
        children[log, p[:-1]] = children.get((log, p[:-1]), 0) + 1
    got = {(r.log, r.node): r for r in dt.prefix_tree(cases, ["log"]).collect()}

    def path(r):
        return (*(path(got[r.log, r.parent]) if r.parent else ()), r.activity)

    told = {(r.log, path(r)): [r.cases, r.ends, r.children] for r in got.values()}
    assert told == {key: [*v, children.get(key, 0)] for key, v in want.items()}
    assert all(r.depth == len(path(r)) for r in got.values())
    assert dt.prefix_tree(cases.where("n = 0"), ["log"]).isEmpty()


def test_changes_of_counts_equal_counts_per_length(spark):
    """Repeated case ids, null activities and lengths, many of them with a cut of their own."""
    rng = np.random.default_rng(5)
    traces = [list(rng.choice(["a", "b", "c", None], rng.integers(1, 30), p=[0.4, 0.3, 0.2, 0.1])) for _ in range(120)]
    train = flagged(spark, [(t, 0) for t in traces]).withColumn("case_id", F.when(F.col("case_id") < "c110", F.col("case_id")))
    cuts = dt.tail_cuts(train)
    cut = {r.prefix_len: r.cut for r in cuts.collect()}
    rows = train.select("trace", dt.sample_hash().alias("h")).collect()
    want = {}
    for r in rows:
        for k in range(1, len(r.trace) + 1):
            if k in cut and r.h <= cut[k]:
                for p in range(k):
                    key = k, p + 1, r.trace[p]
                    want[key] = want.get(key, 0) + 1
    words = train.select(F.explode("trace").alias("activity")).where("activity is not null").distinct()
    model = dt.frequency_model(train, cuts, words)
    assert {(r.prefix_len, r.pos, r.activity): r.c for r in model.counts.collect()} == want
    squares = {}
    for (k, _, _), c in want.items():
        squares[k] = squares.get(k, 0) + c * c
    assert {r.prefix_len: int(r.squares) for r in model.norms.collect() if r.squares} == squares
    fit = {r.prefix_len: r.n_fit for r in model.norms.collect()}
    odd = flagged(spark, [(["a", "z", "b", None] * 9, 1), (["a", "z"], 1), (["a"], 1), ([], 1)])
    variants = dt.variant_table(odd.select("case_id", "n", "trace", "flags").unionByName(train.select("case_id", "n", "trace", "flags")))
    texts = {r.tid: r.trace for r in variants.collect()}
    got = {(r.tid, r.prefix_len): r.score for r in model.score(variants).collect()}
    assert len(got) == sum(min(len(t), max(fit)) for t in texts.values())
    for (tid, k), score in got.items():
        t = texts[tid][:k]
        hits = sum(want.get((k, p + 1, a), 0) for p, a in enumerate(t) if a is not None)
        known = sum(a in ("a", "b", "c") for a in t)
        assert score == pytest.approx((known + squares[k] / fit[k] ** 2 - 2 * hits / fit[k]) / (3 * k), abs=2e-9)
    whole = {r.tid: r.score for r in model.score_whole(variants).collect()}
    assert whole == {tid: got[tid, len(t)] for tid, t in texts.items() if (tid, len(t)) in got}


def test_memory_of_a_group_follows_its_result(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n, places, size = 3000, 40, 32
    x = rng.normal(size=(n, places, size)) * (rng.random((n, places, 1)) > 0.2)
    assert np.allclose(ln.vectors_of(x[:3], size, 100), [folded(v.ravel(), 100) for v in x[:3]])
    group = pd.DataFrame({"prefix_len": places, "x": [list(v) for v in x], "w": rng.integers(1, 4, n)})
    dense = ln.vectors_of(x, size, 64)
    tracemalloc.start()
    got = ln.moments(group, size, 64)
    form = pd.DataFrame({"i": np.arange(64), "g": list(np.eye(64))})
    scores = ln.errors(group.assign(tid="t"), form, size, 64)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.triu((dense * group["w"].to_numpy()[:, None]).T @ dense)
    assert np.allclose(got["c"], want[got["i"], got["j"]]) and np.allclose(scores["score"], (dense**2).sum(1) / 64)
    assert most < 0.7 * x.nbytes  # 30 MB; several times that before
    # Groups of long prefixes have fewer rows.
    monkeypatch.setattr(ln, "VALUES", 640)
    lengths = spark.createDataFrame([(3,)] * 10 + [(40,)] * 10, "n int")
    salts = lambda numbers: {r.prefix_len: r.salts for r in ln.salted(lengths, numbers).collect()}
    assert salts(1)[3] == 1 and salts(32)[3] == 3 and salts(32)[40] == 20
