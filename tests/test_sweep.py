from tests.test_detect import flagged
from tracewright.plans.sweep import run_sweep


def test_results_of_two_runs(spark, tmp_path):
    log = flagged(spark, [("abcd", 0)] * 20 + [("abd", 0)] * 10 + [("xbcd", 1), ("dcba", 1)])
    out = str(tmp_path / "results")
    run_sweep({"small": log}, out, runs=[1, 2])
    metrics = spark.read.option("header", True).csv(f"{out}/metrics")
    assert sorted(r.run for r in metrics.collect()) == [1, 2] and "roc_auc" in metrics.columns
    counts = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/prefix_counts")
    assert counts.where("prefix_len = 1 and run = 1").first().anomaly_count == 2
    kinds = spark.read.option("header", True).csv(f"{out}/f1_by_type")
    assert {r.anomaly for r in kinds.collect()} == {"odd"}


def test_embedded_run(spark):
    from tracewright.plans.detection import Run

    log = flagged(spark, [("abcd", 0)] * 20 + [("abd", 0)] * 10 + [("xbcd", 1), ("dcba", 1)])
    run = Run(log, encoding="word2vec")
    verdicts = run.verdicts.collect()
    assert len(verdicts) == 8 and all(v.score is not None and v.score >= 0 for v in verdicts)


def test_keyed_runs_equal_single_ones(spark):
    from tracewright.operators import detect as dt
    from tracewright.plans.detection import Run
    from tracewright.plans.sweep import keyed_run

    logs = {
        "one": flagged(spark, [("abcd", 0)] * 20 + [("abd", 0)] * 10 + [("xbcd", 1), ("dcba", 1)]),
        "two": flagged(spark, [("pqr", 0)] * 15 + [("pr", 0)] * 12 + [("rq", 1), ("pqrpqr", 1)]),
        "tiny": flagged(spark, [("a", 0), ("b", 1)]),
    }
    whole = keyed_run(logs, [1, 2])
    tables = {
        "chosen": lambda r: r.chosen, "verdicts": lambda r: r.verdicts, "records": lambda r: dt.prefix_records(r.found),
        "counts": lambda r: dt.prefix_counts(r.found), "type": lambda r: r.f1_by_type(),
    }
    keyed = {name: make(whole).collect() for name, make in tables.items()}
    for dataset, run in (("one", 2), ("two", 1), ("tiny", 1)):
        alone = Run(logs[dataset], run=run)
        for name, make in tables.items():
            got = sorted([str({k: v for k, v in r.asDict().items() if k not in ("dataset", "run")}) for r in keyed[name] if (r.dataset, r.run) == (dataset, run)])
            assert got == sorted(str(r.asDict()) for r in make(alone).collect()), (dataset, run, name)
    metrics = {(r.dataset, r.run): (r.f1_score, r.roc_auc) for r in whole.metrics().collect()}
    assert set(metrics) == {(d, k) for d in logs for k in (1, 2)}
    one = Run(logs["one"], run=2).metrics("one").first()
    assert metrics[("one", 2)] == (one.f1_score, one.roc_auc)


def test_jobs_of_a_sweep_do_not_grow_with_its_runs(spark, tmp_path):
    log = flagged(spark, [("abcd", 0)] * 20 + [("abd", 0)] * 10 + [("xbcd", 1)])
    jobs = []
    for k, runs in enumerate(([1], [1, 2, 3, 4])):
        group = f"sweep {k}"
        spark.sparkContext.setJobGroup(group, group)
        run_sweep({"a": log, "b": log} if k else {"a": log}, str(tmp_path / group), runs=runs)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] * 1.2
