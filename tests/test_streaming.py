from pyspark.sql import functions as F

from tests.test_detect import flagged
from tracewright.operators import detect as dt
from tracewright.plans.detection import Run
from tracewright.streaming import scorer

EVENT = "case_id string, pos int, activity string, ts timestamp"


def put(spark, folder, number, rows):
    """One file of events: (case, pos, activity, minute)."""
    made = [(c, p, a, m) for c, p, a, m in rows]
    df = spark.createDataFrame(made, "case_id string, pos int, activity string, m long").select("case_id", "pos", "activity", F.timestamp_seconds(F.col("m") * 60 + 1_600_000_000).alias("ts"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{number}")


def stream(spark, folder):
    return spark.readStream.schema(EVENT).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def run_once(spark, folder, model, chosen, out, checkpoint, **kw):
    scorer.watch(stream(spark, folder), model, chosen, out, checkpoint, availableNow=True, **kw).awaitTermination()
    return spark.read.schema("case_id string, prefix_len int, score double, predicted int").parquet(out)


def test_stream_equals_the_batch_run_and_a_restart_adds_nothing(spark, tmp_path):
    log = flagged(spark, [("abcd", 0)] * 30 + [("abd", 0)] * 15 + [("xbcd", 1), ("dcba", 1), ("abcdabcd", 1)])
    run = Run(log)
    cases = run.test.select("case_id", "trace").collect()
    events = [(r.case_id, p, a, p) for r in cases for p, a in enumerate(r.trace, 1)]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k in range(3):  # backwards and dealt over files, some of them twice
        put(spark, folder, k, [e for e in events[::-1] if e[1] % 3 == k])
    put(spark, folder, 3, events[:7])
    got = run_once(spark, folder, run.model, run.chosen, out, checkpoint)
    want = dt.prefix_records(run.found)
    pick = lambda df: sorted((r.case_id, r.prefix_len, r.score, r.predicted) for r in df.where("score is not null").collect())
    assert pick(got) == pick(want)
    assert got.count() == len(events)
    assert sorted(map(tuple, scorer.first_flags(got).collect())) == sorted(map(tuple, dt.earliness(run.found).collect()))
    # Started anew from the checkpoint: nothing is said twice, and open cases go on from their state.
    put(spark, folder, 4, [(cases[0].case_id, len(cases[0].trace) + 1, "d", 20)])
    again = run_once(spark, folder, run.model, run.chosen, out, checkpoint)
    assert again.count() == len(events) + 1 and pick(again.where(F.col("case_id") != cases[0].case_id)) == pick(want.where(F.col("case_id") != cases[0].case_id))


def test_gaps_time_outs_and_late_events(spark, tmp_path):
    run = Run(flagged(spark, [("ab", 0)] * 20))
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    minute = 60_000
    said = lambda: sorted((r.case_id, r.prefix_len) for r in got.collect())
    go = lambda: run_once(spark, folder, run.model, run.chosen, out, checkpoint, delay="1 minute", idle_ms=10 * minute)
    put(spark, folder, 0, [("gap", 1, "a", 0), ("gap", 3, "b", 1), ("open", 1, "a", 1), (None, 1, "a", 1), ("nowhere", None, "a", 1)])
    got = go()
    assert said() == [("gap", 1), ("open", 1)]
    put(spark, folder, 1, [("gap", 2, "b", 2), ("gap", 2, "other", 2)])
    got = go()
    assert said() == [("gap", 1), ("gap", 2), ("gap", 3), ("open", 1)]
    put(spark, folder, 2, [("late", 1, "a", 100)])  # moves the watermark on: gap and open are closed
    got = go()
    put(spark, folder, 3, [("open", 2, "b", 101), ("gap", 1, "a", 101), ("late", 2, "b", 3)])  # the last one comes too late
    got = go()
    assert said() == [("gap", 1), ("gap", 1), ("gap", 2), ("gap", 3), ("late", 1), ("open", 1)]


def test_lengths_without_a_model_have_no_score(spark):
    run = Run(flagged(spark, [("ab", 0)] * 20))
    rows = spark.createDataFrame([("c", 1, ["a"]), ("c", 9, list("ababababa")), ("d", 1, ["a"]), ("e", 2, ["zz", None])], scorer.PREFIX)
    got = {(r.case_id, r.prefix_len): r.score for r in scorer.scored(rows, run.model, run.chosen).collect()}
    assert got[("c", 9)] is None and got[("c", 1)] == got[("d", 1)] == 0.0 and got[("e", 2)] > 0
    linear = Run(flagged(spark, [("ab", 0)] * 20), model_kind="linear")
    assert scorer.scored(rows.where("case_id <> 'e'"), linear.model, linear.chosen).where("score is not null").count() == 2


def test_cases_share_a_state_and_are_closed_each_by_itself(spark, tmp_path):
    run = Run(flagged(spark, [("ab", 0)] * 20))
    steps = [
        [("gone", 1, "a", 0), ("open", 1, "a", 0), ("gap", 2, "b", 0)],
        [("open", 2, None, 100)],  # moves the watermark on
        [("open", 3, "a", 101), ("gap", 1, "a", 101)],  # gone is closed while others of its group go on
        [("gone", 1, "a", 102), ("gone", 1, "b", 102), ("open", 4, "b", 102), ("new", 1, "a", 102)],
    ]
    folder = str(tmp_path / "in")
    for k, rows in enumerate(steps):
        put(spark, folder, k, rows)
    for name, more in (("one", {"groups": 1}), ("many", {})):
        out = str(tmp_path / name)
        query = scorer.watch(
            stream(spark, folder), run.model, run.chosen, out, f"{out}-checkpoint", delay="1 minute", idle_ms=600_000, availableNow=True, **more
        )
        query.awaitTermination()
        got = spark.read.schema("case_id string, prefix_len int, score double, predicted int").parquet(out)
        want = [("gap", 1), ("gap", 2), ("gone", 1), ("gone", 1), ("new", 1), ("open", 1), ("open", 2), ("open", 3), ("open", 4)]
        assert sorted((r.case_id, r.prefix_len) for r in got.collect()) == want
        if name == "one":
            assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1] == 1


def test_states_grow_with_the_groups_not_the_cases(spark, tmp_path):
    rows = spark.range(6000).select(F.col("id").cast("string").alias("case_id"), F.lit(1).alias("pos"), F.lit("a").alias("activity"), F.timestamp_seconds(F.lit(1_600_000_000)).alias("ts"))
    folder, table = str(tmp_path / "in"), f"grown_{tmp_path.name.replace('-', '_')}"
    rows.coalesce(1).write.parquet(f"{folder}/0")
    query = scorer.prefixes(stream(spark, folder)).writeStream.format("memory").queryName(table).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table(table).where("prefix_len = 1 and size(prefix) = 1").select("case_id").distinct().count() == 6000 == spark.table(table).count()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= scorer.GROUPS < 6000
