"""Early detection on a stream of events: every prefix is scored once, when its last event is known.

A keyed state holds the traces of open cases, and the events that have come before their predecessors. An event whose
predecessors are all known closes a prefix, which goes to the model that a batch run has fitted; so what is said of a
prefix is what the batch run says, in whatever order and in however many batches the events come. A case without an
event for some time is closed: it goes when the watermark has passed its last event by that time.

A call for a key costs far more than an event, so the key is not the case but a hash of it: the open cases of a group share a state.

Each micro-batch writes its scores into a folder of its own number, which a repeated batch replaces: after a restart from the
checkpoint every prefix stands once.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.draws import sized_text

PREFIX = "case_id string, prefix_len int, prefix array<string>"
GROWN = "case_id string, known int, trace array<string>"
STATE = "cases string"

# Groups that the cases are dealt over.
GROUPS = 4096


def grown(events: DataFrame, delay: str = "1 hour", idle_ms: int = 86_400_000, groups: int = GROUPS) -> DataFrame:
    """(case_id, known, trace) of a stream of EVENTS (case_id, pos, activity, ts): the cases that have grown.

    ``known`` events of the trace were known before, so each prefix is new once. The parameters are those of ``prefixes``.
    """

    def grow(key, parts, state):
        # case: its trace, events that wait for a predecessor as places and activities, last event, time to close
        cases = json.loads(state.get[0]) if state.exists else {}
        now, seen = state.getCurrentWatermarkMs(), {}
        for part in parts:
            for case, pos, activity, ms in zip(part["case_id"], part["pos"], part["activity"], part["ms"]):
                if case not in seen:
                    trace, at, waiting, last, _ = cases.get(case, ([], [], [], 0, 0))
                    seen[case] = [trace, dict(zip(at, waiting)), last, len(trace)]
                held = seen[case]
                held[2] = max(held[2], int(ms))
                if pos > held[3]:
                    held[1].setdefault(int(pos), activity)
        new = []
        for case, (trace, ahead, last, known) in seen.items():
            while len(trace) + 1 in ahead:
                trace.append(ahead.pop(len(trace) + 1))
            cases[case] = (trace, list(ahead), list(ahead.values()), last, max(last, now) + idle_ms)
            if len(trace) > known:
                new.append((case, known, trace))
        cases = {case: held for case, held in cases.items() if case in seen or held[4] >= now}
        if cases:
            state.update((json.dumps(cases),))
            state.setTimeoutTimestamp(min(held[4] for held in cases.values()))
        elif state.exists:
            state.remove()
        if new:
            yield pd.DataFrame(new, columns=["case_id", "known", "trace"])

    seen = events.where("case_id is not null and pos is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    slim = seen.select(F.col("case_id").cast("string").alias("case_id"), F.col("pos").cast("int").alias("pos"), "activity", "ts", F.unix_millis("ts").alias("ms"))
    dealt = slim.withColumn("group", F.pmod(F.xxhash64("case_id"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandasWithState(grow, GROWN, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def new_prefixes(cases: DataFrame) -> DataFrame:
    """(case_id, prefix_len, prefix) of grown cases: the prefixes that were not known before."""
    lengths = cases.select("case_id", "trace", F.explode(F.sequence(F.col("known") + 1, F.size("trace"))).alias("prefix_len"))
    return lengths.select("case_id", "prefix_len", F.slice("trace", F.lit(1), F.col("prefix_len")).alias("prefix"))


def prefixes(events: DataFrame, delay: str = "1 hour", idle_ms: int = 86_400_000, groups: int = GROUPS) -> DataFrame:
    """(case_id, prefix_len, prefix) of a stream of EVENTS (case_id, pos, activity, ts), each prefix once.

    delay: how late an event may come; later ones are dropped. idle_ms: how long a case stays open without an event.
    Events without a case or a position are left out. Of events that repeat a position the first to come counts. What waits
    for a predecessor when its case is closed is dropped; an event of a closed case opens the case anew.

    groups: over how many states the cases are dealt. A state is written whole when one of its cases has an event, so more
    groups suit small batches on many open cases. A checkpoint stays with the number it began with.
    """
    return new_prefixes(grown(events, delay, idle_ms, groups))


def scored(rows: DataFrame, model, chosen: DataFrame) -> DataFrame:
    """(case_id, prefix_len, score, predicted) of prefixes; both are null where no model has their length."""
    tagged = rows.withColumn("tid", F.md5(sized_text(F.col("prefix"))))
    different = tagged.groupBy("tid").agg(F.any_value("prefix").alias("trace"), F.any_value("prefix_len").alias("n"))
    limits = chosen.select("prefix_len", "threshold")
    found = model.score_whole(different).join(limits, "prefix_len")
    found = found.select("tid", "score", (F.col("score") > F.col("threshold")).cast("int").alias("predicted"))
    return tagged.join(found, "tid", "left").select("case_id", "prefix_len", "score", "predicted")


def watch(
    events: DataFrame, model, chosen: DataFrame, out: str, checkpoint: str, delay: str = "1 hour", idle_ms: int = 86_400_000,
    groups: int = GROUPS, **trigger,
) -> StreamingQuery:
    """Score a stream of EVENTS into Parquet under ``out``, with a model and the thresholds of a batch run.

    ``trigger``: as of ``DataStreamWriter.trigger``. Both folders have to be shared by all machines.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.persist()  # read twice below
        try:
            scored(new_prefixes(batch), model, chosen).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            batch.unpersist()

    writer = grown(events, delay, idle_ms, groups).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def first_flags(scores: DataFrame) -> DataFrame:
    """(case_id, first_flag, n, share) of the flagged cases of a scored stream, n being the events known so far."""
    by_case = scores.groupBy("case_id").agg(
        F.min(F.when(F.col("predicted") == 1, F.col("prefix_len"))).alias("first_flag"), F.max("prefix_len").alias("n")
    )
    return by_case.where("first_flag is not null").withColumn("share", F.col("first_flag") / F.col("n"))
