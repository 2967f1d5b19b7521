"""Event logs as DataFrames.

EVENTS  case_id string, pos bigint (from 1), activity string, ts timestamp, attrs map<string,string>
CASES   case_id string, n int, trace array<string>

Statistics are computed on EVENTS; CASES is built only where a whole trace is the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import HOT_ROWS, by_heat, numbered

# Symbols of the artificial first and last row of a case.
START, END = "▶", "■"

# Event attributes that are not attribute columns of a log.
IGNORED_KEYS = [
    "concept:name", "time:timestamp", "lifecycle:transition", "EventID", "activityNameEN",
    "activityNameNL", "dateFinished", "question", "product", "EventOrigin", "Action",
    "organization involved", "impact", "concept:instance",
]


def sessions(
    events: DataFrame, gap_seconds: int = 43_200, slots_per_gap: int = 12, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """EVENTS of a click stream, one case per user and stretch without a pause over the gap."""
    gap = gap_seconds * 1_000_000
    clicks = events.select(
        "user_id", "event_id", "ts", "event_type", "value", "props",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )

    def opens(pause, at):
        return F.when(pause.isNull() | (pause > gap), at)

    def plain(rows):
        by_user = Window.partitionBy("user_id").orderBy("us", "event_id")
        in_case = Window.partitionBy("user_id", "start").orderBy("us", "event_id")
        return (
            rows.withColumn("pause", F.col("us") - F.lag("us").over(by_user))
            .withColumn("start", F.last(opens(F.col("pause"), F.col("us")), ignorenulls=True).over(by_user))
            .withColumn("pos", F.row_number().over(in_case).cast("bigint"))
            .drop("pause")
        )

    def slotted(rows):
        # A slot is shorter than the gap, so a case can only begin with the first event of a slot:
        # starts and positions come from a (user, slot) aggregate, and no window sees a whole user.
        rows = rows.withColumn("slot", F.floor(F.col("us") / F.lit(gap // slots_per_gap)))
        slots = rows.groupBy("user_id", "slot").agg(
            F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("c")
        )
        by_user = Window.partitionBy("user_id").orderBy("slot")
        earlier = Window.partitionBy("user_id", "start").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        slots = (
            slots.withColumn("pause", F.col("lo") - F.lag("hi").over(by_user))
            .withColumn("start", F.last(opens(F.col("pause"), F.col("lo")), ignorenulls=True).over(by_user))
            .withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
            .select("user_id", "slot", "start", "before")
        )
        inside = Window.partitionBy("user_id", "slot").orderBy("us", "event_id")
        return (
            rows.join(slots, ["user_id", "slot"])
            .withColumn("pos", F.col("before") + F.row_number().over(inside))
            .drop("slot", "before")
        )

    return by_heat(clicks, "user_id", plain, slotted, hot_rows).select(
        F.concat_ws("-", F.col("user_id"), F.floor(F.col("start") / 1_000_000)).alias("case_id"),
        "pos",
        F.col("event_type").alias("activity"),
        "ts",
        F.create_map(
            F.lit("k"), F.get_json_object("props", "$.k"), F.lit("value"), F.col("value").cast("string")
        ).alias("attrs"),
        "user_id",
    )


def case_log(
    df: DataFrame, case: str, activity: Column, order: list, slot: Column | None, *keep, hot_rows: int = HOT_ROWS,
    positions: bool = True,
) -> DataFrame:
    """EVENTS of a table with a case column and an order.

    ``slot`` grows along the order; it divides cases with more than ``hot_rows`` events (None: ranges of
    the order do). Without ``positions`` there is no ``pos``, and nothing is shuffled.
    """
    # Cast first, so that what is partitioned for the positions stays so for the case.
    df = df.withColumn("case_id", F.col(case).cast("string"))
    columns = ["case_id", activity.alias("activity"), *keep]
    if not positions:
        return df.select(*columns)

    def plain(rows):
        in_case = Window.partitionBy("case_id").orderBy(*order)
        return rows.withColumn("pos", F.row_number().over(in_case).cast("bigint"))

    def slotted(rows):
        return numbered(rows, ["case_id"], slot, order)

    return by_heat(df, "case_id", plain, slotted, hot_rows).select("case_id", "pos", *columns[1:])


def cases(events: DataFrame, *keep: str) -> DataFrame:
    """CASES: one row per case with its trace."""
    steps = F.sort_array(F.collect_list(F.struct("pos", "activity")))
    return (
        events.groupBy("case_id", *keep)
        .agg(steps.alias("steps"))
        .select("case_id", *keep, F.size("steps").alias("n"), F.col("steps.activity").alias("trace"))
    )


def trace_text(trace: Column, sep: str = ",") -> Column:
    return F.array_join(trace, sep)


def case_lengths(events: DataFrame) -> DataFrame:
    return events.groupBy("case_id").agg(F.count("*").alias("num_events"))


def activities(*logs: DataFrame) -> DataFrame:
    """Activity names over all given logs."""
    names = [log.select("activity").distinct() for log in logs]
    out = names[0]
    for other in names[1:]:
        out = out.unionByName(other)
    return out.distinct()


def summary(events: DataFrame) -> DataFrame:
    """Cases, events, activities and the longest case, in one row."""
    kinds = activities(events).agg(F.count("*").alias("num_activities"))
    return (
        case_lengths(events)
        .agg(
            F.count("*").alias("num_cases"),
            F.sum("num_events").alias("num_events"),
            F.max("num_events").alias("max_case_len"),
        )
        .select("*", kinds.scalar().alias("num_activities"))
    )


def attribute_values(events: DataFrame) -> DataFrame:
    """Sorted distinct values per attribute, one row each with its index from 0."""
    pairs = events.select(F.explode("attrs").alias("attr", "val")).where(F.col("val").isNotNull()).distinct()
    ranked = numbered(pairs, ["attr"], None, ["val"], "idx")
    return ranked.select("attr", "val", (F.col("idx") - 1).alias("idx"))


def attribute_keys(events: DataFrame, global_keys: DataFrame | None = None, ignored: list[str] = IGNORED_KEYS) -> DataFrame:
    """``name`` first, then the sorted attribute keys.

    Of a log that declares its event attributes (``global_keys``: key), all but the ignored ones; of another log,
    those of its events that don't begin with an underscore.
    """
    if global_keys is not None:
        keys = global_keys.select(F.col("key").alias("attr")).where(~F.col("attr").isin(ignored)).distinct()
    else:
        keys = events.select(F.explode(F.map_keys("attrs")).alias("attr")).where(~F.col("attr").startswith("_")).distinct()
    ranked = numbered(keys, [], None, ["attr"], "idx").select("idx", "attr")
    first = events.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("idx"), F.lit("name").alias("attr"))
    return first.unionByName(ranked)


def variants(log_cases: DataFrame) -> DataFrame:
    """Distinct traces, how many cases follow each, and the least case id among them."""
    return log_cases.groupBy("trace").agg(F.count("*").alias("num_cases"), F.min("case_id").alias("first_case"))


def variant_probabilities(log_cases: DataFrame) -> DataFrame:
    total = log_cases.agg(F.count("*").alias("total"))
    return variants(log_cases).withColumn("probability", F.col("num_cases") / total.scalar())


def matrix(events: DataFrame, attrs: list[str]) -> DataFrame:
    """Events in rows with an artificial start and end row per case: name, timestamp and the given attributes."""
    body = events.select(
        "case_id", F.col("pos").alias("event_position"), F.col("activity").alias("name"), F.col("ts").alias("timestamp"),
        *[F.col("attrs")[a].alias(a) for a in attrs],
    )
    ends = case_lengths(events).select(
        "case_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(START).alias("s")),
                F.struct((F.col("num_events") + 1).alias("p"), F.lit(END).alias("s")),
            )
        ).alias("e"),
    )
    return body.unionByName(
        ends.select(
            "case_id", F.col("e.p").alias("event_position"), F.col("e.s").alias("name"),
            F.lit(None).cast(body.schema["timestamp"].dataType).alias("timestamp"), *[F.col("e.s").alias(a) for a in attrs],
        )
    )


def filter_variants(log_cases: DataFrame, repeats: int = 2) -> DataFrame:
    """First case of each variant longer than one event with no activity over ``repeats`` times.

    Survivors are renamed c1, c2, ... in the order of their first case ids.
    """
    # In sorted order an activity occurs more than ``repeats`` times iff it equals the entry so far ahead.
    ordered = F.sort_array("trace")
    again = F.zip_with(ordered, F.slice(ordered, repeats + 1, F.size("trace")), lambda a, b: a == b)
    rare = ~F.coalesce(F.exists(again, lambda same: same), F.lit(False))
    kept = variants(log_cases.where(F.size("trace") > 1)).where(rare)
    return numbered(kept, [], None, ["first_case"], "i").select(
        F.concat(F.lit("c"), F.col("i")).alias("case_id"), "trace"
    )


def first_case_variants(log_cases: DataFrame, limit: int) -> DataFrame:
    """Distinct bracketed traces of the first ``limit`` cases."""
    return (
        log_cases.orderBy("case_id").limit(limit)
        .select(F.concat(F.lit("["), trace_text(F.col("trace")), F.lit("]")).alias("trace")).distinct()
    )


def append_event(log_cases: DataFrame, activity: str) -> DataFrame:
    return log_cases.withColumn("trace", F.array_append("trace", F.lit(activity))).withColumn("n", F.size("trace"))


def clone_cases(log_cases: DataFrame, prefix: str) -> DataFrame:
    return log_cases.withColumn("case_id", F.concat(F.lit(prefix), F.col("case_id")))


def index_of(trace: Column, activity: str) -> Column:
    """Position of the first such event from 0, null where there is none."""
    return F.nullif(F.array_position(trace, activity), F.lit(0)) - 1
