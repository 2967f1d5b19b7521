"""Writers of logs and results. Every writer is one distributed write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_documents(events: DataFrame, case_attrs: Column | None = None, log_attrs: dict | None = None) -> DataFrame:
    """One log document per case: ``attributes`` and ``cases`` with the events in order."""
    no_attrs = F.create_map().cast("map<string,string>")
    event = F.struct(
        "pos", F.col("activity").alias("name"), F.col("ts").cast("string").alias("timestamp"),
        F.coalesce(F.col("attrs"), no_attrs).alias("attributes"),
    )
    # Maps cannot be sorted, so the steps are ordered by their position alone.
    steps = F.array_sort(F.collect_list(event), lambda a, b: (a["pos"] - b["pos"]).cast("int"))
    given = F.create_map(*[F.lit(str(x)) for kv in (log_attrs or {}).items() for x in kv]) if log_attrs else no_attrs
    attrs = F.first(case_attrs) if case_attrs is not None else no_attrs
    docs = events.groupBy("case_id").agg(steps.alias("s"), attrs.alias("a"))
    kept = F.transform("s", lambda e: F.struct(e["name"].alias("name"), e["timestamp"].alias("timestamp"), e["attributes"].alias("attributes")))
    case = F.struct(F.col("case_id").alias("id"), F.col("a").alias("attributes"), kept.alias("events"))
    return docs.select(given.alias("attributes"), F.array(case).alias("cases"))


def write_json_log(events: DataFrame, path: str, mode: str = "errorifexists", **kw) -> None:
    log_documents(events, **kw).write.mode(mode).json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


def write_results(rows: DataFrame, path: str, dataset: str, encoding: str, run: int) -> None:
    """Write a result table as CSV under dataset, encoding and run; a repeated run replaces its own partition."""
    keys = {"dataset": dataset, "encoding": encoding, "run": run}
    body = rows.drop(*keys)
    for name, value in keys.items():
        body = body.withColumn(name, F.lit(value))
    write_keyed_results(body, path)


def write_keyed_results(rows: DataFrame, path: str) -> None:
    """The same for rows that carry dataset, encoding and run."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True)
    writer.partitionBy("dataset", "encoding", "run").csv(path)


def write_xes_traces(events: DataFrame, path: str) -> None:
    """Traces as XES elements in a log element; attributes are written as strings."""
    def attribute(key, value):
        return F.struct(key.alias("_key"), value.alias("_value"))

    none = F.array().cast("array<struct<_key:string,_value:string>>")
    entries = F.coalesce(F.transform(F.map_entries("attrs"), lambda e: attribute(e["key"], e["value"])), none)
    event = F.struct(
        "pos",
        F.concat(F.array(attribute(F.lit("concept:name"), F.col("activity"))), entries).alias("string"),
        F.array(attribute(F.lit("time:timestamp"), F.col("ts").cast("string"))).alias("date"),
    )
    steps = F.sort_array(F.collect_list(event))
    traces = events.groupBy("case_id").agg(steps.alias("s")).select(
        F.array(attribute(F.lit("concept:name"), F.col("case_id"))).alias("string"),
        F.transform("s", lambda e: F.struct(e["string"].alias("string"), e["date"].alias("date"))).alias("event"),
    )
    traces.write.format("xml").option("rootTag", "log").option("rowTag", "trace").save(path)
