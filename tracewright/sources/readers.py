"""Readers of event logs and process models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import case_log
from ..session import settle

EVENT = "struct<name:string,timestamp:string,attributes:map<string,string>>"
CASE = f"struct<id:string,attributes:map<string,string>,events:array<{EVENT}>>"
LOG_DOCUMENT = f"attributes map<string,string>, cases array<{CASE}>, traces array<{CASE}>"

XES_KINDS = ["string", "date", "int", "float", "boolean", "id"]
XES_ATTRIBUTES = ",".join(f"`{k}`:array<struct<_key:string,_value:string>>" for k in XES_KINDS)
XES_TRACE = XES_ATTRIBUTES.replace("`:", "` ") + f", event array<struct<{XES_ATTRIBUTES}>>"


def _with_row(df: DataFrame) -> DataFrame:
    """Rows with their place: file, split and row within it. Written, so that it is the same in every stage.

    Spark reads large splits first, so the row number alone would not follow the files.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return settle(df.select("*", *place).withColumn("row", F.monotonically_increasing_id()))


PLACE = ["file", "block", "row"]


def _in_file_order(df: DataFrame, case: str, activity: Column, order: list | None, slot: Column | None, *keep) -> DataFrame:
    """EVENTS ordered by the given columns, else as the rows stand in the file."""
    if order is None:
        df, order, slot = _with_row(df), PLACE, F.struct("file", "block")
    return case_log(df, case, activity, order, slot, *keep)


def read_csv_log(spark: SparkSession, path: str, order=None, slot=None, schema: str | None = None) -> DataFrame:
    """Flat log ``case_id, name, isAnomaly, anomaly``: EVENTS with ``is_anomaly`` and ``anomaly``.

    Columns are text, but for the flag, unless a schema is given: nothing is read twice to find types.
    """
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if "isAnomaly" in df.columns:
        df = df.withColumn("isAnomaly", F.col("isAnomaly").cast("int")).withColumnRenamed("isAnomaly", "is_anomaly")
    keep = [c for c in df.columns if c not in ("case_id", "name", "pos")]
    return _in_file_order(df, "case_id", F.col("name"), order, slot, *keep)


def read_train_test(
    spark: SparkSession, train_path: str, test_path: str, train_rows: int | None = None, test_rows: int | None = None,
    order: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A training (case, name) and a test (case, name, flag) CSV, columns named by place.

    With a number of rows, the first ones by ``order``, or as the rows stand in the file; else all of them.
    """
    def head(path, names, rows):
        df = spark.read.option("header", True).csv(path)
        df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)])
        by = PLACE if order is None else order
        df = _with_row(df) if order is None else df
        df = df.orderBy(*by).limit(rows) if rows is not None else df
        return df.sort("case_id", *by).select(*names)

    train = head(train_path, ["case_id", "name"], train_rows)
    test = head(test_path, ["case_id", "name", "isAnomaly"], test_rows)
    return train, test


def read_timed_csv(spark: SparkSession, path: str, order=None, slot=None) -> DataFrame:
    """Log ``case_id, start_time, end_time, event, user``; end and user become attributes."""
    df = spark.read.option("header", True).csv(path)
    df = df.withColumn("attrs", F.create_map(F.lit("end_time"), F.col("end_time"), F.lit("user"), F.col("user")))
    df = df.withColumn("ts", F.col("start_time"))
    return _in_file_order(df, "case_id", F.col("event"), order, slot, "ts", "attrs")


def _case_events(rows: DataFrame) -> DataFrame:
    """From a column ``c`` of cases: EVENTS with the case attributes."""
    return rows.select(
        F.col("c.id").alias("case_id"), F.col("c.attributes").alias("case_attrs"), F.posexplode("c.events").alias("p", "e")
    ).select(
        "case_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.col("e.name").alias("activity"),
        F.col("e.timestamp").alias("ts"), F.col("e.attributes").alias("attrs"), "case_attrs",
    )


def read_json_log(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Log documents, plain or gzipped, with their cases under ``cases`` or the older ``traces``.

    ``lines``: one document per line instead of one per file.
    """
    docs = spark.read.schema(LOG_DOCUMENT).option("multiLine", not lines).json(path)
    return _case_events(docs.select(F.explode(F.coalesce("traces", "cases")).alias("c")))


def _xes_map(node: str) -> Column:
    """All attributes of a node in one map; kinds that do not occur are skipped."""
    none = F.array().cast("array<struct<_key:string,_value:string>>")
    parts = [F.coalesce(F.col(f"{node}{kind}"), none) for kind in XES_KINDS]
    entries = F.transform(F.concat(*parts), lambda a: F.struct(a["_key"].alias("key"), a["_value"].alias("value")))
    keys = F.transform(F.concat(*parts), lambda a: a["_key"])
    # Of entries with the same key the last one stays; an entry without a key is none.
    last = F.filter(entries, lambda e, i: e["key"].isNotNull() & ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.map_from_entries(last)


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """XES log: EVENTS with all attributes as text, and the attributes of the trace."""
    traces = spark.read.format("xml").option("rowTag", "trace").schema(XES_TRACE).load(path)
    cases = traces.select(_xes_map("").alias("all_attrs"), F.col("event").alias("events"))
    cases = cases.select(
        F.element_at("all_attrs", "concept:name").alias("case_id"),
        F.map_filter("all_attrs", lambda k, v: k != "id").alias("case_attrs"),
        F.posexplode("events").alias("p", "e"),
    )
    rows = cases.select("case_id", "case_attrs", (F.col("p") + 1).cast("bigint").alias("pos"), _xes_map("e.").alias("attrs"))
    return rows.select(
        "case_id", "pos", F.element_at("attrs", "concept:name").alias("activity"),
        F.element_at("attrs", "time:timestamp").alias("ts"), "attrs", "case_attrs",
    )


def read_xes_header(spark: SparkSession, path: str) -> DataFrame:
    """Extensions, global attributes and classifiers of an XES log: ``part, scope, key, type, value``."""
    def rows(tag, schema):
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    extensions = rows("extension", "_name string, _prefix string, _uri string").select(
        F.lit("extension").alias("part"), F.lit(None).cast("string").alias("scope"), F.col("_name").alias("key"),
        F.col("_prefix").alias("type"), F.col("_uri").alias("value"),
    )
    scope = rows("global", "_scope string, " + XES_ATTRIBUTES.replace("`:", "` "))
    none = F.array().cast("array<struct<_key:string,_value:string>>")
    def typed(kind):
        return F.transform(
            F.coalesce(F.col(kind), none),
            lambda a: F.struct(a["_key"].alias("key"), F.lit(kind).alias("type"), a["_value"].alias("value")),
        )

    global_attrs = scope.select(F.col("_scope").alias("scope"), F.explode(F.concat(*[typed(k) for k in XES_KINDS])).alias("a")).select(
        F.lit("global").alias("part"), "scope", "a.key", "a.type", "a.value"
    )
    classifiers = rows("classifier", "_name string, _keys string").select(
        F.lit("classifier").alias("part"), F.lit(None).cast("string").alias("scope"), F.col("_name").alias("key"),
        F.lit(None).cast("string").alias("type"), F.explode(F.split("_keys", " ")).alias("value"),
    )
    return extensions.unionByName(global_attrs).unionByName(classifiers)


def read_log(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Log by suffix: XES, JSON or JSON lines (``.jsonl``), plain or gzipped, CSV; a bare name means its ``.json.gz``.

    ``lines``: a JSON path holds one document per line, whatever its suffix.
    """
    bare = path.removesuffix(".gz")
    if bare.endswith(".xes"):
        return read_xes(spark, path)
    if bare.endswith((".json", ".jsonl")):
        return read_json_log(spark, path, lines or bare.endswith(".jsonl"))
    if bare.endswith(".csv"):
        return read_timed_csv(spark, path)
    return read_json_log(spark, path + ".json.gz", lines)


def read_table_log(table: DataFrame, slot: Column | None = None) -> DataFrame:
    """EVENTS of a table ``CaseId, ActivityName, Resource, Timestamp, SortKey`` in that order.

    ``slot`` must grow with the time stamp; by default it is the hour.
    """
    shown = F.concat(F.lit('"'), F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit('"'))
    rows = table.withColumn("ts", F.coalesce(shown, F.lit("")))
    rows = rows.withColumn("attrs", F.create_map(F.lit("resource"), F.col("Resource").cast("string")))
    hour = F.coalesce(F.floor(F.unix_seconds(F.col("Timestamp").cast("timestamp")) / 3600), F.lit(-(2**62)))
    return case_log(
        rows, "CaseId", F.col("ActivityName"), ["Timestamp", "SortKey", "ActivityName"],
        hour if slot is None else slot, "ts", "attrs",
    )


def read_jdbc_log(
    spark: SparkSession, url: str, partition_column: str, lower: str | int, upper: str | int, partitions: int,
    schema: str = "pm", **options,
) -> DataFrame:
    """The same from a database table ``<schema>.EventLog``, read in ``partitions`` ranges of a column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"{schema}.EventLog")
    parts = {"partitionColumn": partition_column, "lowerBound": lower, "upperBound": upper, "numPartitions": partitions}
    return read_table_log(reader.options(**parts, **options).load())


def read_model_csv(spark: SparkSession, path) -> DataFrame:
    """Process-model CSVs with headers in lower case; a row without a namespace is an error."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    df = df.toDF(*[c.replace(" ", "_").lower() for c in df.columns])
    checked = F.when(F.col("namespace").isNull(), F.raise_error(F.lit("model without a namespace"))).otherwise(F.col("namespace"))
    return df.withColumn("namespace", checked)


def models_with_meta(files: DataFrame, language: str = "en", group: str = "BPMN") -> DataFrame:
    """Models among the (file, value) rows whose meta document names the language and the group.

    A model ``x.json`` belongs to the meta document ``x.meta.json``.
    """
    is_meta = F.col("file").endswith(".meta.json")
    models = files.where(~is_meta).select(
        F.regexp_replace("file", r"\.json$", "").alias("model_id"), F.col("value").alias("model_json")
    )
    schema = "model struct<naturalLanguage:string,groupName:string,modelingLanguage:string>"
    meta = (
        files.where(is_meta)
        .select(F.regexp_replace("file", r"\.meta\.json$", "").alias("model_id"), F.from_json("value", schema).alias("m"))
        .where((F.col("m.model.naturalLanguage") == language) & F.col("m.model.groupName").contains(group))
        .select("model_id", F.col("m.model.modelingLanguage").alias("modeling_language"))
    )
    return models.join(meta, "model_id")


def read_model_dir(spark: SparkSession, path: str, language: str = "en", group: str = "BPMN") -> DataFrame:
    """The same from a directory of such files."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return models_with_meta(files.select(F.col("_metadata.file_name").alias("file"), "value"), language, group)


def is_english_bpmn(meta: Column) -> Column:
    """Whether a parsed meta document describes an English BPMN 2.0 model."""
    return (meta["model"]["modelingLanguage"] == "bpmn20") & (meta["model"]["naturalLanguage"] == "en")


__all__ = [
    "read_csv_log", "read_train_test", "read_timed_csv", "read_json_log", "read_xes", "read_xes_header", "read_log",
    "read_table_log", "read_jdbc_log", "read_model_csv", "models_with_meta", "read_model_dir",
    "is_english_bpmn",
]
