"""Event logs, models and graphs that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, draw_below
from ..operators import inject as inj
from ..operators.kinds import Kind
from ..operators.labels import CLASS_CODES
from ..operators.log import case_log, cases, sessions
from ..operators.vocab import Lookup, vocabulary
from ..session import scratch, settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_log(spark, sf_dir) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))


def session_cases(spark, sf_dir) -> DataFrame:
    return cases(session_log(spark, sf_dir))


def order_log(spark, sf_dir, positions: bool = True) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return case_log(
        lines, "l_orderkey", F.concat("l_returnflag", "l_linestatus"),
        ["l_shipdate", "l_linenumber", "l_partkey"],
        F.year("l_shipdate") * 12 + F.month("l_shipdate"),
        F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("lane"), positions=positions,
    )


def sized_orders(spark, sf_dir) -> DataFrame:
    """The order log with the length of each case; written, as several tables are made of it."""
    whole = Window.partitionBy("case_id")
    return settle(order_log(spark, sf_dir).withColumn("num_events", F.count("*").over(whole)))


def dialogue_log(spark, sf_dir, positions: bool = True) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return case_log(turns, "conv_id", F.col("role"), ["turn"], F.floor(F.col("turn") / 1000), positions=positions)


def words(spark, sf_dir) -> Lookup:
    """Vocabulary of the sessions; every click is in one, so the clicks alone tell it."""
    return Lookup(vocabulary(table(spark, sf_dir, "events").select(F.col("event_type").alias("activity"))))


def labelled_sessions(spark, sf_dir) -> DataFrame:
    """Sessions of which a tenth has a skipped sequence and a tenth an insert."""
    d = draw_below(10, "mix", F.col("case_id"))
    kind = F.when(d == 0, "SkipSequence").when(d == 1, "Insert").otherwise("Normal")
    rows = inj.as_kind(session_cases(spark, sf_dir), kind)
    out = inj.inject(rows, words(spark, sf_dir), kinds=["SkipSequence", "Insert"])
    flag = (F.col("label.anomaly") != "normal").cast("int")
    return out.select(
        "case_id", "n", "trace", F.array_repeat(flag, F.col("n")).alias("flags"), F.col("label.anomaly").alias("anomaly")
    )


def model_cases(spark, sf_dir) -> DataFrame:
    """Sessions with the user as the model."""
    return cases(session_log(spark, sf_dir), "user_id").withColumnRenamed("user_id", "model_id")


def swept_sessions(spark, sf_dir, log: DataFrame | None = None, times: int = 2) -> DataFrame:
    """The standard sweep over the sessions (or the given ones, written), with the runs that mix exclusive branches."""
    log = settle(model_cases(spark, sf_dir)) if log is None else log
    mine = settle(branches_of(log.select("model_id", F.explode("trace").alias("activity"))), "branches")
    return inj.sweep(log, words(spark, sf_dir), times).unionByName(inj.exclusive_rows(playouts(log), mine))


def playouts(log: DataFrame) -> DataFrame:
    """Runs of a model without its exclusive choices: the traces of its cases, last event first."""
    return log.select("model_id", F.reverse("trace").alias("trace"))


def branches(spark, sf_dir) -> DataFrame:
    """BRANCHES of one choice per user: the user's activities parted by a draw into three."""
    return branches_of(session_log(spark, sf_dir).select(F.col("user_id").alias("model_id"), "activity"))


def branches_of(steps: DataFrame) -> DataFrame:
    """The same from the steps of the models: (model_id, activity)."""
    return steps.distinct().select(
        "model_id", F.lit("x1").alias("xor_id"),
        draw_below(3, "side", F.col("model_id"), F.col("activity")).alias("branch_id"), "activity",
    )


def responses(rows: DataFrame) -> DataFrame:
    """Recorded answers for test rows: mostly right, with wrong, unknown and malformed ones."""
    d = draw_below(20, F.col("row_id"), "response")
    other = F.when(F.col("label") == "normal", "anomalous").otherwise("normal")
    said = F.when(d < 3, other).when(d == 3, "strange").otherwise(F.col("label"))
    tokens = F.split("cause", " ")
    kept = F.when(
        d < 8, F.filter(tokens, lambda w, i: F.pmod(draw(F.col("row_id"), "word", i), F.lit(5)) > 0)
    ).otherwise(tokens)
    said_cause = F.concat(F.lit(" \\n "), F.array_join(kept, " "), F.lit("</s>"))
    return rows.select(
        "row_id", "trace", "label", "cause",
        F.when(d == 4, F.lit(" \\n No answer."))
        .otherwise(F.concat(F.lit(" \\n The trace is "), said, F.lit(".</s>"))).alias("response"),
        F.when(d == 4, F.lit("no answer")).otherwise(said_cause).alias("cause_response"),
    )


def order_elements(spark, sf_dir) -> DataFrame:
    """ELEMENTS with one row per order line, labelled by its part."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), F.col("p_name").alias("part_name"), F.col("p_type").alias("part_type")
    )
    act = F.col("activity")
    category = (
        F.when(act == "AF", "StartNoneEvent").when(act == "AO", "StartMessageEvent").when(act == "RF", "Task")
        .when(act == "RO", "Subprocess").when(act == "NF", "EndNoneEvent").otherwise("Exclusive_Databased_Gateway")
    )
    return order_log(spark, sf_dir).join(part, "part").select(
        F.col("case_id").alias("model_id"), F.concat(F.lit("e"), F.col("pos")).alias("element_id"),
        F.col("part_type").alias("name"), category.alias("category"),
        F.when(F.col("pos") % 5 == 0, F.lit(None)).when(F.col("pos") % 4 == 0, "A").otherwise(F.col("part_name")).alias("label"),
    )


def part_labels(spark, sf_dir) -> DataFrame:
    """Label texts of many forms, one per part."""
    key = F.col("p_partkey") % 8
    name = F.col("p_name")
    camel = F.replace(F.initcap(name), F.lit(" "), F.lit(""))
    label = (
        F.when(key == 0, name)
        .when(key == 1, F.concat(camel, F.lit("(s) #"), F.col("p_size"), F.lit("\n x "), F.lower("p_type")))
        .when(key == 2, F.col("p_size").cast("string"))
        .when(key == 3, F.lit("Task"))
        .when(key == 4, F.concat(F.lit("Exclusive Gateway "), F.col("p_brand")))
        .when(key == 5, F.lit(""))
        .when(key == 6, F.concat(F.lit("Subprocess "), name))
    )
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), camel.alias("camel"))


def notations(spark, sf_dir) -> DataFrame:
    """Notation table: part brands and how many parts bear them; a tenth of the brands is ``Other``."""
    brand = F.when(F.col("p_brand") == "Brand#1", "Other").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").groupBy(brand.alias("notation")).agg(F.count("*").alias("frequency"))


def model_documents(spark, sf_dir) -> DataFrame:
    """One JSON model per order: lanes of tasks and, beside them, the arcs between the lines.

    The lines are gathered where their positions are told, by one shuffle.
    """
    none_out = F.array().cast("array<struct<resourceId:string>>")
    task_type = (
        "array<struct<resourceId:string,stencil:struct<id:string>,properties:struct<name:string>,"
        "outgoing:array<struct<resourceId:string>>,glossaryLinks:struct<name:array<string>>>>"
    )
    count = F.size("lines")

    def ref(prefix, value):
        return F.array(F.struct(F.concat(F.lit(prefix), value).alias("resourceId")))

    def shape(rid, kind, name, out, children):
        return F.struct(
            rid.alias("resourceId"), F.struct(F.lit(kind).alias("id")).alias("stencil"),
            F.struct(name.alias("name")).alias("properties"), out.alias("outgoing"), children.cast(task_type).alias("childShapes"),
        )

    def task(line):
        pos, act = line["pos"], line["activity"]
        stencil = F.when(act == "RF", "Exclusive_Databased_Gateway").when(act == "RO", "IntermediateTimerEvent").otherwise("Task")
        label = F.when(pos % 4 == 0, "").otherwise(F.concat(F.lit("Handle\nPart"), act, F.lit(" "), line["part"]))
        return F.struct(
            F.concat(F.lit("n"), pos).alias("resourceId"),
            F.struct(stencil.alias("id")).alias("stencil"),
            F.struct(label.alias("name")).alias("properties"),
            F.when(pos < count, ref("f", pos)).otherwise(none_out).alias("outgoing"),
            F.when(pos % 3 == 0, F.struct(F.array(F.concat(F.lit("/glossary/"), line["part"])).alias("name"))).alias("glossaryLinks"),
        )

    def lane(name):
        tasks = F.transform(F.filter("lines", lambda line: line["lane"].eqNullSafe(name)), task)
        return shape(F.concat(F.lit("lane"), name), "Lane", name, none_out, tasks)

    def arc(line):
        return shape(F.concat(F.lit("f"), line["pos"]), "SequenceFlow", F.lit(""), ref("n", line["pos"] + 1), F.lit(None))

    orders = order_log(spark, sf_dir).groupBy("case_id").agg(F.collect_list(F.struct("pos", "activity", "part", "lane")).alias("lines"))
    lanes = F.transform(F.array_distinct(F.col("lines.lane")), lane)
    arcs = F.transform(F.filter("lines", lambda line: line["pos"] < count), arc)
    docs = orders.select("case_id", F.concat(lanes, arcs).alias("childShapes"))
    key = F.col("case_id").cast("bigint")
    return docs.select(
        F.col("case_id").alias("model_id"),
        F.concat(F.lit("order "), F.col("case_id")).alias("name"),
        F.lit("Model").alias("type"),
        F.when(key % 10 == 0, "http://b3mn.org/stencilset/epc#").otherwise("http://b3mn.org/stencilset/bpmn2.0#").alias("namespace"),
        F.to_json(F.struct(F.concat(F.lit("root"), F.col("case_id")).alias("resourceId"), "childShapes")).alias("model_json"),
    )


def model_files(spark, sf_dir) -> DataFrame:
    """(file, value) rows: a model document and its meta document per order."""
    docs = model_documents(spark, sf_dir)
    key = F.col("model_id").cast("bigint")
    meta = F.to_json(
        F.struct(
            F.struct(
                F.when(key % 4 == 0, "de").otherwise("en").alias("naturalLanguage"),
                F.when(key % 3 == 0, "EPC").otherwise("BPMN 2.0").alias("groupName"),
                F.lit("bpmn20").alias("modelingLanguage"),
            ).alias("model")
        )
    )
    pair = F.array(
        F.struct(F.concat("model_id", F.lit(".json")).alias("file"), F.col("model_json").alias("value")),
        F.struct(F.concat("model_id", F.lit(".meta.json")).alias("file"), meta.alias("value")),
    )
    return docs.select(F.explode(pair).alias("f")).select("f.*")


def order_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """NODES and EDGES with one model per order.

    Lines follow each other over arcs, with shortcuts, steps back, direct edges and message flows.
    """
    rows = sized_orders(spark, sf_dir).withColumnRenamed("case_id", "model_id")
    p, n, act = F.col("pos"), F.col("num_events"), F.col("activity")
    plain = act.isin("AF", "AO", "NO")
    inner = (p > 1) & (p < n)
    label = (
        F.when(p == 1, "StartNoneEvent").when(p == n, "EndNoneEvent")
        .when(plain, F.concat(F.lit("handle "), F.lower(act), F.lit(" "), (F.col("part") % 7).cast("string")))
        .when(act == "RF", "Exclusive_Databased_Gateway").when(act == "RO", "ParallelGateway")
        .otherwise("IntermediateTimerEvent")
    )

    def arc(there, prefix, kind, target):
        rid = F.concat(F.lit(prefix), p)
        return F.when(there, F.struct(rid.alias("id"), F.lit(kind).alias("label"), F.concat(F.lit("n"), target).alias("dst")))

    arcs = F.array_compact(
        F.array(
            arc((p < n) & (p % 5 != 0), "f", "SequenceFlow", p + 1),
            arc((p % 3 == 1) & (p + 2 <= n), "s", "SequenceFlow", p + 2),
            arc((p % 4 == 2) & (p + 3 <= n), "m", "MessageFlow", p + 3),
            arc(p % 6 == 0, "b", "SequenceFlow", p - 1),
        )
    )
    me = F.concat(F.lit("n"), p)
    flows = rows.select("model_id", me.alias("me"), F.explode(arcs).alias("a"))
    direct = rows.where((p < n) & (p % 5 == 0)).select("model_id", me.alias("src"), F.concat(F.lit("n"), p + 1).alias("dst"))
    edges = (
        flows.select("model_id", F.explode(F.array(
            F.struct(F.col("me").alias("src"), F.col("a.id").alias("dst")),
            F.struct(F.col("a.id").alias("src"), F.col("a.dst").alias("dst")),
        )).alias("e")).select("model_id", "e.src", "e.dst").unionByName(direct)
    )
    shapes = rows.select("model_id", me.alias("id"), label.alias("label"), (inner & plain).alias("is_task"))
    others = flows.select("model_id", F.col("a.id").alias("id"), F.col("a.label").alias("label"), F.lit(False).alias("is_task"))
    data = rows.where(p == 1).select("model_id", F.lit("d0").alias("id"), F.lit("DataObject").alias("label"), F.lit(False).alias("is_task"))
    return shapes.unionByName(others).unionByName(data), edges


def xml_text(value) -> Column:
    """A value inside quotes of an XML attribute."""
    text = F.replace(F.replace(value.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit('"'), F.lit("&quot;"))


def xml_attribute(kind: str, key: str, value=None, *inside) -> Column:
    """An attribute element of a log with those inside it; without a value where that is null."""
    shown = F.lit("") if value is None else F.coalesce(F.concat(F.lit(' value="'), xml_text(value), F.lit('"')), F.lit(""))
    return F.concat(F.lit(f'<{kind} key="{key}"'), shown, F.lit(">"), *inside, F.lit(f"</{kind}>"))


def nested_xes(spark, sf_dir, path: str) -> None:
    """The sessions as an XES log with nested attributes: of the log, of each trace and of each event."""
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    props = xml_attribute("container", "props", None, xml_attribute("string", "k", F.col("attrs")["k"], xml_attribute("float", "value", F.col("attrs")["value"])))
    event = F.concat(F.lit("<event>"), xml_attribute("string", "concept:name", F.col("activity")), xml_attribute("date", "time:timestamp", at), props, F.lit("</event>"))
    steps = F.sort_array(F.collect_list(F.struct("pos", event.alias("x"))))
    whole = session_log(spark, sf_dir).groupBy("case_id", "user_id").agg(steps.alias("s"))
    users = xml_attribute("list", "users", None, F.lit("<values>"), xml_attribute("string", "user", F.col("user_id")), xml_attribute("int", "user", F.size("s")), F.lit("</values>"))
    traces = whole.select(F.concat(F.lit("<trace>"), xml_attribute("string", "concept:name", F.col("case_id")), users, F.array_join("s.x", ""), F.lit("</trace>")).alias("value"))
    inner = xml_attribute("int", "format", F.lit(1), xml_attribute("boolean", "nested", F.lit("true")))
    head = spark.range(1).select(F.concat(F.lit("<log>"), xml_attribute("string", "origin", F.lit("sessions"), inner)).alias("value"))
    head.unionByName(traces).write.text(path)


def event_stream(spark, sf_dir, labelled: DataFrame) -> DataFrame:
    """The events of labelled CASES as a stream of files, dealt by hash: a case's events lie in many files."""
    begin = session_log(spark, sf_dir).where("pos = 1").select("case_id", F.col("ts").cast("timestamp").alias("begin"))
    steps = labelled.select("case_id", F.posexplode("trace").alias("p", "activity")).join(begin, "case_id")
    rows = steps.select("case_id", (F.col("p") + 1).alias("pos"), "activity", (F.col("begin") + F.make_dt_interval(secs=F.col("p"))).alias("ts"))
    path = scratch(spark, "stream")
    rows.repartition(32, "case_id", "pos").write.option("maxRecordsPerFile", 1_000_000).parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 16).parquet(path)


#: Two types of our own: neighbours that change places, and drawn activities behind the end.
SWAP = Kind(
    "Swap", 2, draws={"at": lambda c: c.below(c.n - 1, "at")},
    rewrite=lambda c: F.concat(
        F.slice(c.trace, 1, c.drawn["at"]), F.reverse(F.slice(c.trace, c.drawn["at"] + 1, 2)), F.slice(c.trace, c.drawn["at"] + 3, c.n)
    ),
    label=lambda c: {"start": c.drawn["at"], "size": F.lit(2), "acts": F.slice(c.trace, c.drawn["at"] + 1, 2)},
    code=lambda l, i: F.when((i >= l["start"]) & (i < l["start"] + 2), CLASS_CODES["Shift"]),
    text=lambda l: F.concat(F.lit("Swap "), F.array_join(l["acts"], ", "), F.lit(" at "), (l["start"] + 1).cast("string")),
    cause=lambda l, trace: F.format_string("The activities '%s' and '%s' are swapped.", l["acts"][0], l["acts"][1]),
)
APPEND = Kind(
    "Append", 1, num_names=lambda c: 1 + c.below(2, "count"), rewrite=lambda c: F.concat(c.trace, c.names),
    label=lambda c: {"size": F.size(c.names), "indices": F.sequence(c.n, c.n + F.size(c.names) - 1), "acts": c.names},
    code=lambda l, i: F.when(F.array_contains(l["indices"], i), CLASS_CODES["Insert"]),
    attr_code=lambda l, i: F.when(F.array_contains(l["indices"], i), CLASS_CODES["Attribute"]),
)
