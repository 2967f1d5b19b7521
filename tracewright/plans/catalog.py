"""The registered queries: each library operation over whole given tables, with flat output columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.draws import draw_below
from ..operators import dataset as ds
from ..operators import detect as dt
from ..operators import embeddings as em
from ..operators import graph as g
from ..operators import inject as inj
from ..operators import kinds as ks
from ..operators import labels as lb
from ..operators import log as lg
from ..operators import metrics as me
from ..operators import models as mo
from ..operators import prefixes as px
from ..operators.vocab import vocabulary
from ..session import settle
from ..sources import readers as rd
from ..sources import sinks as sk
from ..sources.xes import read_xes_attributes
from ..streaming import scorer
from . import tables as tb
from .detection import Run, score_slot
from .sweep import run_sweep as sweep

QUERIES = {}

# Parameters of the registered queries, shared with their SQL counterparts.
TEST_MODELS = 30
FIRST_CASES = 100
FIRST_ROWS = 500
EXAMPLE_TYPES = ["ECONOMY", "SMALL"]
TOP_NOTATIONS = 5
RARE_BELOW = 85
ATTRS = ["k", "value"]


def query(fn):
    QUERIES[f"q_{fn.__name__}"] = fn
    return fn


def joined(col, sep: str = ",") -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.array_join(col, sep)


def ints(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


def label_columns(df: DataFrame) -> DataFrame:
    l = F.col("label")
    return df.select(
        "case_id", "kind", "round", joined("trace").alias("trace"), l["anomaly"].alias("anomaly"), l["size"].alias("size"),
        l["start"].alias("start"), l["shift_from"].alias("shift_from"), l["shift_to"].alias("shift_to"),
        ints(l["indices"]).alias("indices"), ints(l["inserts"]).alias("inserts"), ints(l["skips"]).alias("skips"),
        joined(l["acts"]).alias("acts"),
    )


# --- sources and sinks ---------------------------------------------------------------------

def _flat_labelled(s, d) -> DataFrame:
    return tb.labelled_sessions(s, d).select(
        "case_id", F.posexplode("trace").alias("p", "name"), F.get("flags", F.lit(0)).alias("isAnomaly"), "anomaly"
    ).select("case_id", "name", "isAnomaly", "anomaly", (F.col("p") + 1).alias("pos"))


@query
def csv_log(s, d):
    path = tb.scratch(s, "csv")
    _flat_labelled(s, d).write.option("header", True).csv(path)
    log = rd.read_csv_log(s, path, order=[F.col("pos").cast("bigint")])
    return log.select("case_id", "pos", "activity", "is_anomaly", "anomaly")


@query
def train_test_csv(s, d):
    train, test = tb.scratch(s, "train"), tb.scratch(s, "test")
    rows = settle(_flat_labelled(s, d))
    rows.where("isAnomaly = 0").select("case_id", "name").write.option("header", True).csv(train)
    rows.select("case_id", "name", "isAnomaly").write.option("header", True).csv(test)
    a, b = rd.read_train_test(s, train, test, order=["case_id", "name"])
    return a.select(F.lit("train").alias("part"), "case_id", "name").unionByName(
        b.select(F.lit("test").alias("part"), "case_id", "name")
    )


@query
def timed_csv(s, d):
    path = tb.scratch(s, "timed")
    clicks = tb.table(s, d, "events")
    clicks.select(
        (F.col("user_id") % 50).alias("case_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        F.date_format(F.col("ts") + F.expr("interval 1 minute"), "yyyy-MM-dd HH:mm:ss").alias("end_time"),
        F.col("event_type").alias("event"), F.col("user_id").alias("user"), "event_id",
    ).write.option("header", True).csv(path)
    log = rd.read_timed_csv(s, path, order=["start_time", F.col("event_id").cast("bigint")], slot=F.substring("start_time", 1, 13))
    return log.select("case_id", "pos", "activity", "ts", F.col("attrs")["end_time"].alias("end_time"), F.col("attrs")["user"].alias("user"))


@query
def json_log(s, d):
    path = tb.scratch(s, "json")
    sk.write_json_log(tb.session_log(s, d), path, case_attrs=F.create_map(F.lit("user"), F.col("user_id").cast("string")))
    log = rd.read_json_log(s, path, lines=True)
    return log.select("case_id", "pos", "activity", F.col("attrs")["k"].alias("k"), F.col("case_attrs")["user"].alias("user"))


@query
def xes_log(s, d):
    path = tb.scratch(s, "xes")
    sk.write_xes_traces(tb.session_log(s, d), path)
    log = rd.read_xes(s, path)
    return log.select("case_id", "pos", "activity", F.col("attrs")["k"].alias("k"))


@query
def xes_nested(s, d):
    """Attributes of a log, its traces and its events, nested two levels deep."""
    path = tb.scratch(s, "xes")
    tb.nested_xes(s, d, path)
    rows = read_xes_attributes(s, path)
    return rows.select("scope", "case_id", "pos", joined("path", "/").alias("path"), "type", "value")


@query
def sql_log(s, d):
    clicks = tb.table(s, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("CaseId"), F.col("event_type").alias("ActivityName"),
        F.get_json_object("props", "$.k").alias("Resource"),
        F.date_trunc("minute", "ts").alias("Timestamp"), F.col("event_id").alias("SortKey"),
    )
    clicks.createOrReplaceTempView("EventLog")
    log = rd.read_table_log(s.table("EventLog"))
    return log.select("case_id", "pos", "activity", "ts", F.col("attrs")["resource"].alias("resource"))


@query
def model_csv(s, d):
    path = tb.scratch(s, "models")
    docs = tb.model_documents(s, d).toDF("Model ID", "Name", "Type", "Namespace", "Model JSON")
    docs.write.option("header", True).option("quote", '"').option("escape", '"').option("compression", "gzip").csv(path)
    return rd.read_model_csv(s, path).select(
        "model_id", "name", "type", "namespace", F.size(F.from_json("model_json", mo.SHAPE)["childShapes"]).alias("num_children")
    )


@query
def model_dir(s, d):
    kept = rd.models_with_meta(tb.model_files(s, d))
    return kept.select("model_id", "modeling_language", F.get_json_object("model_json", "$.resourceId").alias("root"))


@query
def json_sink(s, d):
    docs = sk.log_documents(tb.session_log(s, d)).select(F.explode("cases").alias("c"))
    return docs.select(
        F.col("c.id").alias("case_id"), joined(F.col("c.events.name")).alias("names"),
        joined(F.transform(F.col("c.events"), lambda e: e["attributes"]["k"])).alias("ks"),
    )


@query
def read_log(s, d):
    """The session log in three formats, each read by the suffix of its path."""
    log, paths = tb.session_log(s, d), {kind: f"{tb.scratch(s, kind)}.{kind}" for kind in ("jsonl", "xes", "csv")}
    sk.write_json_log(log, paths["jsonl"])
    sk.write_xes_traces(log, paths["xes"])
    rows = log.select("case_id", F.col("ts").alias("start_time"), F.col("ts").alias("end_time"), F.col("activity").alias("event"), F.lit("u").alias("user"), "pos")
    rows.repartition("case_id").sortWithinPartitions("case_id", "pos").drop("pos").write.option("header", True).csv(paths["csv"])
    parts = [rd.read_log(s, path).select(F.lit(kind.removesuffix("l")).alias("format"), "case_id", "pos", "activity") for kind, path in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def json_lines(s, d):
    path = tb.scratch(s, "lines")
    for log in (tb.session_log(s, d), tb.dialogue_log(s, d)):
        sk.write_json_lines(log.select("case_id", "pos", "activity"), path)
    return s.read.schema("case_id string, pos bigint, activity string").json(path)


# --- event-log analytics -------------------------------------------------------------------

@query
def traces(s, d):
    return tb.session_cases(s, d).select("case_id", joined("trace").alias("trace"))


@query
def case_lens(s, d):
    return lg.case_lengths(tb.session_log(s, d))


@query
def order_lens(s, d):
    return lg.case_lengths(tb.order_log(s, d, positions=False))


@query
def log_summary(s, d):
    parts = [("sessions", tb.session_log), ("orders", tb.order_log), ("dialogues", tb.dialogue_log)]
    rows = [lg.summary(make(s, d) if name == "sessions" else make(s, d, positions=False)).withColumn("log", F.lit(name)) for name, make in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def activities(s, d):
    clicks = tb.table(s, d, "events").select(F.col("event_type").alias("activity"))
    return lg.activities(clicks, tb.order_log(s, d, positions=False), tb.dialogue_log(s, d, positions=False))


@query
def attr_values(s, d):
    return lg.attribute_values(tb.session_log(s, d))


@query
def attr_keys(s, d):
    return lg.attribute_keys(tb.session_log(s, d))


@query
def variants(s, d):
    return lg.variants(tb.session_cases(s, d)).select(joined("trace").alias("trace"), "num_cases", "first_case")


@query
def order_variants(s, d):
    return lg.variants(lg.cases(tb.order_log(s, d))).select(joined("trace").alias("trace"), "num_cases")


@query
def variant_prob(s, d):
    return lg.variant_probabilities(tb.session_cases(s, d)).select(
        joined("trace").alias("trace"), "num_cases", F.round("probability", 12).alias("probability")
    )


@query
def matrix(s, d):
    rows = lg.matrix(tb.session_log(s, d), ATTRS)
    return rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query
def filter_variants(s, d):
    return lg.filter_variants(tb.session_cases(s, d)).select("case_id", joined("trace").alias("trace"))


@query
def variant_text(s, d):
    return lg.first_case_variants(tb.session_cases(s, d), FIRST_CASES)


@query
def append_case(s, d):
    c = tb.session_cases(s, d)
    both = c.unionByName(lg.append_event(lg.clone_cases(c, "copy-"), "closed"))
    return both.select("case_id", "n", joined("trace").alias("trace"), lg.index_of(F.col("trace"), "purchase").alias("first_purchase"))


# --- split, prefixes, encoding -------------------------------------------------------------

@query
def split(s, d):
    train, test = px.split(settle(tb.labelled_sessions(s, d)))
    return train.select("case_id", "n", F.lit("train").alias("part")).unionByName(test.select("case_id", "n", F.lit("test").alias("part")))


@query
def prefixes(s, d):
    return px.prefixes(settle(tb.labelled_sessions(s, d))).select("case_id", "prefix_len", joined("prefix").alias("prefix"), "label")


@query
def prefix_tree(s, d):
    nodes = settle(dt.prefix_tree(tb.session_cases(s, d)), "nodes")
    above = nodes.select(F.col("node").alias("parent"), F.col("cases").alias("parent_cases"))
    return nodes.join(above, "parent", "left").select("depth", "activity", "cases", "ends", "children", "parent_cases")


@query
def prefix_dims(s, d):
    run = Run(tb.labelled_sessions(s, d))
    size = run.vocabulary.agg(F.count("*").alias("c")).scalar()
    return px.prefix_dims(run.train, size)


@query
def vocab(s, d):
    return Run(tb.labelled_sessions(s, d)).vocabulary


@query
def onehot(s, d):
    # Turns of a dialogue against the vocabulary of the users' turns only: some are unknown.
    log = tb.dialogue_log(s, d)
    known = vocabulary(log.where(F.col("activity") != "assistant"))
    return px.onehot(lg.cases(log), known)


@query
def pad(s, d):
    train = Run(tb.labelled_sessions(s, d)).train
    longest = train.agg(F.max("n").alias("m")).scalar()
    lengths = F.transform("trace", lambda a: F.length(a).cast("double"))
    padded = train.select("case_id", px.pad(lengths, longest).alias("v"))
    return padded.select("case_id", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query
def w2v_vocab(s, d):
    run = Run(tb.labelled_sessions(s, d))
    return px.word_vectors(run.train).select("activity", F.posexplode("vec").alias("entry", "value"))


@query
def w2v_encode(s, d):
    run = Run(tb.labelled_sessions(s, d))
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6)
    return px.embed(run.test, px.word_vectors(run.train)).select("case_id", F.size("vector").alias("dim"), total.alias("total"))


@query
def pmi(s, d):
    run = Run(tb.labelled_sessions(s, d))
    return em.mutual_information(run.train).withColumn("value", F.round("value", 9))


@query
def pmi_factors(s, d):
    """The table of mutual information put together again from its factors."""
    run = Run(tb.labelled_sessions(s, d))
    table = settle(em.mutual_information(run.train))
    found, values = em.factors(table)
    weights = F.array(*[F.lit(float(v)) for v in values])
    pairs = table.join(found, "activity").join(found.select(F.col("activity").alias("near"), F.col("u").alias("v")), "near")
    parts = F.zip_with(F.zip_with("u", "v", lambda x, y: x * y), weights, lambda x, w: x * w)
    return pairs.select("activity", "near", F.round(F.aggregate(parts, F.lit(0.0), lambda t, x: t + x), 6).alias("value"))


@query
def model_bottleneck(s, d):
    """The linear model with three directions for each length; for single events its trace has a closed form."""
    r = run(s, d, model_kind="linear", bottleneck=3)
    own = F.when(F.col("prefix_len") == 1, F.element_at("g", F.col("i") + 1))
    return r.model.form.groupBy("prefix_len", "dim").agg(
        F.round(F.max("residual"), 6).alias("residual"), F.round(F.sum(own), 6).alias("trace"), F.count("*").alias("num_rows")
    )


# --- prefix anomaly detection --------------------------------------------------------------

def run(s, d, **kw) -> Run:
    return Run(tb.labelled_sessions(s, d), **kw)


@query
def model_freq(s, d):
    r = run(s, d)
    share = F.round(F.col("c") / F.col("n_fit"), 9)
    return r.model.counts.join(r.model.norms, "prefix_len").select("prefix_len", "pos", "activity", "c", share.alias("share"))


@query
def model_linear(s, d):
    r = run(s, d, model_kind="linear")
    # For single events G is diagonal, and its trace has a closed form.
    own = F.when(F.col("prefix_len") == 1, F.element_at("g", F.col("i") + 1))
    return r.model.form.groupBy("prefix_len", "dim").agg(
        F.round(F.max("residual"), 6).alias("residual"), F.round(F.sum(own), 6).alias("trace"), F.count("*").alias("num_rows")
    )


@query
def noise(s, d):
    lengths = tb.session_cases(s, d).select("n").distinct()
    return lengths.select(F.col("n").alias("prefix_len"), F.round(dt.noise(F.col("n")), 12).alias("noise"))


@query
def val_tail(s, d):
    r = run(s, d)
    return dt.samples(r.train, r.cuts).select("case_id", "prefix_len", F.col("in_tail").cast("int").alias("in_tail"))


@query
def scores_freq(s, d):
    r = run(s, d)
    return r.errors.select("prefix_len", "score", F.col("in_tail").cast("int").alias("in_tail"), "label", "w")


@query
def thresholds(s, d):
    return run(s, d).candidates


@query
def best_threshold(s, d):
    return run(s, d).chosen


@query
def detect(s, d):
    return dt.prefix_records(run(s, d).found)


@query
def case_verdict(s, d):
    return run(s, d).verdicts.drop("first_flag")


@query
def earliness(s, d):
    return dt.earliness(run(s, d).found).withColumn("share", F.round("share", 12))


@query
def stream_earliness(s, d):
    """The same from a stream of the test cases' events, which come in no order and in several batches."""
    r, out = run(s, d), tb.scratch(s, "scores")
    stream = tb.event_stream(s, d, r.test)
    scorer.watch(stream, r.model, settle(r.chosen), out, tb.scratch(s, "checkpoint"), delay="3650 days", availableNow=True).awaitTermination()
    found = scorer.first_flags(s.read.schema("case_id string, prefix_len int, score double, predicted int").parquet(out))
    return found.withColumn("share", F.round("share", 12))


@query
def prefix_counts(s, d):
    return dt.prefix_counts(run(s, d).found)


@query
def detect_linear(s, d):
    return run(s, d, model_kind="linear").verdicts.drop("first_flag")


@query
def detect_word2vec(s, d):
    return run(s, d, encoding="word2vec").verdicts.drop("first_flag")


@query
def result_csv(s, d):
    path, r = tb.scratch(s, "results"), run(s, d)
    for again in (1, 1):  # a repeated run replaces its partition
        sk.write_results(dt.prefix_counts(r.found), path, "sessions", "onehot", again)
    return s.read.schema("prefix_len int, normal_count long, anomaly_count long, dataset string, encoding string, run int").option("header", True).csv(path)


@query
def run_sweep(s, d):
    path = tb.scratch(s, "sweep")
    sweep({"sessions": tb.labelled_sessions(s, d)}, path, runs=[1, 2])
    got = s.read.option("header", True).csv(f"{path}/metrics")
    values = [F.round(F.col(c).cast("double"), 9).alias(c) for c in ("precision", "recall", "f1_score", "roc_auc")]
    return got.select("dataset", "encoding", F.col("run").cast("int").alias("run"), *values)


@query
def run_sweep_logs(s, d):
    """Three logs and two runs in one plan: metrics and flagged cases."""
    path, log = tb.scratch(s, "sweep"), settle(tb.labelled_sessions(s, d))
    side = draw_below(3, "log", F.col("case_id"))
    sweep({f"log{k}": log.where(side == k) for k in range(3)}, path, runs=[1, 2])
    got = s.read.option("header", True).csv(f"{path}/metrics")
    values = [F.round(F.col(c).cast("double"), 9).alias(c) for c in ("precision", "recall", "f1_score", "roc_auc")]
    return got.select("dataset", F.col("run").cast("int").alias("run"), *values)


# --- injection -----------------------------------------------------------------------------

def one_kind(s, d, kind: str) -> DataFrame:
    return label_columns(inj.inject(inj.as_kind(tb.session_cases(s, d), kind), tb.words(s, d), kinds=[kind]))


@query
def inj_skipseq(s, d):
    return one_kind(s, d, "SkipSequence")


@query
def inj_rework(s, d):
    return one_kind(s, d, "Rework")


@query
def inj_early(s, d):
    return one_kind(s, d, "Early")


@query
def inj_late(s, d):
    return one_kind(s, d, "Late")


@query
def inj_insert(s, d):
    return one_kind(s, d, "Insert")


@query
def inj_replace(s, d):
    return one_kind(s, d, "Replace")


@query
def inj_skip(s, d):
    return one_kind(s, d, "Skip")


@query
def inj_skipinsert(s, d):
    return one_kind(s, d, "SkipAndInsert")


@query
def inj_filler(s, d):
    rows = inj.as_kind(tb.session_cases(s, d), "Insert")
    return label_columns(inj.inject(rows, tb.words(s, d), filler=True, kinds=["Insert"]))


def attribute_cells(s, d) -> DataFrame:
    log = tb.session_log(s, d)
    return inj.attribute_anomalies(log, lg.attribute_values(log), lg.case_lengths(log), ATTRS)


@query
def inj_attribute(s, d):
    return attribute_cells(s, d)


@query
def attribute_targets(s, d):
    return lb.attribute_targets(attribute_cells(s, d), ATTRS)


@query
def attribute_label_text(s, d):
    return lb.attribute_label_text(attribute_cells(s, d))


@query
def attribute_log(s, d):
    log = tb.session_log(s, d)
    cells = inj.attribute_anomalies(log, lg.attribute_values(log), lg.case_lengths(log), ATTRS)
    out = inj.attribute_log(log, settle(cells), ATTRS)
    l = F.col("label")
    return out.select(
        "case_id", "pos", "activity", F.col("attrs")["k"].alias("k"), F.col("attrs")["value"].alias("value"), l["anomaly"].alias("anomaly"),
        ints(l["index"]).alias("index"), ints(l["attribute_index"]).alias("attribute_index"),
        joined(l["attribute"]).alias("attribute"), joined(l["original"]).alias("original"),
    )


@query
def branches(s, d):
    return inj.exclusive_branches(tb.branches(s, d))


@query
def exclusive(s, d):
    traces_ = lg.cases(tb.session_log(s, d), "user_id").withColumnRenamed("user_id", "model_id")
    out = inj.exclusive_anomalies(traces_, tb.branches(s, d)).withColumn("cause", lb.cause(F.col("label"), F.col("trace")))
    return out.select(
        "model_id", "xor_id", "i", joined("trace").alias("trace"), joined(F.col("label.part1")).alias("part1"),
        joined(F.col("label.part2")).alias("part2"), "cause",
    )


def all_kinds(s, d) -> DataFrame:
    return inj.sweep(tb.session_cases(s, d), tb.words(s, d), 1, [*inj.SWEEP, *inj.FURTHER])


@query
def inject_all(s, d):
    return label_columns(tb.swept_sessions(s, d))


@query
def targets(s, d):
    return lb.targets(all_kinds(s, d))


def own_kinds_swept(s, d) -> DataFrame:
    return inj.sweep(tb.session_cases(s, d), tb.words(s, d), 2, ["Insert", "Swap", "Append"])


@query
def own_kinds(s, d):
    """A sweep of two registered types beside one of the library's, with texts and causes."""
    l = F.col("label")
    with ks.registered(tb.SWAP, tb.APPEND):
        told = own_kinds_swept(s, d).withColumns({"label_text": lb.label_text(l), "cause": lb.cause(l, F.col("trace"))})
        return told.select(
            "case_id", "kind", "round", joined("trace").alias("trace"), l["anomaly"].alias("anomaly"), l["size"].alias("size"),
            l["start"].alias("start"), ints(l["indices"]).alias("indices"), joined(l["acts"]).alias("acts"),
            "label_text", "cause",
        )


@query
def own_targets(s, d):
    with ks.registered(tb.SWAP, tb.APPEND):
        return lb.targets(own_kinds_swept(s, d))


@query
def descriptors(s, d):
    """How often each type changed a case, beside the type's descriptor."""
    known = F.create_map(*[F.lit(x) for k in [*inj.SWEEP, *inj.FURTHER] for x in (k, json.dumps(inj.descriptor(k)))])
    changed = all_kinds(s, d).where(F.col("label.anomaly") != "normal").groupBy("kind").agg(F.count("*").alias("num_cases"))
    return changed.withColumn("distance", F.get_json_object(known[F.col("kind")], "$.parameters.distance").cast("int")).withColumn(
        "named", F.get_json_object(known[F.col("kind")], "$.anomaly"))


@query
def label_text(s, d):
    return all_kinds(s, d).select("case_id", "kind", lb.label_text(F.col("label")).alias("label_text"))


# --- datasets ------------------------------------------------------------------------------

@query
def cause(s, d):
    return inj.sweep(tb.model_cases(s, d), tb.words(s, d), 2).where(F.col("label.anomaly") != "normal").select(
        "case_id", "kind", "round", lb.cause(F.col("label"), F.col("trace")).alias("cause")
    )


@query
def model_split(s, d):
    rows = lg.cases(tb.session_log(s, d), "user_id").select(F.col("user_id").alias("model_id"), "case_id")
    train, test = ds.split_models(rows, TEST_MODELS)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def swept_side(s, d, side: int) -> tuple[DataFrame, DataFrame]:
    """The sweep over the training (0) or the test models (1), and their cases; only these are injected."""
    log = settle(ds.split_models(settle(tb.model_cases(s, d)), TEST_MODELS)[side])
    return tb.swept_sessions(s, d, log), log


@query
def train_set(s, d):
    return ds.training_set(*swept_side(s, d, 0))


def test_rows(s, d) -> DataFrame:
    return ds.test_rows(*swept_side(s, d, 1))


@query
def test_set(s, d):
    return ds.detection_test(test_rows(s, d)).drop("row_id")


@query
def test_cause(s, d):
    return ds.cause_test(test_rows(s, d)).drop("row_id")


@query
def prompts(s, d):
    return ds.prompts(test_rows(s, d))


@query
def shuffle(s, d):
    return ds.shuffled(test_rows(s, d)).select("row_id", "rank")


@query
def first_rows(s, d):
    return ds.first_rows(test_rows(s, d).select("row_id", "trace", "label"), FIRST_ROWS)


def answers(s, d) -> DataFrame:
    return tb.responses(test_rows(s, d))


@query
def followup(s, d):
    said = answers(s, d).select("row_id", "trace", me.verdict(F.col("response")).alias("verdict"))
    asked = said.select("row_id", F.lit("first").alias("turn"), ds.fixed_question(F.col("trace")).alias("prompt"))
    return asked.unionByName(ds.follow_up(said).withColumn("turn", F.lit("second")))


# --- responses and metrics -----------------------------------------------------------------

@query
def parse_verdict(s, d):
    said = me.verdict(F.col("response"))
    return answers(s, d).select("row_id", said.alias("said"), me.valid_verdict(said).alias("verdict"))


@query
def parse_cause(s, d):
    return answers(s, d).where("label = 'anomalous'").select("row_id", me.stated_cause(F.col("cause_response")).alias("stated"))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def binary_metrics(s, d):
    rows = answers(s, d).select("label", me.valid_verdict(me.verdict(F.col("response"))).alias("verdict"))
    return rounded(me.binary_metrics(rows))


@query
def weighted_metrics(s, d):
    r = run(s, d)
    kinds = r.verdicts.withColumn("dataset", F.pmod(F.col("n"), F.lit(3)))
    return rounded(me.weighted_metrics(me.case_outcomes(kinds, "dataset"), "dataset"))


@query
def roc_auc(s, d):
    rows = run(s, d).verdicts.withColumn("dataset", F.pmod(F.col("n"), F.lit(3)))
    return rounded(me.roc_auc(rows, ["dataset"], score_slot))


@query
def f1_prefix(s, d):
    return rounded(run(s, d).f1_by_prefix())


@query
def f1_type(s, d):
    return rounded(run(s, d).f1_by_type())


@query
def metrics_long(s, d):
    wide = rounded(run(s, d).metrics("sessions"))
    return me.long_metrics(wide.drop("unscored"), ["dataset", "encoding"])


def quality_curve(s, d) -> DataFrame:
    rows = tb.table(s, d, "labels").join(tb.table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return me.precision_recall(rows, ["lang"], lambda c: F.floor(c / 256), "quality", "n_chars")


@query
def best_prf(s, d):
    return rounded(me.best_f1(quality_curve(s, d), ["lang"]))


@query
def aupr(s, d):
    return rounded(me.average_precision(quality_curve(s, d), ["lang"]))


def cause_pairs(s, d) -> DataFrame:
    return answers(s, d).where("label = 'anomalous'").select("row_id", me.stated_cause(F.col("cause_response")).alias("hyp"), F.col("cause").alias("ref"))


@query
def rouge2(s, d):
    return rounded(me.mean_scores(cause_pairs(s, d), me.rouge_2(F.col("hyp"), F.col("ref")), "rouge2"), 6)


@query
def rougeL(s, d):
    return rounded(me.mean_scores(cause_pairs(s, d), me.rouge_l(F.col("hyp"), F.col("ref")), "rougeL"), 6)


# --- process models ------------------------------------------------------------------------

@query
def elements(s, d):
    out = mo.model_elements(tb.model_documents(s, d), parse_parent=True, parse_outgoing=True)
    return out.withColumn("outgoing", joined("outgoing"))


@query
def drop_examples(s, d):
    return mo.drop_example_models(tb.order_elements(s, d), EXAMPLE_TYPES).select("model_id", "element_id", "name")


@query
def drop_example_rows(s, d):
    return mo.drop_example_rows(tb.order_elements(s, d), EXAMPLE_TYPES).groupBy("name").agg(F.count("*").alias("num_rows"))


@query
def topn_notation(s, d):
    return mo.filter_notation(tb.notations(s, d), TOP_NOTATIONS)


@query
def fold_other(s, d):
    return mo.filter_notation(tb.notations(s, d), "max", RARE_BELOW)


@query
def filter_models(s, d):
    return mo.filter_data(tb.order_elements(s, d), "models", 4).select("model_id", "element_id", "category")


@query
def model_text(s, d):
    return mo.model_text(tb.order_elements(s, d)).withColumn("label", tx.clean_breaks(F.col("label")))


@query
def labels_norm(s, d):
    labels = tb.part_labels(s, d).where(F.col("label").isNotNull())
    return labels.select(tx.sanitize_label(F.col("label")).alias("norm")).groupBy("norm").agg(F.count("*").alias("num"))


@query
def label_words(s, d):
    docs = tb.table(s, d, "documents").select(F.explode(tx.label_words(F.col("text"))).alias("word"))
    return docs.groupBy("word").agg(F.count("*").alias("num"))


@query
def relevant(s, d):
    labels = tb.part_labels(s, d)
    return labels.select(
        "p_partkey", tx.is_relevant_label(F.col("label")).cast("int").alias("relevant"),
        tx.collapse_blanks(F.col("label")).alias("label"),
    )


@query
def meaningful(s, d):
    return mo.meaningful_models(tb.order_elements(s, d), 5.0).select("model_id", F.round("mean_length", 9).alias("mean_length"))


@query
def edges(s, d):
    return mo.model_graph(tb.model_documents(s, d).drop("name"))[1]


@query
def nodes(s, d):
    return mo.model_graph(tb.model_documents(s, d).drop("name"))[0].withColumn("is_task", F.col("is_task").cast("int"))


@query
def succ(s, d):
    return g.once(g.successors, *tb.order_graph(s, d))


@query
def pred(s, d):
    return g.once(g.predecessors, *tb.order_graph(s, d))


@query
def sources_sinks(s, d):
    def ends(*graph):
        return g.sources(*graph).withColumn("side", F.lit("source")).unionByName(g.sinks(*graph).withColumn("side", F.lit("sink")))

    return g.once(ends, *tb.order_graph(s, d))


@query
def reach(s, d):
    return g.once(lambda *graph: g.reachable(g.successors(*graph)), *tb.order_graph(s, d))


def order_paths(s, d) -> tuple[DataFrame, DataFrame]:
    nodes_, edges_ = tb.order_graph(s, d)
    return g.once(g.simple_paths, nodes_, edges_), nodes_


@query
def paths(s, d):
    return order_paths(s, d)[0].select("model_id", joined("path", ">").alias("path"))


@query
def task_paths(s, d):
    return g.task_paths(*order_paths(s, d)).select("model_id", joined("tasks", ">").alias("tasks"))


@query
def node_kind(s, d):
    nodes_, _ = tb.order_graph(s, d)
    label = F.col("label")
    return nodes_.select(
        "model_id", "id", g.node_kind(label).alias("kind"), g.is_choice(label).cast("int").alias("choice"),
        g.is_relevant(label).cast("int").alias("relevant"),
    )


@query
def implicit_joins(s, d):
    nodes_, edges_ = tb.order_graph(s, d)
    return g.once(g.implicit_joins, nodes_, edges_, g.kind_look(nodes_["label"]))


@query
def branches_graph(s, d):
    return g.exclusive_branches(*tb.order_graph(s, d))
