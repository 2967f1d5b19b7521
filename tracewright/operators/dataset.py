"""Training and test tables of labelled traces, and their prompts.

Input is the injected sweep with a ``model_id`` (the process a case belongs to).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_below, order_hash, sized_text
from ..functions.ordering import hash_cut, hash_slot, numbered
from .labels import cause
from .log import trace_text


def bracketed(trace: Column) -> Column:
    return F.concat(F.lit("["), trace_text(trace), F.lit("]"))


def split_models(rows: DataFrame, test_models: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the training models and of the last ``test_models`` models in hash order."""
    hashed = rows.withColumn("_h", order_hash("model", F.col("model_id")))
    models = hashed.select("model_id", "_h").distinct()
    cut = hash_cut(models, "_h", lambda n: n - test_models).select("cut").scalar()
    in_train = F.coalesce(F.col("_h") <= cut, F.lit(False))
    return hashed.where(in_train).drop("_h"), hashed.where(~in_train).drop("_h")


def normal_traces(injected: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Distinct normal traces per model.

    Injections that changed nothing count as normal. Those have the trace of their case, so the ``cases`` that were
    injected tell the normal traces without a look at the injected rows.
    """
    normal = injected.where(F.col("label.anomaly") == "normal") if cases is None else cases
    return normal.select("model_id", "trace").distinct()


def anomalous_traces(injected: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Anomalous rows whose trace is not a normal trace of the same model."""
    bad = injected.where(F.col("label.anomaly") != "normal")
    return bad.join(normal_traces(injected, cases), ["model_id", "trace"], "left_anti")


def training_set(injected: DataFrame, cases: DataFrame | None = None, times: int = 2, types: int = 5) -> DataFrame:
    """Each normal trace ``times * types`` times; each anomalous trace with and without its cause."""
    normal = normal_traces(injected, cases).select(
        "model_id", bracketed(F.col("trace")).alias("trace"), F.lit("normal").alias("label"), F.lit("").alias("cause"),
        F.explode(F.sequence(F.lit(1), F.lit(times * types))).alias("copy"),
    ).drop("copy")
    bad = anomalous_traces(injected, cases).withColumn("said", cause(F.col("label"), F.col("trace"))).select(
        "model_id", bracketed(F.col("trace")).alias("trace"), F.lit("anomalous").alias("label"),
        F.explode(F.array("said", F.lit(""))).alias("cause"),
    )
    return normal.unionByName(bad)


def test_rows(injected: DataFrame, cases: DataFrame | None = None, times: int = 2, types: int = 5) -> DataFrame:
    """Normal traces and a share of 1 / (times * types) of the anomalous ones, with the full cause."""
    normal = normal_traces(injected, cases).select(
        "model_id",
        F.concat_ws("/", F.col("model_id"), F.lit("normal"), order_hash("trace", sized_text(F.col("trace")))).alias("row_id"),
        bracketed(F.col("trace")).alias("trace"), F.lit("normal").alias("label"),
        F.lit("").alias("raw_cause"), F.lit("").alias("cause"),
    )
    who = [F.col("case_id"), F.col("kind"), F.col("round")]
    bad = (
        anomalous_traces(injected, cases)
        .where(draw_below(times * types, *who, "test") == 0)
        .withColumn("said", cause(F.col("label"), F.col("trace")))
        .select(
            "model_id", F.concat_ws("/", *who).alias("row_id"), bracketed(F.col("trace")).alias("trace"),
            F.lit("anomalous").alias("label"), F.col("label.anomaly").alias("raw_cause"),
            F.col("said").alias("cause"),
        )
    )
    return normal.unionByName(bad)


def detection_test(rows: DataFrame) -> DataFrame:
    """The test rows for the verdict, without causes."""
    return rows.withColumn("cause", F.lit(""))


def cause_test(rows: DataFrame) -> DataFrame:
    """The anomalous test rows with their causes."""
    return rows.where(F.col("label") == "anomalous")


# Phrases of a prompt.
OPENINGS = [
    "In the following business process trace, ",
    "In the subsequent business process trace, ",
    "In the forthcoming business process trace, ",
    "In the ensuing business process trace, ",
    "Below is a business process trace, ",
    "Below is a trace of a business process, ",
    "Here is a trace of a business process, ",
]
SEPARATED_BY = [
    "each executed activity is separated by a comma:",
    "each performed activity is delimited by a comma:",
    "each activity that has been executed is delineated by a comma:",
    "each completed activity is demarcated by a comma:",
    "with each executed activity separated by a comma:",
    "with each completed activity separated by a comma:",
    "with each performed activity separated by a comma:",
]
ASK_CAUSE = [
    "What's the cause of the anomaly?",
    "What's the root cause of the anomaly?",
    "What's the root reason of the anomaly?",
    "What's the reason of the anomaly?",
    "What's the underlying cause of the anomaly?",
    "What's the reason behind this trace being anomalous?",
    "What's the reason behind this anomalous trace?",
    "What's the origin of the anomaly?",
    "What's the underlying reason for the anomaly?",
    "What's the primary factor behind the anomaly?",
    "What's the main explanation for the anomaly?",
    "What's the core issue leading to the anomaly?",
    "What causes this trace anomalous?",
    "What triggers the anomaly?",
    "What leads to the anomaly?",
    "What makes this trace anomalous?",
    "What causes this trace to deviate?",
    "What brings about this trace's anomaly?",
    "What accounts for this trace's anomaly?",
    "What attributes to the trace's anomaly?",
    "Why is this an anomalous trace?",
]

# Prompt texts. The backslash and n are two characters of the text.
QUESTION = "%s%s %s. Is this trace normal or anomalous?"
ANSWER = " \\n The trace is %s."
CAUSE_QUESTION = " \\n %s"
CAUSE_ANSWER = " \\n %s"
STOP = "</s>"
FIXED_QUESTION = (
    "In the following business process trace, each executed activity is separated by a comma: %s. \\n "
    "Is this trace normal or anomalous?"
)
FOLLOW_UP = (
    "In the following business process trace, each executed activity is separated by a comma: %s. "
    "Is this trace normal or anomalous? \\n The trace is anomalous. \\n What makes this trace anomalous?"
)


def _phrase(phrases: list[str], *keys) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in phrases]), draw_below(len(phrases), *keys) + 1)


def prompts(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """``prompt``, the text up to the asked answer, and ``prompt_all`` with the answer.

    Rows with a cause are asked for the cause, rows without one for the verdict.
    """
    k = F.col(key)
    question = F.format_string(
        QUESTION, _phrase(OPENINGS, k, "opening"), _phrase(SEPARATED_BY, k, "separated"), F.col("trace")
    )
    answer = F.format_string(ANSWER, F.col("label"))
    ask = F.format_string(CAUSE_QUESTION, _phrase(ASK_CAUSE, k, "ask"))
    has_cause = F.coalesce(F.col("cause") != "", F.lit(False))
    return rows.select(
        key,
        F.when(has_cause, F.concat(question, answer, ask)).otherwise(question).alias("prompt"),
        F.when(has_cause, F.concat(question, answer, ask, F.format_string(CAUSE_ANSWER, F.col("cause")), F.lit(STOP)))
        .otherwise(F.concat(question, answer, F.lit(STOP))).alias("prompt_all"),
    )


def fixed_question(trace: Column) -> Column:
    return F.format_string(FIXED_QUESTION, trace)


def follow_up(verdicts: DataFrame) -> DataFrame:
    """Second prompt for the traces judged anomalous; ``verdicts`` holds (row_id, trace, verdict)."""
    return verdicts.where(F.col("verdict") == "anomalous").select(
        "row_id", F.format_string(FOLLOW_UP, F.col("trace")).alias("prompt")
    )


def shuffled(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows with ``rank``, their place in a random but repeatable order."""
    hashed = rows.withColumn("_h", order_hash("shuffle", F.col(key)))
    return numbered(hashed, [], hash_slot(F.col("_h")), ["_h"], "rank").drop("_h")


def first_rows(rows: DataFrame, size: int | None, key: str = "row_id") -> DataFrame:
    """The first ``size`` rows by key; all rows when no size is given."""
    return rows if size is None else rows.orderBy(key).limit(size)
