"""Train/test split of cases, prefixes and their encodings.

A labelled log is CASES with ``flags array<int>``, one anomaly flag per event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_below, order_hash
from ..functions.ordering import hash_cut
from ..session import settle


def flagged_cases(events: DataFrame, *keep: str) -> DataFrame:
    """Labelled CASES of EVENTS that carry ``is_anomaly`` per event."""
    steps = F.sort_array(F.collect_list(F.struct("pos", "activity", "is_anomaly")))
    return (
        events.groupBy("case_id", *keep).agg(steps.alias("s"))
        .select("case_id", *keep, F.size("s").alias("n"), F.col("s.activity").alias("trace"),
                F.col("s.is_anomaly").alias("flags"))
    )


def split(labelled: DataFrame, ratio: float = 0.8, run: int | Column = 1, keys=()) -> tuple[DataFrame, DataFrame]:
    """Train and test cases.

    A case with any normal event counts as normal; ``floor(ratio * n)`` of the n normal cases,
    the first in hash order, are the training cases and keep only their normal events. All
    other cases are the test cases. ``run`` draws another split. The share is cut at one hash value, so neither side is
    joined or ranked. ``keys``: columns of the logs and runs in the table, each split for itself (with ``run`` one of them);
    then rows are joined with the table of their cuts, which has a row for each.
    """
    rows = labelled.withColumn("_h", F.when(F.array_contains("flags", 0), order_hash("split", run, F.col("case_id"))))
    hashed, share = rows.where(F.col("_h").isNotNull()), lambda n: F.floor(n.cast("double") * ratio)
    if keys:
        rows = rows.join(settle(hash_cut(hashed, "_h", share, list(keys)).drop("n"), "cuts"), list(keys), "left")
        within = F.col("_h") <= F.col("cut")
    else:
        within = F.col("_h") <= hash_cut(hashed, "_h", share).select("cut").scalar()
    rows = rows.withColumn("_in", F.coalesce(within, F.lit(False)))
    train = rows.where("_in").drop("_h", "_in", "cut")
    train = (
        train.withColumn("trace", F.filter("trace", lambda x, i: F.get("flags", i) == 0))
        .withColumn("flags", F.filter("flags", lambda f: f == 0))
        .withColumn("n", F.size("trace"))
    )
    return train, rows.where(~F.col("_in")).drop("_h", "_in", "cut")


def prefixes(labelled: DataFrame, max_prefix_len: int | None = None) -> DataFrame:
    """All prefixes of each case, labelled by the flag of their last event."""
    last = F.col("n") if max_prefix_len is None else F.least(F.col("n"), F.lit(max_prefix_len))
    return labelled.where(F.col("n") > 0).select(
        "case_id", "trace", "flags", F.explode(F.sequence(F.lit(1), last)).alias("prefix_len")
    ).select(
        "case_id",
        "prefix_len",
        F.slice("trace", 1, F.col("prefix_len")).alias("prefix"),
        F.element_at("flags", F.col("prefix_len")).alias("label"),
    )


def prefix_dims(labelled: DataFrame, event_size: Column, keys=()) -> DataFrame:
    """Samples per prefix length and the least, greatest and mean vector size.

    Lengths are counted before they are spread over the shorter prefixes. With ``keys`` the size of an event may be a
    function of these.
    """
    return (
        labelled.groupBy(*keys, "n").agg(F.count("*").alias("c")).where(F.col("n") > 0)
        .select(*keys, "c", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("prefix_len"))
        .groupBy(*keys, "prefix_len").agg(F.sum("c").alias("num_samples"))
        .withColumn("dim", event_size * F.col("prefix_len"))
        .groupBy(*keys, "prefix_len")
        .agg(F.max("num_samples").alias("num_samples"), F.min("dim").alias("min_dim"), F.max("dim").alias("max_dim"),
             F.avg("dim").alias("avg_dim"))
    )


def onehot(labelled: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Sparse one-hot rows (case, position, index); an unknown activity has no index."""
    steps = labelled.select("case_id", F.posexplode("trace").alias("p", "activity"))
    return steps.join(settle(vocabulary), "activity", "left").select(
        "case_id", (F.col("p") + 1).alias("pos"), "activity", "idx"
    )


def pad(vector: Column, size: Column) -> Column:
    """Vector filled up with zeros to ``size``; an error if it is longer."""
    return F.when(
        F.size(vector) <= size, F.concat(vector, F.array_repeat(F.lit(0.0), size - F.size(vector)))
    ).otherwise(F.raise_error(F.concat(F.lit("vector longer than "), size.cast("string"))))


def word_vectors(cases: DataFrame, vector_size: int = 32, window: int = 5) -> DataFrame:
    """(activity, vec): activity embeddings from what stands near them, of length 1 (or 0, with no neighbour).

    Every activity within ``window`` places adds plus or minus one to an entry that its hash tells: a random projection
    of the counts. Sums of whole numbers don't depend on their order, so the vectors are the same on every cluster,
    and nothing is gathered in one place.
    """
    steps = cases.select("trace", F.posexplode("trace").alias("p", "activity"))
    first = F.greatest(F.col("p") - window, F.lit(0))
    near = F.concat(F.slice("trace", first + 1, F.col("p") - first), F.slice("trace", F.col("p") + 2, window))
    pairs = steps.select("activity", F.explode_outer(near).alias("near")).groupBy("activity", "near").agg(F.count("*").alias("c"))
    sign = 1 - 2 * draw_below(2, "sign", F.col("near"))
    entries = (
        pairs.select("activity", F.when(F.col("near").isNotNull(), draw_below(vector_size, "entry", F.col("near"))).alias("i"), (sign * F.col("c")).alias("c"))
        .groupBy("activity", "i").agg(F.sum("c").alias("c"))
    )
    by_entry = F.map_from_entries(F.filter(F.collect_list(F.struct("i", "c")), lambda e: e["i"].isNotNull()))
    whole = entries.groupBy("activity").agg(by_entry.alias("m"), F.sum(F.when(F.col("i").isNotNull(), F.col("c") * F.col("c")).otherwise(0)).alias("s"))
    value = lambda i: F.coalesce(F.col("m")[i], F.lit(0))
    norm = F.sqrt(F.greatest(F.col("s"), F.lit(1)).cast("double"))
    return whole.select("activity", F.transform(F.sequence(F.lit(0), F.lit(vector_size - 1)), lambda i: F.round(value(i) / norm, 9)).alias("vec"))


def embed(cases: DataFrame, vectors: DataFrame, vector_size: int = 32) -> DataFrame:
    """Concatenated activity vectors per case; unknown activities are zero vectors."""
    zero = F.array_repeat(F.lit(0.0), vector_size)
    steps = cases.select("case_id", F.posexplode("trace").alias("p", "activity"))
    return (
        steps.join(settle(vectors), "activity", "left")
        .select("case_id", F.struct("p", F.coalesce("vec", zero).alias("v")).alias("s"))
        .groupBy("case_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
        .select("case_id", F.flatten("s.v").alias("vector"))
    )
