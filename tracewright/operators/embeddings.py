"""Activity embeddings learnt from what stands near them: factors of the table of positive pointwise mutual information.

The table is symmetric and sparse, one row for each pair of activities that stand near each other. Its leading eigenvectors
come from block power iteration: each round is one join of the pairs with the current block (a row per activity) and one
aggregation, written as a table of its own. Only tables of (size + EXTRA)^2 numbers reach the driver, whatever the vocabulary.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_below
from ..session import settle

# Executors need not have this package on their path: the functions below travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns of the block beyond those asked for; they make the last ones converge.
EXTRA = 8

#: Directions with less than this share of the greatest are rounding, not data.
RANK = 1e-11


def near_pairs(cases: DataFrame, window: int = 5) -> DataFrame:
    """(activity, near, c): how often an activity stands within ``window`` places of another event. Nulls are passed over."""
    steps = cases.select("trace", F.posexplode("trace").alias("p", "activity"))
    first = F.greatest(F.col("p") - window, F.lit(0))
    near = F.concat(F.slice("trace", first + 1, F.col("p") - first), F.slice("trace", F.col("p") + 2, window))
    pairs = steps.select("activity", F.explode(near).alias("near")).where("activity is not null and near is not null")
    return pairs.groupBy("activity", "near").agg(F.count("*").alias("c"))


def mutual_information(cases: DataFrame, window: int = 5) -> DataFrame:
    """(activity, near, value): the positive pointwise mutual information of activities that stand near each other.

    value = ln(c * total / (sum of the activity * sum of the other)); pairs of no more than chance have no row.
    """
    pairs = settle(near_pairs(cases, window), "pairs")
    sums = pairs.groupBy("activity").agg(F.sum("c").alias("s"))
    total = pairs.agg(F.sum("c").cast("double")).scalar()
    other = sums.select(F.col("activity").alias("near"), F.col("s").alias("s_near"))
    value = F.ln(F.col("c").cast("double") * total / (F.col("s").cast("double") * F.col("s_near").cast("double")))
    return pairs.join(sums, "activity").join(other, "near").select("activity", "near", value.alias("value")).where("value > 0")


def gram(left: DataFrame, a: str, b: str, width: int) -> np.ndarray:
    """The (width, width) sum over rows of the outer product of two array columns, summed in tasks first."""

    def partial(frames):
        total = np.zeros((width, width))
        for pdf in frames:
            if len(pdf):
                total += np.stack(pdf["a"].to_numpy()).T @ np.stack(pdf["b"].to_numpy())
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    parts = left.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInPandas(partial, "i long, j long, v double")
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # at most width^2 rows
        out[r.i, r.j] = r.v
    return out


def turned(name: str, by: np.ndarray) -> Column:
    """An array column times a small matrix."""
    columns = [F.array(*[F.lit(float(x)) for x in c]) for c in by.T]
    dot = lambda c: F.aggregate(F.zip_with(name, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.array(*[dot(c) for c in columns])


def upright(g: np.ndarray) -> np.ndarray:
    """The matrix that makes a block with the inner products ``g`` orthonormal; directions without weight go."""
    values, u = np.linalg.eigh((g + g.T) / 2)
    keep = values > max(values.max(initial=0.0), 0.0) * RANK
    return u[:, keep] / np.sqrt(values[keep])


def factors(table: DataFrame, size: int = 32, rounds: int = 8) -> tuple[DataFrame, np.ndarray]:
    """The leading eigenvectors of a symmetric table (activity, near, value), as (activity, u), and their eigenvalues.

    Eigenvalues come by falling magnitude, ``size`` at most; ``u`` has an entry for each. With no more activities than
    ``size`` + EXTRA all is exact after the first round. An empty table gives no row and no value.
    """
    table = settle(table, "table")
    width = size + EXTRA
    names = table.select("activity").distinct()
    start = F.array(*[(1 - 2 * draw_below(2, "start", F.lit(i), F.col("activity"))).cast("double") for i in range(width)])
    block = settle(names.select("activity", start.alias("q")), "block")

    def times(block: DataFrame, width: int) -> DataFrame:
        reached = table.join(block.withColumnRenamed("activity", "near"), "near")
        sums = [F.sum(F.col("value") * F.col("q")[i]) for i in range(width)]
        return reached.groupBy("activity").agg(F.array(*sums).alias("y"))

    def orthonormal(df: DataFrame, name: str, width: int) -> tuple[DataFrame, int]:
        # Twice: the first time leaves what rounding makes of nearly equal directions.
        for _ in range(2):
            by = upright(gram(df, name, name, width))
            width = by.shape[1]
            if not width:
                return df.select("activity", F.array().cast("array<double>").alias("q")), 0
            df, name = settle(df.select("activity", turned(name, by).alias("q")), "block"), "q"
        return df, width

    block, width = orthonormal(block, "q", width)
    for _ in range(rounds if width == size + EXTRA else 1):
        if not width:
            break
        block, width = orthonormal(settle(times(block, width), "times"), "y", width)
    if not width:
        return block.select("activity", F.col("q").alias("u")), np.zeros(0)
    both = settle(block.join(times(block, width), "activity"), "times")
    inner = gram(both, "q", "y", width)
    values, u = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:size]
    values, u = values[order], u[:, order]
    # An eigenvector may stand either way; this one is the same on every run.
    u = u * np.where(u.sum(0) < 0, -1.0, 1.0)
    return settle(block.select("activity", turned("q", u).alias("u")), "factors"), values


def learnt_vectors(cases: DataFrame, vector_size: int = 32, window: int = 5, rounds: int = 8) -> DataFrame:
    """(activity, vec): eigenvectors of the mutual information, weighed by the root of the eigenvalues' magnitude, length 1.

    Activities that often share neighbours have a large cosine. Every activity of ``cases`` has a row; one without a
    neighbour, or with no more than chance gives, has zeros. Fewer directions than ``vector_size`` are filled up with zeros.
    """
    found, values = factors(mutual_information(cases, window), vector_size, rounds)
    weights = F.array(*[F.lit(float(np.sqrt(abs(v)))) for v in values]).cast("array<double>")
    raw = F.zip_with("u", weights, lambda x, w: x * w)
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    rest = F.array_repeat(F.lit(0.0), vector_size - len(values))
    shown = F.transform("raw", lambda x: F.round(F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0), 9))
    vectors = found.select("activity", raw.alias("raw")).withColumn("norm", norm).select("activity", F.concat(shown, rest).alias("vec"))
    every = cases.select(F.explode("trace").alias("activity")).where("activity is not null").distinct()
    return every.join(vectors, "activity", "left").select("activity", F.coalesce("vec", F.array_repeat(F.lit(0.0), vector_size)).alias("vec"))
