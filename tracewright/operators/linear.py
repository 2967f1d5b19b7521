"""Linear denoising reconstruction of prefixes.

Training a linear autoencoder on inputs with Gaussian noise of variance s^2 is ridge regression
of X on itself (Bishop 1995; Chen et al. 2012): W = (X'X + n s^2 I)^-1 X'X. With R = I - W and
G = R'R the squared error of a prefix x is x'Gx.

One model serves every prefix length and vocabulary. A prefix has (places * event size) features; they are
folded into ``WIDTH`` ones: feature f goes to f mod WIDTH, with a sign that is a hash of f div WIDTH (plus for
0). Where nothing folds this is the exact model; beyond, it is the usual feature hashing, whose inner products
are right on average.

With a ``bottleneck`` of r directions W is the best such W of rank r (reduced-rank regression): X'X = V diag(l) V', so
W = V_r diag(l / (l + n s^2)) V_r' with the r greatest l; those equal to the last of them stay too, so that no choice is left
to rounding. With as many directions as features this is the model above.

X'X is summed in tasks that hold one WIDTH x WIDTH table, then by Spark; a solve takes one such table; scores are
computed in groups of prefixes beside the G of their length.
"""

from __future__ import annotations

import hashlib
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .detect import samples

# Executors need not have this package on their path: the functions below travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 1024

# Eigenvalues closer than this share of the greatest are taken as equal.
TIED = 1e-9

# Prefixes that are summed or scored by one task at a time, and numbers that their events make at most (a longer prefix is alone).
GROUP = 20_000
VALUES = 1 << 23

# Numbers that are folded at a time.
PIECE = 1 << 20


def signs(folds: int) -> np.ndarray:
    """Plus or minus one for each multiple of the width."""
    return np.array([1.0] + [1.0 - 2.0 * (hashlib.md5(f"fold|{q}".encode()).digest()[0] & 1) for q in range(1, folds)])


def vectors_of(x: np.ndarray, size: int, width: int) -> np.ndarray:
    """Folded vectors of prefixes of one length: ``x`` has one row of (place * event size) values per prefix, or one
    row of vocabulary indexes (-1: unknown, a zero vector) with ``size`` values per event."""
    n, places = x.shape[0], x.shape[1]
    d, sign = min(places * size, width), signs(places * size // width + 1)
    out = np.zeros((n, d))
    if x.ndim == 2:
        feature = np.arange(places) * size + x
        row, place = np.nonzero(x >= 0)
        feature = feature[row, place]
        np.add.at(out, (row, feature % width), sign[feature // width])
    else:
        flat = x.reshape(n, places * size)
        for q, first in enumerate(range(0, places * size, width)):
            part = flat[:, first : first + width]
            out[:, : part.shape[1]] += part * sign[q]
    return out


def stacked(values) -> np.ndarray:
    """Rows of one length as an array of two or three dimensions."""
    return np.array([[np.asarray(e) for e in v] for v in values])


def pieces(values: pd.Series, size: int, width: int):
    """(slice, folded vectors) of the prefixes of one length, some at a time: memory follows PIECE, not the group."""
    step = max(1, PIECE // max(1, min(width, len(values.iloc[0]) * size), np.size(values.iloc[0][0]) * len(values.iloc[0])))
    for start in range(0, len(values), step):
        own = slice(start, start + step)
        yield own, vectors_of(stacked(values.iloc[own]), size, width)


def moments(pdf: pd.DataFrame, size: int, width: int) -> pd.DataFrame:
    """Upper entries of X'X of one group of weighted prefixes of one length."""
    w, total = pdf["w"].to_numpy(), 0.0
    for own, x in pieces(pdf["x"], size, width):
        total = total + (x * w[own, None]).T @ x
    total = np.triu(total)
    i, j = np.nonzero(total)
    return pd.DataFrame({"prefix_len": pdf["prefix_len"].iloc[0], "i": i, "j": j, "c": total[i, j]})


def narrowed(m: np.ndarray, ridge: float, bottleneck: int) -> tuple[np.ndarray, float]:
    """The best W of rank ``bottleneck`` (more where eigenvalues tie), and the largest residual of the eigenvectors."""
    values, v = np.linalg.eigh(m)
    residual = np.abs(m @ v - v * values).max()
    values = np.maximum(values, 0)
    last = np.sort(values)[::-1][min(bottleneck, len(values)) - 1]
    keep = values >= last - TIED * values.max(initial=0.0)
    v, share = v[:, keep], values[keep] / (values[keep] + ridge)
    return (v * share) @ v.T, residual


def solve(entries: pd.DataFrame, size: int, width: int, factor: float, bottleneck: int | None = None) -> pd.DataFrame:
    """Rows of G of one length, with the largest residual of the solved equations as a share of n."""
    k, n = int(entries["prefix_len"].iloc[0]), float(entries["n_fit"].iloc[0])
    d = min(k * size, width)
    m = np.zeros((d, d))
    m[entries["i"], entries["j"]] = entries["c"]
    m = m + np.triu(m, 1).T
    sigma = min(factor, 0.3 / max(1.0, k / 3))
    left = m + n * sigma**2 * np.eye(d)
    if bottleneck is None:
        w = np.linalg.solve(left, m)
        residual = np.abs(left @ w - m).max()
    else:
        w, residual = narrowed(m, n * sigma**2, bottleneck)
    r = np.eye(d) - w
    return pd.DataFrame({"prefix_len": k, "dim": d, "i": np.arange(d), "g": list(r.T @ r), "residual": residual / n})


def errors(rows: pd.DataFrame, form: pd.DataFrame, size: int, width: int) -> pd.DataFrame:
    """Mean squared reconstruction errors of prefixes of one length, 9 digits."""
    if not len(rows) or not len(form):
        return pd.DataFrame({"tid": [], "prefix_len": [], "score": []})
    g = np.stack(form.sort_values("i")["g"].to_numpy())
    e = np.concatenate([np.maximum(((x @ g) * x).sum(1), 0) / g.shape[0] for _, x in pieces(rows["x"], size, width)])
    return pd.DataFrame({"tid": rows["tid"], "prefix_len": rows["prefix_len"], "score": np.round(e, 9)})


def coded(rows: DataFrame, key: list[str], codes: DataFrame, unknown) -> DataFrame:
    """(key, x): the traces with each activity replaced by its code (activity, code)."""
    steps = rows.select(*key, F.posexplode("trace").alias("p", "activity"))
    return (
        steps.join(codes, "activity", "left")
        .groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("p", F.coalesce("code", unknown).alias("code")))).alias("s"))
        .select(*key, F.col("s.code").alias("x"))
    )


@dataclass
class LinearModel:
    form: DataFrame  # prefix_len, dim, i, g: rows of G; residual
    codes: DataFrame  # activity, code
    unknown: object  # code of an activity that isn't known
    size: int  # values per event
    encoding: str
    width: int = WIDTH

    def score(self, variants: DataFrame) -> DataFrame:
        """(tid, prefix_len, score) for every prefix whose length has a model."""
        size, width = self.size, self.width
        lengths = self.form.select("prefix_len").distinct()
        prefix = (
            coded(variants, ["tid"], self.codes, self.unknown)
            .select("tid", "x", F.explode(F.sequence(F.lit(1), F.size("x"))).alias("prefix_len")).join(lengths, "prefix_len")
            .select("tid", "prefix_len", F.slice("x", 1, F.col("prefix_len")).alias("x"))
        )
        salts = salted(variants.where("n > 0").select("n"), size if self.encoding == "word2vec" else 1)
        prefix = prefix.join(salts, "prefix_len").withColumn("salt", F.pmod(F.xxhash64("tid"), F.col("salts"))).drop("salts")
        form = self.form.join(salts, "prefix_len").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        keys = ["prefix_len", "salt"]
        return prefix.groupBy(*keys).cogroup(form.select(*keys, "i", "g").groupBy(*keys)).applyInPandas(
            lambda rows, model: errors(rows, model, size, width), "tid string, prefix_len int, score double"
        )

    def score_whole(self, variants: DataFrame) -> DataFrame:
        """The same for the whole traces only."""
        whole = variants.select("tid", F.col("n").alias("prefix_len"))
        return self.score(variants).join(whole, ["tid", "prefix_len"], "left_semi")


def salted(lengths: DataFrame, numbers: int = 1) -> DataFrame:
    """(prefix_len, salts): how many groups of about GROUP rows, or of VALUES numbers, the prefixes of each length make.

    ``lengths``: n. ``numbers``: how many an event has.
    """
    counts = lengths.groupBy("n").agg(F.count("*").alias("c")).select("c", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("prefix_len"))
    values = F.sum("c") * F.col("prefix_len") * numbers
    return settle(counts.groupBy("prefix_len").agg(F.ceil(F.greatest(F.sum("c") / GROUP, values / VALUES)).alias("salts")))


def linear_model(
    train: DataFrame, cuts: DataFrame, vocabulary: DataFrame, factor: float = 0.3, width: int = WIDTH,
    vectors: DataFrame | None = None, vector_size: int = 32, bottleneck: int | None = None,
) -> LinearModel:
    """Fit all prefix lengths. With ``vectors`` (activity, vec) events are embedded instead of one-hot encoded.

    ``bottleneck``: directions that W may use, at least one; all of them if None.
    """
    if bottleneck is not None and bottleneck < 1:
        raise ValueError("a bottleneck has at least one direction")
    if vectors is None:
        size, unknown = vocabulary.count(), F.lit(-1).cast("bigint")
        codes = vocabulary.select("activity", F.col("idx").alias("code"))
    else:
        size, unknown = vector_size, F.array_repeat(F.lit(0.0), vector_size)
        codes = vectors.select("activity", F.col("vec").cast("array<double>").alias("code"))
    own = coded(train.where("n > 0"), ["case_id"], codes, unknown)
    fit = samples(train.join(own, "case_id"), cuts, "x").where("not in_tail")
    fit = fit.select("prefix_len", F.slice("x", 1, F.col("prefix_len")).alias("x")).groupBy("prefix_len", "x").agg(F.count("*").alias("w"))
    fit = fit.join(salted(train.where("n > 0").select("n"), 1 if vectors is None else size), "prefix_len").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts")))
    entries = (
        fit.groupBy("prefix_len", "salt").applyInPandas(
            lambda pdf: moments(pdf, size, width), "prefix_len int, i int, j int, c double"
        )
        .groupBy("prefix_len", "i", "j").agg(F.sum("c").alias("c")).join(cuts.select("prefix_len", "n_fit"), "prefix_len")
    )
    # A group has at most WIDTH^2 / 2 rows.
    form = entries.groupBy("prefix_len").applyInPandas(
        lambda pdf: solve(pdf, size, width, factor, bottleneck), "prefix_len int, dim int, i int, g array<double>, residual double"
    )
    return LinearModel(settle(form), codes, unknown, size, "onehot" if vectors is None else "word2vec", width)
