"""Approximate nearest neighbours by cosine: inverted lists, with an adaptive scan of dimensions inside each list.

Vectors are scaled to length 1 and turned by a fixed random rotation. Centres are fitted by k-means on about ``SAMPLE``
rows at most, chosen by a hash of the id; every row is then put into the list of its nearest centre. How many of the lists
nearest to it a query probes is told from the same sample: so many that they hold the share ``FOUND`` of the nearest
neighbours of ``TRIALS`` of its vectors (at least ``LEAST_PROBES``, and more until they hold enough rows). The sample is
thinner than the table, so its neighbours lie farther off and ask for rather more lists.

Inside a list, columns of the rotated vectors are read in blocks of ``COLUMNS``. After d of D columns, the squared
distance so far times D / d estimates the whole one; under the hypothesis that the candidate is within the bound r of
the k-th best so far, it exceeds r^2 (1 + EPSILON / sqrt(d))^2 only by rare chance, and then the candidate is
abandoned. The rest get their exact cosine in double precision from the original vectors.

A list is divided into blocks of ``CANDIDATES`` rows, and its queries into blocks of ``QUERIES``, so a hot list (many
equal vectors) is many small tasks. What is broadcast is the centres, at most ``MOST_LISTS``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

SAMPLE = 16_384
MOST_LISTS = 1_024
FOUND = 0.95
TRIALS = 256
LEAST_PROBES = 24
COLUMNS = 16
EPSILON = 2.1
CANDIDATES = 1024
QUERIES = 256
ROUNDS = 8
#: Squared distances of unit vectors closer than this are not told apart before the exact score.
NOISE = 1e-5


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(5).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; huge and tiny components don't overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(x: np.ndarray, n: int) -> np.ndarray:
    """k-means on the sphere from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def enough_probes(x: np.ndarray, middle: np.ndarray, k: int) -> int:
    """How many lists hold the share ``FOUND`` of the k nearest of some of the rows of x, each different row taken once."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return len(middle)
    at = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)
    own = np.concatenate([(x[i : i + 4096] @ middle.T).argmax(1) for i in range(0, len(x), 4096)])
    near = x[at] @ x.T
    near[np.arange(len(at)), at] = -np.inf
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[at] @ middle.T), axis=1, kind="stable"), axis=1)
    places = np.sort(place[np.arange(len(at))[:, None], own[top]], axis=None)
    return int(places[int(np.ceil(FOUND * len(places))) - 1]) + 1


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of original vectors, row by row; equal rows have equal results."""
    q, x = q / np.abs(q).max(1, keepdims=True), x / np.abs(x).max(1, keepdims=True)
    return (x * q).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def scan(q: np.ndarray, x: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that may be among the k nearest of a query in this block, ties at the bound included.

    q, x: rotated unit vectors; same: (queries, candidates) flags of pairs that don't count.
    """
    size, stop = x.shape[1], min(COLUMNS, x.shape[1])
    head, rows = slice(0, stop), np.arange(len(q))[:, None]
    sofar = (q[:, head] ** 2).sum(1)[:, None] + (x[:, head] ** 2).sum(1) - 2 * q[:, head] @ x[:, head].T
    sofar[same] = np.inf
    # The first bound: whole distances of the candidates that look nearest by now.
    n = min(4 * k, len(x))
    ahead = np.argpartition(sofar, n - 1, axis=1)[:, :n]
    whole = ((x[ahead] - q[:, None, :]) ** 2).sum(2)
    whole[same[rows, ahead]] = np.inf
    bound = np.partition(whole, k - 1, axis=1)[:, k - 1] if n >= k else np.full(len(q), np.inf)
    bound = np.where(np.isfinite(bound), bound, 4.0)  # too few candidates: all of them go on
    i, j = np.nonzero(~same & (sofar * (size / stop) <= (bound * (1 + EPSILON / np.sqrt(stop)) ** 2 + NOISE)[:, None]) if stop < size else ~same & (sofar <= bound[:, None] + NOISE))
    d = sofar[i, j]
    while stop < size:
        start, stop = stop, min(size, stop + COLUMNS)
        d = d + ((x[j, start:stop] - q[i, start:stop]) ** 2).sum(1)
        slack = (1 + EPSILON / np.sqrt(stop)) ** 2 if stop < size else 1.0
        keep = d * (size / stop) <= bound[i] * slack + NOISE
        i, j, d = i[keep], j[keep], d[keep]
    return i, j


def search(base: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, nearest first, ties to the smaller id.

    A row is no candidate of a query of the same id. Vectors that are null, empty, zero, hold a null or a non-finite
    component, or have no id take no part, nor do those of another size than most. Fewer candidates than k give
    all of them. A repeated row is a candidate as often as it stands, but one query; an id with several vectors is a query
    for each, with ranks of its own. Other columns are not looked at.
    """
    spark = base.sparkSession
    ok = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    usable = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null").where(F.coalesce(ok, F.lit(False)))
    rows = usable(base)
    sizes = rows.groupBy(F.size("v").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").first()
    shape = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], shape)
    size, n = sizes.s, sizes.n
    rows, asked = rows.where(F.size("v") == size), usable(queries).where(F.size("v") == size).distinct()

    share = F.pmod(F.xxhash64("id", F.lit("centres")), F.lit(1 << 20))
    got = rows.where(share < int((1 << 20) * min(1.0, SAMPLE / n)) + 1).orderBy("id").select("v").toArrow()
    turn = rotation(size)
    known = unit(np.asarray(got["v"].combine_chunks().flatten()).reshape(-1, size)) @ turn.T
    lists = max(1, min(MOST_LISTS, int(np.sqrt(n)), len(known)))
    middle = centres(known, lists) if len(known) else np.ones((1, size)) / np.sqrt(size)
    shared = spark.sparkContext.broadcast((turn, middle))

    def listed(frames):
        turn, middle = shared.value
        for pdf in frames:
            if len(pdf):
                x = unit(np.stack(pdf["v"].to_numpy())) @ turn.T
                yield pdf.assign(list=(x @ middle.T).argmax(1).astype(np.int32))

    indexed = settle(rows.mapInPandas(listed, "id long, v array<double>, list int"), "lists")
    held = {r.list: r.n for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MOST_LISTS rows
    count = np.array([held.get(i, 0) for i in range(len(middle))])
    blocks = np.maximum(1, -(-count // CANDIDATES))
    probes = max(LEAST_PROBES, enough_probes(known, middle, k))
    sent = spark.sparkContext.broadcast((count, blocks))

    def probing(frames):
        (turn, middle), (count, blocks) = shared.value, sent.value
        for pdf in frames:
            if not len(pdf):
                continue
            x = unit(np.stack(pdf["v"].to_numpy())) @ turn.T
            order = np.argsort(-(x @ middle.T), axis=1, kind="stable")
            enough = np.cumsum(count[order], 1) - count[order] <= k  # rows before this list are too few
            wanted = (np.arange(order.shape[1]) < probes) | enough
            wanted &= count[order] > 0
            row, place = np.nonzero(wanted)
            target = order[row, place]
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "v": [pdf["v"].iloc[r] for r in row], "list": target.astype(np.int32), "blocks": blocks[target]})

    probe = settle(asked.mapInPandas(probing, "id long, v array<double>, list int, blocks long"), "probes")
    crowd = {r.list: r.n for r in probe.groupBy("list").agg(F.count("*").alias("n")).collect()}
    turns = spark.sparkContext.broadcast((blocks, np.array([max(1, -(-crowd.get(i, 0) // QUERIES)) if crowd.get(i) else 0 for i in range(len(middle))])))

    def spread(frames):
        blocks, groups = turns.value
        for pdf in frames:
            at = pdf["list"].to_numpy()
            times = groups[at]
            row = np.repeat(np.arange(len(pdf)), times)
            group = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            salt = np.arange(len(pdf)) * 40503 + pdf["id"].to_numpy()
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "v": [pdf["v"].iloc[r] for r in row], "list": at[row], "block": (salt % blocks[at])[row], "crew": group})

    candidates = indexed.mapInPandas(spread, "id long, v array<double>, list int, block long, crew long")
    crews = F.array(*[F.lit(int(x)) for x in turns.value[1]])
    crew = F.pmod(F.xxhash64("id", "list"), F.greatest(F.element_at(crews, F.col("list") + 1), F.lit(1)).cast("long"))
    askers = probe.withColumn("crew", crew).select("id", F.xxhash64("id", "v").alias("ask"), "v", "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "crew")

    def compared(key, left, right):
        turn, _ = shared.value
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "ask": [], "vec_id": [], "score": []})
        q_raw, x_raw = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        q, x, ids = unit(q_raw) @ turn.T, unit(x_raw) @ turn.T, right["id"].to_numpy()
        own = left["id"].to_numpy()
        i, j = scan(q, x, own[:, None] == ids, k)
        score = cosine(q_raw[i], x_raw[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pd.DataFrame({"query_id": own[i[top]], "ask": left["ask"].to_numpy()[i[top]], "vec_id": ids[j[top]], "score": score[top]})

    keys = ["list", "block", "crew"]
    best = askers.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(compared, "query_id long, ask long, vec_id long, score double")
    w = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
