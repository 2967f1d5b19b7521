"""How far the sources of a language lie from each other, term by term and pair by pair.

Each language keeps the terms that occur in ``MIN_DOCS`` of its documents. Each of its sources gives every kept term a
share p in thousand millionths (smoothed counts, whole numbers), and two shares differ by f(p, q). A pair's value is the
sum of f over all kept terms, the many with no occurrence in either source included.

That sum is taken on run-length columns:

* Terms of a language with the same counts in all its sources are one cluster of some length; most rare terms share one.
  Clusters are sorted by their counts, source by source, so that equal counts come to lie side by side.
* Sorted clusters are cut into tiles of at most ``TILE`` clusters. In a tile a source's column is run-length encoded:
  what no cluster mentions is a run of zeros.
* For a pair of sources the boundaries of both columns are intersected, f is told once for each stretch between
  boundaries and multiplied by its length. A task holds two blocks of ``BLOCK`` sources of one tile.

Tiles are ranges of the sorted order, so no language, source or term ever meets in one task; counts are summed in the
tasks that read the texts before anything is shuffled. All numbers are whole: p fits 64 bits up to 2.8e14 occurrences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import range_slot
from ..session import settle
from .textarrays import Chunk, chunks

MIN_DOCS = 10
TOP = 10
TILE = 1024
BLOCK = 64

#: Bytes between terms: all of ASCII but its letters.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

#: 1,000,000,000 as a product, so that a share is told in 64 bits.
PARTS = (32_000, 31_250)


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings at some ranges of a byte array."""
    sizes = ends - starts
    upto = np.concatenate([[0], np.cumsum(sizes)])
    spread = np.arange(upto[-1]) + np.repeat(starts - upto[:-1], sizes)
    parts = [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data[spread])]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), parts)


def count_terms(chunk: Chunk, group: np.ndarray):
    """(group, first start, first end, occurrences, texts) of every term of every group of a chunk's texts."""
    capital = (chunk.data >= 0x41) & (chunk.data <= 0x5A)
    chunk.data = np.where(capital, chunk.data | np.uint8(0x20), chunk.data)
    row, starts, ends = chunk.words(BETWEEN)
    _, first, term = np.unique(chunk.hashes(starts, ends, chunk.sums()), return_index=True, return_inverse=True)
    in_text, occurs = np.unique(term * chunk.n + row, return_counts=True)
    term, row = np.divmod(in_text, max(chunk.n, 1))
    of_group = term * (int(group.max(initial=0)) + 1) + group[row]
    order = np.argsort(of_group, kind="stable")
    new = np.flatnonzero(np.diff(of_group[order], prepend=-1))
    first = first[term[order][new]]
    return (
        group[row[order]][new], starts[first], ends[first],
        np.add.reduceat(occurs[order], new) if len(new) else occurs, np.diff(np.append(new, len(order))),
    )


def counted(batches):
    """(lang, source, term, occurs, docs), summed over some texts at a time."""
    for batch in batches:
        for rows, chunk in chunks(batch, "text"):
            keys = pa.StructArray.from_arrays([rows.column("lang"), rows.column("source")], names=["lang", "source"]).to_pylist()
            names = {}
            group = np.array([names.setdefault((k["lang"], k["source"]), len(names)) for k in keys], np.int64)
            of, starts, ends, occurs, docs = count_terms(chunk, group)
            lang, source = (pa.array([k[c] for k in names], pa.string()).take(pa.array(of)) for c in (0, 1))
            terms = cut(chunk.data, starts, ends).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [lang, source, terms, pa.array(occurs.astype(np.int64)), pa.array(docs.astype(np.int64))],
                names=["lang", "source", "term", "occurs", "docs"],
            )


def share(occurs, total, terms):
    """p: 1 + the whole thousand millionths of (occurs + 2) / (total + 2 terms); of Columns."""
    x, y = occurs + F.lit(2), total + 2 * terms
    whole = lambda a: F.call_function("div", a, y)
    high = x * F.lit(PARTS[0])
    return 1 + whole(high) * F.lit(PARTS[1]) + whole(high % y * F.lit(PARTS[1]))


def shares(occurs: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same in NumPy."""
    y = np.int64(total + 2 * terms)
    high, rest = np.divmod((occurs + 2) * np.int64(PARTS[0]), y)
    return 1 + high * np.int64(PARTS[1]) + rest * np.int64(PARTS[1]) // y


def difference(p, q):
    """f of two shares, in NumPy."""
    return (p - q) * (p - q) // (p + q)


def encoded(runs, size: int, total: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """A source's column in a tile: where its runs start, and their shares. ``runs``: (start, length, occurs) where it occurs."""
    if runs is None or not len(runs):
        at = np.zeros((0, 3), np.int64)
    else:
        at = np.array([(r["start"], r["length"], r["occurs"]) for r in runs], np.int64)
        at = at[np.argsort(at[:, 0])]
    starts = np.concatenate([[0], np.stack([at[:, 0], at[:, 0] + at[:, 1]], 1).ravel()])  # gap, run, gap, run, ..., gap
    occurs = np.concatenate([[0], np.stack([at[:, 2], np.zeros(len(at), np.int64)], 1).ravel()])
    there = np.append(starts[1:], size) > starts  # no empty gaps
    starts, occurs = starts[there], occurs[there]
    new = np.concatenate([np.ones(min(1, len(occurs)), bool), occurs[1:] != occurs[:-1]])
    return starts[new], shares(occurs[new], total, terms)


def pair_values(part: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value), a before b: the part of a tile in the values of the pairs of two blocks of sources."""
    part = part.sort_values("source")  # rows come in any order, but a pair is the same one in every tile
    side = part["side"].to_numpy()
    cross = bool(len(part)) and part["i"].iloc[0] != part["j"].iloc[0]
    names, size = part["source"].to_list(), int(part["size"].iloc[0])
    columns = [encoded(r, size, n, v) for r, n, v in zip(part["runs"], part["total"], part["terms"])]
    out = []
    for a in range(len(names)):
        starts_a, p = columns[a]
        for b in range(a + 1, len(names)):
            if cross and side[a] == side[b]:
                continue
            starts_b, q = columns[b]
            starts = np.union1d(starts_a, starts_b)
            f = difference(p[np.searchsorted(starts_a, starts, "right") - 1], q[np.searchsorted(starts_b, starts, "right") - 1])
            out.append((names[a], names[b], int((f * np.diff(np.append(starts, size))).sum())))
    found = pd.DataFrame(out, columns=["a", "b", "value"])
    found.insert(0, "lang", part["lang"].iloc[0])
    return found.astype({"value": "int64"})


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = rows.withColumn("rank", F.row_number().over(w))
    found = found if most is None else found.where(F.col("rank") <= most)
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank).

    part "pair": every other source of the language with its value, all ranks. part "term": the ``TOP`` terms whose share
    in the source exceeds the language's most. Null texts, languages and sources are the empty text. Every (lang, source)
    that occurs has its pairs, also without a term; a language that keeps no term has pairs of value 0. Repeated
    rows count as often as they stand. Ties go to the smaller item by UTF-8. An empty table gives an empty one; other
    columns are not looked at. A text is read whole by one task, and a term may be as long as its text.
    """
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    slim = docs.select(empty(lang, "lang"), empty(source, "source"), empty(text, "text"))
    parts = slim.mapInArrow(counted, "lang string, source string, term string, occurs long, docs long")
    counts = settle(parts.groupBy("lang", "source", "term").agg(F.sum("occurs").alias("occurs"), F.sum("docs").alias("docs")), "counts")
    held = F.sort_array(F.collect_list(F.struct("source", "occurs")))
    kept = settle(
        counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("occurs").alias("all"), held.alias("held"))
        .where(F.col("docs") >= MIN_DOCS).select("lang", "term", "all", "held"), "kept",
    )
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    of_source = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.occurs").alias("total"))
    groups = slim.select("lang", "source").distinct().join(of_lang, "lang", "left").join(of_source, ["lang", "source"], "left")
    zero = F.lit(0).cast("long")
    groups = settle(groups.fillna(0, ["terms", "lang_total", "total"]), "groups")

    # Clusters in order, cut into tiles, with their place in the tile.
    # Any order in which equal counts of the first sources lie side by side will do; hashes keep its bounds small.
    first = [F.xxhash64(F.get("held", F.lit(k))) for k in (0, 1)]
    clusters = range_slot(kept.groupBy("lang", "held").agg(F.count("*").alias("length")), ["lang"], [*first, F.xxhash64("held")])
    inside = Window.partitionBy("lang", "_slot").orderBy(*first, "held")
    tiled = clusters.withColumn("tile", F.call_function("div", F.row_number().over(inside) - 1, F.lit(TILE)).cast("int"))
    upto = F.sum("length").over(Window.partitionBy("lang", "_slot", "tile").orderBy(*first, "held").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tiled = settle(tiled.withColumn("start", upto - F.col("length")), "tiled")
    tile = ["lang", "_slot", "tile"]
    sizes = tiled.groupBy(*tile).agg(F.sum("length").alias("size"))
    runs = tiled.select(*tile, "start", "length", F.explode("held").alias("h"))
    runs = runs.groupBy(*tile, "h.source").agg(F.collect_list(F.struct("start", "length", "h.occurs")).alias("runs"))
    numbered = Window.partitionBy("lang").orderBy("source")
    blocked = groups.withColumn("side", F.call_function("div", F.row_number().over(numbered) - 1, F.lit(BLOCK)).cast("int"))
    blocked = settle(blocked.withColumn("blocks", F.max("side").over(Window.partitionBy("lang")) + 1), "blocked")
    columns = sizes.join(blocked, "lang").join(runs, [*tile, "source"], "left")
    columns = columns.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = columns.withColumn("i", F.least("side", "with")).withColumn("j", F.greatest("side", "with"))
    sums = columns.select(*tile, "i", "j", "side", "source", "size", "total", "terms", "runs")
    sums = sums.groupBy(*tile, "i", "j").applyInPandas(pair_values, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    other = groups.select("lang", F.col("source").alias("b"))
    pairs = groups.select("lang", F.col("source").alias("a")).join(other, "lang").where("a <> b")
    pairs = pairs.join(both, ["lang", "a", "b"], "left").select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.coalesce("value", zero).alias("value"))

    told = kept.select("lang", F.col("term").alias("item"), "all", F.explode("held").alias("h")).select("lang", "item", "all", "h.*")
    told = told.join(groups, ["lang", "source"])
    p, q = share(F.col("occurs"), F.col("total"), F.col("terms")), share(F.col("all"), F.col("lang_total"), F.col("terms"))
    told = told.withColumn("p", p).withColumn("q", q).where("p > q")
    told = told.withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)"))
    return ranked(pairs, "pair").unionByName(ranked(told, "term", TOP))
