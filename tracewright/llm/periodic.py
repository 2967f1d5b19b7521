"""Maximal periodic runs of words, by string synchronising sets.

A run is a stretch of words with smallest period q and at least ``max(LEAST, 4 q)`` words that can't be made longer.

* Stretches of 1, 2, 4, ... words get names: equal stretches of a text have equal names, told exactly from the names of
  their halves. A stretch that stands only once has none, so higher scales hold ever fewer places.
* At scale t = 2, 4, 8, ... a place i is chosen if, of the stretches of t words that begin in i .. i + t, the one
  with the least hash of its name begins at i or at i + t. The choice depends on the 2 t words from i alone (the
  context), and any t consecutive places hold a chosen one, but where 3 t - 1 words have a period of t / 3 or less.
* Two chosen places with equal contexts, next to each other among these, propose their distance as a period if
  it lies in t .. 2 t - 1. A run of period q in that range reaches over q + 3 t - 1 places with room for the context and is no
  region of a period of t / 3 or less (its period would then be smaller), so it proposes its own.
* Stretches of t words with a period of t / 3 or less take no part in the choice, or periodic regions would be chosen
  throughout. They are told separately: their first half's next occurrence is at that period. The first of each such
  region proposes it; this is what finds period 1, for which there is no scale.

A proposal is stretched to both sides by names of falling size, which is exact, and what is long enough is a run.

Work is O(n log n) in NumPy for the texts of a chunk together. A text lies in one task: its names take 4 bytes a word and
scale up to the longest repeat in it, other arrays about 100 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import bounds, chunks, mix

LEAST = 6
TIMES = 4
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A name from 0 for every pair of names that stands more than once, -1 for the others."""
    key = left.astype(np.int64) << 32 | right
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    number = np.cumsum(np.concatenate([[True], ~same])) - 1
    out = np.empty(len(key), np.int32)
    out[order] = np.where(again, number, -1)
    return out


def doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Names of stretches of twice the size. Names tell texts apart, so a stretch never reaches into another text."""
    out = np.full(len(names), -1, np.int32)
    if len(names) > size:
        there = np.flatnonzero((names[:-size] >= 0) & (names[size:] >= 0))
        if len(there):
            out[there] = named(names[there], names[there + size])
    return out


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for every i with so many."""
    pad = -len(values) % width
    table = np.append(values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def next_same(names: np.ndarray) -> np.ndarray:
    """The distance to the next place of the same name, 0 without one."""
    there = np.flatnonzero(names >= 0)
    order = there[np.argsort(names[there], kind="stable")]
    out = np.zeros(len(names), np.int64)
    same = names[order][1:] == names[order][:-1]
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def regions(names: list[np.ndarray], k: int) -> np.ndarray:
    """For every place the period, at most t / 3, of the t = 2^k words from it; 0 without one."""
    t = 1 << k
    half, n = names[k - 1], len(names[0])
    period = next_same(half)
    at = np.flatnonzero((period > 0) & (3 * period <= t))
    at = at[at + t <= n]
    tail = half[at + t // 2]
    at = at[(tail >= 0) & (half[at + t // 2 - period[at]] == tail)]
    out = np.zeros(n, np.int64)
    out[at] = period[at]
    return out


def chosen(names: list[np.ndarray], k: int, period: np.ndarray) -> np.ndarray:
    """The places of the synchronising set of scale t = 2^k, of those whose context of 2 t words stands more than once."""
    t, context = 1 << k, names[k + 1]
    if len(context) <= t:
        return np.zeros(0, np.int64)
    most = np.iinfo(np.uint64).max
    # Stretches that stand once are in no repeated context, whatever value they take.
    value = np.where((period > 0) | (names[k] < 0), most, mix(names[k].astype(np.uint64) + np.uint64(k << 32)) >> np.uint64(1))
    least = least_of(value, t + 1)
    i = np.flatnonzero(context[: len(least)] >= 0)
    return i[(least[i] < most) & ((value[i] == least[i]) | (value[i + t] == least[i]))]


def proposals(names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): the words from the place have the period over more than its length."""
    found = []
    for k in range(1, len(names)):
        t = 1 << k
        period = regions(names, k) if k > 1 else np.zeros(len(names[0]), np.int64)
        first = np.flatnonzero((period > 0) & (np.concatenate([[0], period[:-1]]) != period))
        found.append((first, period[first]))
        if k + 1 == len(names):
            break
        at = chosen(names, k, period)
        at = at[np.argsort(names[k + 1][at], kind="stable")]
        gap = np.diff(at)
        fit = (names[k + 1][at[1:]] == names[k + 1][at[:-1]]) & (gap >= t) & (gap < 2 * t)
        found.append((at[:-1][fit], gap[fit]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def stretched(names: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last place + 1 of the longest stretches with these periods around the places."""
    n = len(names[0])
    low, high = at.copy(), at + period  # words before low + period and from low on compare equal as far as high
    for k in range(len(names) - 1, -1, -1):
        size = 1 << k
        # More than one step of the largest size: the names of the next size know of none.
        fit = np.flatnonzero(high + size <= n)
        a = names[k][high[fit] - period[fit]]
        high[fit[(a >= 0) & (a == names[k][high[fit]])]] += size
        fit = np.flatnonzero(low >= size)
        a = names[k][low[fit] - size]
        low[fit[(a >= 0) & (a == names[k][low[fit] - size + period[fit]])]] -= size
    return low, high


def runs(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by start and period. ``words``: hashes, text i at[i] .. at[i + 1]."""
    none = (np.zeros(0, np.int64),) * 4
    n = len(words)
    if not n:
        return none
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    names = [named(text, np.unique(words, return_inverse=True)[1])]
    while (names[-1] >= 0).any():
        names.append(doubled(names[-1], 1 << (len(names) - 1)))
    place, period = proposals(names)
    if not len(place):
        return none
    low, high = stretched(names, place, period)
    enough = high - low >= np.maximum(LEAST, TIMES * period)
    found = np.unique(np.stack([low[enough], period[enough], high[enough]], 1), axis=0)
    low, period, high = found.T
    return text[low], low - at[text[low]], high - low, period


def tiled(at: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The word that stands at each place once texts with g >= 0 repeat a block from a = g % n to their end."""
    n = np.diff(at)
    place = np.arange(at[-1])
    for k in np.flatnonzero((g >= 0) & (n > 0)):
        a = int(g[k] % n[k])
        p = 1 + (int(n[k]) - a) // (3 + int(g[k]) % 8)
        place[at[k] + a : at[k + 1]] = at[k] + a + np.arange(n[k] - a) % p
    return place


def detected(batches):
    """(id, n_words, runs, collapsed) of the rows (id, text, g) of each batch."""
    for batch in batches:
        for rows, chunk in chunks(batch, "text"):
            row, starts, ends = chunk.words()
            at = bounds(row, chunk.n)
            place = tiled(at, np.asarray(pc.fill_null(rows.column("g"), -1)).astype(np.int64))
            text, start, length, period = runs(chunk.hashes(starts, ends, chunk.sums())[place], at)
            dropped = np.zeros(len(place) + 1, np.int64)
            np.add.at(dropped, at[text] + start + period, 1)
            np.add.at(dropped, at[text] + start + length, -1)
            kept = np.cumsum(dropped[:-1]) == 0
            upto = np.concatenate([[0], np.cumsum(kept)])
            chosen_words = place[kept]
            runs_at = pa.array(bounds(text, chunk.n).astype(np.int32))
            items = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id"), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(runs_at, items),
                    joined(chunk.data, starts[chosen_words], ends[chosen_words], upto[at]),
                ],
                names=["id", "n_words", "runs", "collapsed"],
            )


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> pa.Array:
    """The words of each text (at[i] .. at[i + 1] of the ranges) with a space between two."""
    sizes = ends - starts + 1  # each with the byte behind it, which becomes the space
    upto = np.concatenate([[0], np.cumsum(sizes)])
    spread = np.arange(upto[-1]) + np.repeat(starts - upto[:-1], sizes)
    line = np.append(data, np.uint8(0x20))[np.minimum(spread, len(data))]
    line[upto[1:] - 1] = 0x20
    last = np.zeros(len(line), bool)  # no space behind the last word of a text
    some = np.diff(at) > 0
    last[upto[at[1:][some]] - 1] = True
    edges = upto[at] - np.concatenate([[0], np.cumsum(some)])
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(line[~last])]).cast(pa.string())


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: str | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs``.

    runs: (start, length, period) of all runs, by start and then period; words are numbered from 0. collapsed: the words
    of the text joined by one space, without those that some run contains after its first period. ``tile``: a column of
    numbers; where it is not null, the end of the text is first replaced by repetitions of a block (see ``tiled``).
    A null text, or one without a word, has no run and an empty collapsed text. Rows are independent of each other: repeated
    rows and rows without an id get their own result, an empty table gives an empty one, other columns are not looked at.
    """
    g = F.lit(None).cast("long") if tile is None else F.col(tile).cast("long")
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), g.alias("g"))
    kind = slim.schema["id"].dataType.simpleString()
    found = slim.mapInArrow(detected, f"id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
    return found.withColumnRenamed("id", doc_id)
