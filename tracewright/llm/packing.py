"""Packing of tokenised documents into sequences of fixed length: best-fit decreasing with certified bin counts.

Pieces are dealt into partitions of about ``GROUP`` rows by a hash, packed by best-fit decreasing, and held against a
lower bound from dual feasible functions. A partition that reaches its bound is certified and stays. The others keep
their full sequences and exchange the rest: these pieces are dealt anew, among all such partitions, and packed again. A
round counts only if it needs fewer sequences for its pieces than before; there are ``ROUNDS`` at most.

Only (id, place, length, checksum) of a piece is shuffled, never its tokens; a partition has GROUP rows on average however
often a row repeats, as rows are salted by their place in the input.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .textarrays import chunks

LENGTH = 2048
END = 0
GROUP = 4096
ROUNDS = 3
VOCABULARY = "byte_bpe_50k.tiktoken"

PIECE = "doc_id long, salt long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", missing boolean, bin long, offset long, certified boolean, full boolean"


def encoder(path: str):
    """Byte-level BPE from a file of ranks. ``byte_bpe_50k.tiktoken`` gives the ids of ``byte_bpe_50k.json``, about
    three times as fast; a special token's string in a text is ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: one if they fit, else all but the first are of full length."""
    first = (n - 1) % length + 1
    return [(0, first), *[(s, length) for s in range(first, n, length)]]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece of each row's tokens, with ``ids`` (array) if asked for. A null text is an empty one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)

    def cut(batches):
        known, salt = encoder(path), 0
        for batch in batches:
            for rows, _ in chunks(batch, "text"):
                out, lists = [], []
                for doc, t in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                    tokens = np.array([*known.encode_ordinary(t or ""), END], np.dtype("<u4"))
                    for k, (s, n) in enumerate(cuts(len(tokens), length)):
                        part = tokens[s : s + n]
                        out.append((doc, salt, k, s, n, zlib.crc32(part.tobytes())))
                        lists.append(part)
                    salt += 1
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
                names = ["doc_id", "salt", "piece", "start", "length", "ids_crc32"]
                if ids:
                    arrays.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(cut, PIECE + (", ids array<int>" if ids else ""))


def best_fit(sizes: list[int], length: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each size, taken in the given order: into the fullest bin with room for it."""
    room, spare = {}, 0  # open bins by what is left in them; bit r of spare: there is one with r left
    bins, offsets, n = [], [], 0
    for s in sizes:
        if fit := spare >> s:
            left = s + (fit & -fit).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                spare ^= 1 << left
        else:
            left, b = length, n
            n += 1
        bins.append(b)
        offsets.append(length - left)
        if left > s:
            room.setdefault(left - s, []).append(b)
            spare |= 1 << (left - s)
    return bins, offsets


def lower_bound(sizes: np.ndarray, length: int) -> int:
    """No packing of ``sizes`` has fewer bins: the best of two families of dual feasible functions."""
    count = np.bincount(sizes, minlength=length + 1).astype(np.int64)
    weight = count * np.arange(length + 1)
    number, total = np.cumsum(count), np.cumsum(weight)
    # f_k: sizes over length - k count as whole bins, sizes under k as nothing.
    k = np.arange(length // 2 + 1)
    below = np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    large = number[length] - number[length - k]
    value = large * length + total[length - k] - below
    best = int(np.max(-(-value // length)))
    # u_k: with (k + 1) x / length whole x stays, else it is rounded down to a multiple of 1 / k.
    x = np.arange(length + 1)
    for k in range(1, 21):
        whole = (k + 1) * x % length == 0
        u = np.where(whole, x * k, (k + 1) * x // length * length)  # in units of 1 / (k * length)
        best = max(best, int(-(-int((u * count).sum()) // (k * length))))
    return best


def packed(part: pd.DataFrame, length: int) -> pd.DataFrame:
    """Best-fit decreasing over one partition, with its certificate."""
    part = part.sort_values(["length", "doc_id", "piece", "salt"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    sizes = part["length"].to_numpy()
    bins, offsets = best_fit(sizes.tolist(), length)
    fill = np.bincount(bins, sizes)
    return part.assign(
        bin=np.array(bins, np.int64), offset=np.array(offsets, np.int64),
        certified=len(fill) == lower_bound(sizes, length), full=fill[bins] == length,
    )


def pack(rows: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``rows`` (PIECE) with sequence_id, offset and ``certified`` (its partition had no sequence too many).

    Pieces of rows without an id are packed like any other and stay without one.
    """
    rows = settle(rows, "pieces")
    names, n = rows.columns, rows.count()
    done, last, bins = [], None, None  # packed for good; what the last round left open, and in how many sequences
    for turn in range(ROUNDS):
        parts = max(1, -(-n // group))
        # pandas turns whole numbers beside a null into floats, so ids travel without nulls.
        dealt = rows.withColumn("missing", F.col("doc_id").isNull()).fillna(0, ["doc_id"])
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "salt", F.lit(turn)), F.lit(parts)))
        one = lambda key, pdf: packed(pdf.drop(columns="part"), length).assign(part=key[0])
        out = settle(dealt.groupBy("part").applyInPandas(one, PACKED + ", part long"), "packed")
        out = out.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing")
        out = out.withColumn("sequence_id", F.lit(turn << 56) + F.col("part") * (1 << 20) + F.col("bin"))
        first, left = F.col("offset") == 0, ~F.col("certified") & ~F.col("full")
        got = out.agg(F.count_if(first).alias("bins"), F.count_if(left).alias("rows"), F.count_if(first & left).alias("left")).first()
        if last is not None and got.bins >= bins:
            break  # no gain: what the last round left open stays as it was
        done.append(out.where(~left))
        last, bins, n = out.where(left), got.left, got.rows
        rows = last.select(*names)
        if not n or parts == 1:
            break
    done.append(last)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
