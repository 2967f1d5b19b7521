"""Words, lines and their hashes as NumPy arrays, computed over Arrow batches of texts.

A batch is cut into chunks of about ``CHUNK`` bytes (one text is never cut), so memory follows the longest
text and not the batch. Null texts are treated as empty ones. Hashes have 64 bits.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)

#: Ranges of more bytes have a digest for their hash: sums modulo 2^64 fall together for long texts of two letters.
LONG = 128

#: Bytes between words: the characters of [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_TABLE = np.random.default_rng(7).integers(1, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """BASE and its inverse to the powers 0 .. n, modulo 2^64, kept for the longest n so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):  # the tables are built where they are used
        return Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


POWERS = Powers()

class Chunk:
    """Some texts as one byte array: text ``i`` is ``data[at[i]:at[i + 1]]``."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data, self.at, self.n = data[at[0] : at[-1]], at - at[0], len(texts)

    def sums(self) -> np.ndarray:
        """Running sums of which differences are hashes of byte ranges."""
        up, _ = POWERS.upto(len(self.data))
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * up[: len(self.data)], out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each range; equal ranges have equal hashes wherever they stand."""
        _, down = POWERS.upto(len(self.data))
        out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * STEP)
        for k in np.flatnonzero(ends - starts > LONG):
            out[k] = int.from_bytes(blake2b(self.data[starts[k] : ends[k]], digest_size=8).digest(), "little")
        return out

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of every word; ``space`` flags the bytes between words."""
        inside = ~space[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = self.at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(self.data))]  # a word ends where its text ends
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return self.rows(starts), starts, ends

    def rows(self, places: np.ndarray) -> np.ndarray:
        """The text in which each byte stands."""
        return np.searchsorted(self.at, places, "right") - 1

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return upto[self.at[1:]] - upto[self.at[:-1]]


def chunks(batch: pa.RecordBatch, text: str):
    """(rows of the batch, their texts as a Chunk), some rows at a time."""
    column = batch.column(text)
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    upto, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + CHUNK, "right")))
        yield batch.slice(start, stop - start), Chunk(column.slice(start, stop - start))
        start = stop


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """From sorted row numbers: where each row's entries begin (n + 1 values)."""
    return np.searchsorted(rows, np.arange(n + 1))


def windows(values: np.ndarray, at: np.ndarray, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``width`` values inside a row.

    short: a row with fewer values gives one run over all it has, if it has any.
    """
    sizes = np.diff(at)
    n = len(values)
    total = np.zeros(n, np.uint64)
    factor = 1
    for j in range(width):
        total[: n - j] += values[j:] * np.uint64(factor)
        factor = factor * BASE % (1 << 64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) - at[row]
    full = place + width <= sizes[row]
    if not short:
        return mix(total[full]), row[full]
    few = (sizes < width) & (sizes > 0)
    whole = np.zeros(len(sizes), np.uint64)
    if few.any():
        member = few[row]
        weight = POWERS.upto(width)[0][np.minimum(place[member], width)] * values[member]
        np.add.at(whole, row[member], weight)
        whole[few] += sizes[few].astype(np.uint64) * STEP
    keep = full | (few[row] & (place == 0))
    return mix(np.where(few[row[keep]], whole[row[keep]], total[keep])), row[keep]
