"""Runs of letters of texts as NumPy arrays of code points, with hashes of words and of parts of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textarrays import BASE, POWERS, bounds, chunks, mix

#: Stands before and after a word.
EDGE = 0x20


def hashed(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


class Letters:
    """Lower-case code points of some texts, with their words: maximal runs of letters."""

    def __init__(self, texts: pa.Array):
        kept = pc.fill_null(texts, "").cast(pa.large_string())
        lower = pc.utf8_lower(kept)
        self.points = np.frombuffer("".join(lower.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.asarray(pc.utf8_length(lower)).astype(np.int64)
        self.at, self.n = np.concatenate([[0], np.cumsum(sizes)]), len(texts)
        seen = np.zeros(0x110000, bool)
        seen[self.points] = True
        letter = np.zeros(0x110000, bool)
        letter[[c for c in np.flatnonzero(seen).tolist() if chr(c).isalpha()]] = True
        inside = letter[self.points]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = self.at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.at, self.starts, "right") - 1
        up, self.down = POWERS.upto(len(self.points))
        self.sums = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum(hashed(self.points) * up[: len(self.points)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + size * np.uint64(0xD6E8FEB86659FD93))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of the different words, where each first stands, which of them each word is)."""
        return np.unique(self.hash(self.starts, self.ends), return_index=True, return_inverse=True)

    def grams(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, which of ``words``) of every run of ``width`` characters of the words, edges included."""
        sizes = self.ends[words] - self.starts[words] + 2
        at = np.concatenate([[0], np.cumsum(sizes)])
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(at[-1]) - at[word]
        edge = (place == 0) | (place == sizes[word] - 1)
        source = np.where(edge, 0, self.starts[words][word] + place - 1)
        values = hashed(np.where(edge, EDGE, self.points[source] if len(self.points) else 0))
        total, factor = np.zeros(at[-1], np.uint64), 1
        for j in range(width):
            total[: at[-1] - j] += values[j:] * np.uint64(factor)
            factor = factor * BASE % (1 << 64)
        full = place + width <= sizes[word]
        return mix(total[full]), word[full]


def letter_chunks(batch: pa.RecordBatch, text: str):
    """(rows of the batch, their Letters), some rows at a time."""
    for rows, _ in chunks(batch, text):
        yield rows, Letters(rows.column(text))


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, whether it is there) of each key."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return place, table[place] == keys


__all__ = ["Letters", "bounds", "find", "letter_chunks"]
