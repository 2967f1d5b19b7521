"""Near copies by SimHash fingerprints, found through Golay codewords.

A fingerprint has 64 bits: bit k is 1 if over half of the text's shingles (``WIDTH`` words, repeats included) have it in
their XXH64. Fingerprints at ``NEAR`` or fewer differing bits are linked.

Candidates. A fingerprint is cut into three segments of 22, 21 and 21 bits. The binary Golay code [23, 12, 7] is
perfect: every 23-bit word lies within 3 bits of exactly one codeword. A segment's keys are the codewords of the segment
and of its one-bit neighbours (one codeword, or up to six where the nearest is 3 bits away), so two segments that
differ in 2 bits or fewer share a key: the word between them is a neighbour of both. With 4 differing bits in all,

* either some segment is equal, and of the other two the one with fewer errors has at most 2:
  key = (equal segment, codeword of another), 34 bits, six pairings;
* or every segment has an error, hence none more than 2: key = (codeword, codeword, codeword), 36 bits.

So no link is lost, and a key is as selective as 34 to 36 exact bits. About 150 keys stand for a fingerprint.

How the work is dealt out: equal fingerprints are one class from the start (copies never meet). Rows of a key and a
fingerprint are shuffled once, and a task compares the fingerprints of a key with popcounts; it gives a spanning forest of
their links, not pairs. A key that holds very many (told from the keys of one in ``SAMPLED`` fingerprints, which decides on the
way taken and not on the result) is divided into blocks of about ``BLOCK``, and a task compares two of these. Components are
found by rounds of joins written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import settle
from .ngram_join import components

WIDTH = 4
SEED = 42
NEAR = 4
#: Texts are read in pieces of about this many bytes, so memory doesn't follow a very long text's words.
PIECE = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"

#: (lowest bit, bits) of a fingerprint's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRINGS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BLOCK = 4096
SAMPLED = 64
PAIRS = 1 << 20
#: Fingerprints whose keys a task makes.
TASK = 1 << 15


class Golay:
    """Decoding tables of the [23, 12, 7] code, built where they are used."""

    def __init__(self):
        self.rest = self._rest(np.arange(1 << 12, dtype=np.int64) << 11)
        bits = 1 << np.arange(23, dtype=np.int64)
        wrong = [np.zeros(1, np.int64)]
        for _ in range(3):  # all words of weight up to 3: each has a remainder of its own
            wrong.append(np.unique(wrong[-1][:, None] | bits))
        wrong = np.unique(np.concatenate(wrong))
        self.error = np.zeros(1 << 11, np.int64)
        self.error[self.remainder(wrong)] = wrong

    def __reduce__(self):
        return Golay, ()

    @staticmethod
    def _rest(words):
        for bit in range(22, 10, -1):
            words = words ^ np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
        return words

    def remainder(self, words):
        return self.rest[words >> 11] ^ (words & 0x7FF)

    def index(self, words):
        """The 12 data bits of the codeword within 3 bits of each word."""
        return (words ^ self.error[self.remainder(words)]) >> 11

    def around(self, words, bits: int):
        """Sorted codeword indices of each word and its neighbours in the lowest ``bits`` bits, one row a word; repeats are -1."""
        found = [self.index(words)] + [self.index(words ^ (1 << b)) for b in range(bits)]
        found = np.sort(np.stack(found, 1), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        most = int((found >= 0).sum(1).max(initial=0))
        return -np.sort(-found, axis=1)[:, :most]


GOLAY = Golay()


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints."""
    cut = [(fingerprints >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    near = [GOLAY.around(words, bits) for words, (_, bits) in zip(cut, SEGMENTS)]
    a, b, c = near[0][:, :, None, None], near[1][:, None, :, None], near[2][:, None, None, :]
    whole = np.where((a >= 0) & (b >= 0) & (c >= 0), a << 24 | b << 12 | c, -1).reshape(len(fingerprints), -1)
    parts = [whole]
    for k, (same, other) in enumerate(PAIRINGS, 1):
        parts.append(np.where(near[other] >= 0, k << 36 | cut[same][:, None] << 12 | near[other], -1))
    keys = np.concatenate(parts, axis=1)
    row, column = np.nonzero(keys >= 0)
    return row, keys[row, column]


def keyed(batches):
    """(fp, key): all keys of the fingerprints."""
    for batch in batches:
        fp = np.asarray(batch.column("fp")).astype(np.int64)
        for start in range(0, len(fp), 4096):
            part = fp[start : start + 4096]
            row, key = keys_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(key)], names=["fp", "key"])


def word_pieces(raw: bytes):
    """The words of a text in lower case (A to Z only), some at a time."""
    start = 0
    while start < len(raw):
        stop = min(start + PIECE, len(raw))
        while stop < len(raw) and raw[stop] not in SPACES:
            stop += 1
        yield raw[start:stop].lower().split()
        start = stop


def shingle_bits(words: list[bytes], width: int) -> np.ndarray:
    """How many of the shingles have each of the 64 bits."""
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(words) - width + 1
    found = [xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[:last].tolist(), ends[width - 1 :].tolist())]
    total = np.zeros(64, np.int64)
    for at in range(0, len(found), 65536):
        part = np.array(found[at : at + 65536], np.uint64).astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(raw: bytes) -> int:
    """The 64 bits of a text as an unsigned number; 0 without a word."""
    carry, count, bits = [], 0, np.zeros(64, np.int64)
    for piece in word_pieces(raw):
        words = carry + piece
        if len(words) >= WIDTH:
            count += len(words) - WIDTH + 1
            bits += shingle_bits(words, WIDTH)
        carry = words[1 - WIDTH :]
    if not count and carry:
        count, bits = 1, shingle_bits(carry, len(carry))
    return int.from_bytes(np.packbits(2 * bits > count, bitorder="little").tobytes(), "little")


def sign(batches):
    """(id, fp) of every row."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], names=["id", "fp"])


def whole_groups(batches):
    """Keys and fingerprints of batches that each hold whole groups of a key, without the keys that stand alone: rows come sorted."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key = np.concatenate([key, np.asarray(batch.column("key")).astype(np.int64)])
        fp = np.concatenate([fp, np.asarray(batch.column("fp")).astype(np.int64)])
        start = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if start:
            yield shared(key[:start], fp[:start])
            key, fp = key[start:], fp[start:]
    yield shared(key, fp)


def shared(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    same = key[1:] == key[:-1]
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(key) else np.zeros(0, bool)
    return key[several], fp[several]


def forest(batches):
    """(u, v): a spanning forest of the links among the fingerprints of each key."""
    for key, fp in whole_groups(batches):
        bits, n = fp.view(np.uint64), len(fp)
        more = np.searchsorted(key, key, "right") - np.arange(n) - 1
        upto = np.cumsum(more)
        left, right, start = [], [], 0
        while start < n:  # some pairs at a time
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
            m = more[start:stop]
            a = np.repeat(np.arange(start, stop), m)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
            near = np.bitwise_count(bits[a] ^ bits[b]) <= NEAR
            left.append(a[near])
            right.append(b[near])
            start = stop
        if left:
            label = lowest(n, np.concatenate(left), np.concatenate(right))
            tied = np.flatnonzero(label != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[label[tied]])], names=["u", "v"])


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def blocked(keys: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, fp) with a key of its own for every two blocks of a hot key; ``hot``: (key, blocks)."""
    rows = keys.join(hot, "key", "left").withColumn("side", F.pmod(F.xxhash64("fp", "key"), F.coalesce("blocks", F.lit(1)).cast("long")))
    others = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), F.array("side"))
    pairs = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(
        F.transform(others, lambda x: F.xxhash64("key", F.least("side", x), F.greatest("side", x)))
    )
    return rows.select(F.explode(pairs).alias("key"), "fp")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    fingerprint: 16 lowercase hexadecimal digits. component_id: the smallest id reachable over links, its own included.
    A text with fewer than four words has one shingle, all of its words; one without a word (null too) has the
    fingerprint zero, which is linked like any other. Rows that repeat an id are rows of their own, told apart by text.
    A row without an id is linked as well, but its id is no candidate for component_id, which is null where no row of a
    component has one. An empty table gives an empty one; other columns of ``docs`` are not looked at.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = settle(slim.mapInArrow(sign, "id long, fp long"), "signed")
    classes = settle(signed.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    spread = classes.select("fp").repartition(max(1, -(-classes.count() // TASK)))
    keys = spread.mapInArrow(keyed, "fp long, key long")
    some = classes.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0).mapInArrow(keyed, "fp long, key long")
    most = (F.col("n") * SAMPLED / BLOCK).cast("int")
    hot = settle(some.groupBy("key").agg(F.count("*").alias("n")).select("key", most.alias("blocks")).where("blocks > 1"), "hot")
    if not hot.isEmpty():
        keys = blocked(keys, hot)
    dealt = keys.select("key", "fp").repartition("key").sortWithinPartitions("key")
    roots = components(dealt.mapInArrow(forest, "u long, v long"))
    rooted = classes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(low, "root").select("fp", "component_id")
    return signed.join(named, "fp").select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
