"""Similarity join of texts on sets of word n-grams: every pair with a Jaccard similarity of ``SIMILAR`` or more.

Candidates share one of ``BANDS`` bands of ``ROWS`` MinHash values (a pair at exactly 0.8 shares none with a chance of
3e-6, at 0.9 of 2e-11). A candidate's MinHash values are then compared ``STEP`` at a time; with m of n equal and an even
prior, the similarity s has the posterior Beta(m + 1, n - m + 1), and the pair is dropped as soon as
P(s >= SIMILAR) < ``TOLERANCE``. What is left is verified on the sets themselves.

How the work is dealt out:

* Texts with the same words are one class; only its representative (the smallest id) goes on, with the class's size.
* Band rows carry a key and an id. Only buckets with two classes or more go on, and these get their MinHash values.
* A bucket is divided into blocks of ``BLOCK`` classes; a task compares two blocks at a time in NumPy, so neither a
  task nor a row count grows with the square of a bucket. A pair is looked at only in the first band that it shares.
* Sets (64-bit hashes of the n-grams) travel only to the blocks in which a pair has survived the pruning.
* A block gives a count of links per class and a spanning forest of its links. Components of the forest are found by
  rounds of joins (large star, small star), each one written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .textarrays import bounds, chunks, mix, windows

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
STEP = 32
TOLERANCE = 1e-6
BLOCK = 1024
PAIRS = 1 << 15
SIZE = BANDS * ROWS

_rng = np.random.default_rng(11)
_FACTOR = _rng.integers(1, 1 << 32, SIZE, np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, SIZE, np.uint32)


def signatures(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values, SIZE per text that has a shingle (others: zeros)."""
    out = np.zeros((len(at) - 1, SIZE), np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        y = shingles.astype(np.uint32)
        starts = at[some]
        for k in range(SIZE):
            # The low half decides through its product; the high half keeps equal low halves apart.
            out[some, k] = np.minimum.reduceat(y * _FACTOR[k] + (x ^ _SHIFT[k]), starts)
    return out


def shingled(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, bounds, word hashes, bounds) of the texts of a chunk."""
    rows, starts, ends = chunk.words()
    at = bounds(rows, chunk.n)
    words = chunk.hashes(starts, ends, chunk.sums())
    grams, row = windows(words, at, WORDS, short=True)
    return grams, bounds(row, chunk.n), words, at


def word_keys(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of the whole sequence of words of each text."""
    place, keys = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at)), []
    for salt in (1, 2):
        value = mix(words * np.uint64(2 * salt + 1) + mix(place.astype(np.uint64) * np.uint64(salt)))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        keys.append(mix(upto[at[1:]] - upto[at[:-1]]).view(np.int64))
    return keys


def sign(batches):
    """(id, text_hash, a, b, sig): 128 bits of hash over the words of a text and its MinHash values; null without a word."""
    for batch in batches:
        for rows, chunk in chunks(batch, "text"):
            grams, at, words, word_at = shingled(chunk)
            sig = signatures(grams, at)
            none = np.diff(word_at) == 0
            halves = [pa.array(h, mask=none) for h in word_keys(words, word_at)]
            raw = pa.array([None if z else s.tobytes() for z, s in zip(none, sig)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("text_hash"), *halves, raw], names=["id", "text_hash", "a", "b", "sig"]
            )


def least_equal() -> np.ndarray:
    """For n = STEP, 2 STEP, ... compared values: the fewest equal ones with which a pair may go on."""
    least = []
    for n in range(STEP, SIZE + 1, STEP):
        log = np.concatenate([[0], np.cumsum(np.log(np.arange(1, n + 2)))])
        k = np.arange(n + 2)
        chance = np.exp(log[n + 1] - log[k] - log[n + 1 - k] + k * np.log(SIMILAR) + (n + 1 - k) * np.log1p(-SIMILAR))
        # P(s >= t | m of n) = P(Binomial(n + 1, t) <= m)
        least.append(int(np.searchsorted(np.cumsum(chance), TOLERANCE)))
    return np.array(least)


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) share no band before ``band`` and aren't dropped while their values are compared."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    for k, need in enumerate(least):
        part = sig[a[alive], k * STEP : (k + 1) * STEP] == sig[b[alive], k * STEP : (k + 1) * STEP]
        whole = part.reshape(len(alive), STEP // ROWS, ROWS).all(2)
        earlier = np.arange(k * STEP // ROWS, (k + 1) * STEP // ROWS) < band[alive, None]
        equal[alive] += part.sum(1)
        alive = alive[~(whole & earlier).any(1) & (equal[alive] >= need)]
    return alive


def groups_of(batches):
    """Batches cut so that each begins with a new (key, i, j): rows come sorted by these."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        if not t.num_rows:
            continue
        whole = t.to_batches()[0]
        key = np.stack([np.asarray(whole.column(c)).astype(np.int64) for c in ("key", "i", "j")])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        start = 0
        for end in new.tolist():  # some groups at a time, so that memory follows the largest group and not the batch
            if end - start >= BLOCK or end == new[-1]:
                yield whole.slice(start, end - start)
                start = end
        rest = whole.slice(start)
    if rest is not None and rest.num_rows:
        yield rest


def group_pairs(batch):
    """(signatures, group of each row, pieces of (a, b, band)): the pairs that survive, some at a time."""
    key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "i", "j")])
    new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])
    group = np.cumsum(new) - 1
    end = np.append(np.flatnonzero(new)[1:], len(new))[group]
    band, side = np.asarray(batch.column("band")), np.asarray(batch.column("side"))
    sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, SIZE)
    cross, least = key[1] != key[2], least_equal()

    def pieces():
        upto = np.cumsum(end - np.arange(len(end)) - 1)
        start = 0
        while start < len(end):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
            first = np.arange(start, stop)
            n = end[first] - first - 1
            a = np.repeat(first, n)
            b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            fit = ~cross[a] | (side[a] != side[b])
            a, b = a[fit], b[fit]
            keep = survivors(sig, a, b, band[a], least)
            yield a[keep], b[keep]
            start = stop

    return group, pieces()


def surviving(batches):
    """The rows (key, i, j, side, id) of groups that are in any pair left after pruning."""
    for batch in groups_of(batches):
        _, pieces = group_pairs(batch)
        wanted = np.zeros(batch.num_rows, bool)
        for a, b in pieces:
            wanted[a] = wanted[b] = True
        yield batch.filter(pa.array(wanted)).select(["key", "band", "i", "j", "side", "id"])


def verified(batches):
    """(id, links, other): links of a class in a group, weighted by the others' sizes; or an edge to ``other``."""
    for batch in groups_of(batches):
        n = batch.num_rows
        ids, size = np.asarray(batch.column("id")), np.asarray(batch.column("size"))
        sets = batch.column("grams")
        at = np.asarray(sets.offsets).astype(np.int64)
        at = at - at[0]
        values = np.asarray(sets.flatten())
        _, numbers = np.unique(values, return_inverse=True)
        mark = np.zeros(numbers.max(initial=-1) + 1, np.int32)
        links, left, right = np.zeros(n, np.int64), [], []
        _, pieces = group_pairs(batch)
        for a, b in pieces:
            for x in np.unique(a):
                others = b[np.searchsorted(a, x) : np.searchsorted(a, x, "right")]
                own = numbers[at[x] : at[x + 1]]
                n_other = at[others + 1] - at[others]
                ends = np.cumsum(n_other)
                spread = np.repeat(at[others] - ends + n_other, n_other) + np.arange(ends[-1])
                mark[own] = 1
                both = np.add.reduceat(mark[numbers[spread]], ends - n_other)
                mark[own] = 0
                # Whole numbers: 0.8 is 4 / 5.
                near = others[5 * both >= 4 * (len(own) + n_other - both)]
                links[x] += size[near].sum()
                links[near] += size[x]
                left.append(np.full(len(near), x))
                right.append(near)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        label = np.arange(n)
        while len(a):
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
        linked, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(n))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[linked], ids[tied]])),
                pa.array(np.concatenate([links[linked], np.zeros(len(tied), np.int64)])),
                pa.array(np.concatenate([np.zeros(len(linked), np.int64), ids[label[tied]]]), mask=np.arange(len(linked) + len(tied)) < len(linked)),
            ],
            names=["id", "links", "other"],
        )


def gram_sets(batches):
    """(id, grams): the class of a text and its sorted different n-gram hashes."""
    for batch in batches:
        for _, chunk in chunks(batch, "text"):
            grams, at, words, word_at = shingled(chunk)
            lists = [np.unique(grams[at[k] : at[k + 1]]).view(np.int64) for k in range(chunk.n)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(word_keys(words, word_at)[0]), sets], names=["id", "grams"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of the component for every id of an edge that isn't it. ``edges``: (u, v)."""
    small = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u <> v").distinct(), "edges")
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = new.where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = settle(new, "edges")
        same = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if same(new) == same(small):
            return new.select(F.col("u").alias("id"), F.col("v").alias("root"))
        small = new


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, copy_id, text_hash, group_key) for every row of ``docs``.

    class_id: the smallest id of the connected component of links (its own without a link). n_links: how many other
    rows are linked to this one, copies included. copy_id: the smallest id among the texts with the same words.
    A text with fewer than five words has one n-gram, all of its words. A null text, or one without a word, has no
    link, not even to its like. Repeated rows are copies of each other, and rows that repeat an id with another text
    are told apart. A row without an id takes no part: its class is null and it has no link. Other columns of
    ``docs`` are not looked at. text_hash is Spark's xxhash64 of the text; group_key tells components
    apart even where rows of several repeat an id, and is null without a word or an id.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    hashed = slim.where("id is not null").withColumn("text_hash", F.xxhash64("text"))
    signed = settle(hashed.mapInArrow(sign, "id long, text_hash long, a long, b long, sig binary"), "signed")
    worded = signed.where("sig is not null")
    # From here on a class goes by the first half of its hash.
    classes = settle(
        worded.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("sig").alias("sig"))
        .withColumnRenamed("a", "id"), "classes",
    )

    keys = [F.struct(F.lit(k).alias("band"), F.xxhash64(F.lit(k), F.substring("sig", 1 + 4 * ROWS * k, 4 * ROWS)).alias("key")) for k in range(BANDS)]
    bands = classes.select("id", F.explode(F.array(*keys)).alias("e")).select("id", "e.band", "e.key")
    buckets = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = bands.join(buckets, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    crowded = crowded.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks").cast("long")).cast("int"))
    tasks = crowded.select("key", "band", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    tasks = tasks.select("key", "band", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), F.col("block").alias("side"), "id")
    sig = classes.select("id", "sig", "size")
    left = settle(
        dealt(tasks.join(sig, "id")).mapInArrow(surviving, "key long, band int, i int, j int, side int, id long"), "left"
    )

    wanted = left.select("id").distinct()
    texts = slim.join(classes.join(wanted, "id").select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    sets = texts.mapInArrow(gram_sets, "id long, grams array<long>").groupBy("id").agg(F.first("grams").alias("grams"))
    found = settle(
        dealt(left.join(sig, "id").join(settle(sets, "sets"), "id")).mapInArrow(verified, "id long, links long, other long"), "found"
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")))
    linked = classes.select("id", "b", "rep", "size").join(links, "id", "left").join(roots, "id", "left")
    linked = linked.withColumn("root", F.coalesce("root", "id"))
    first = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    judged = linked.join(first, "root").select(
        F.col("id").alias("a"), "b", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("rep").alias("copy_id"), F.col("root").alias("group_key")
    )
    names = ["id", "class_id", "n_links", "copy_id", "text_hash", "group_key"]
    zero, no_id = F.lit(0).cast("long"), F.lit(None).cast("long")
    out = worded.select("id", "text_hash", "a", "b").join(judged, ["a", "b"]).select(*names)
    alone = signed.where("sig is null").select("id", F.col("id").alias("class_id"), zero.alias("n_links"), F.col("id").alias("copy_id"), "text_hash", no_id.alias("group_key"))
    none = slim.where("id is null").select("id", no_id.alias("class_id"), zero.alias("n_links"), no_id.alias("copy_id"), F.xxhash64("text").alias("text_hash"), no_id.alias("group_key"))
    return out.unionByName(alone).unionByName(none).withColumnRenamed("id", doc_id)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a (key, i, j) in one partition, side by side."""
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
