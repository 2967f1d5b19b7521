"""Perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

N-grams are counted inside each task and summed by Spark; counts, contexts and lower orders are joined as tables that are
sharded by their key, so the model is never whole in one place. Every n-gram that any document holds is resolved
once, through joins with the model's orders (the longest known one, times the backoff weights of the longer contexts).
The resolved table is then cut by hash into shards of about ``SHARD`` rows; for each shard, the documents are read and
the logarithms of their n-grams in it are summed; sums of the shards are added up per document.

A language's bound is a quantile of the logarithmic perplexity of its trusted documents, plus a slack.

Characters and not words, because word n-grams are almost all different: shuffling them takes several times the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .textarrays import BASE, chunks, mix

ORDER = 5
SHARD = 2_000_000
QUANTILE = 0.99
#: Added to the quantile of the logarithm; texts with few characters vary more, so SHORT / sqrt(n) comes on top.
SLACK, SHORT = 0.1, 2.0
HELD_BACK = 5
#: Bits of the filter that precedes the join with the trusted ids (1 MB, whatever their number).
FILTER = 1 << 23
#: Stands before a text ORDER - 1 times, and for every run of white space.
BLANK = 0x20


class Grams:
    """Runs of ORDER characters that end at each character of some texts."""

    def __init__(self, texts: list[str | None]):
        lead = " " * (ORDER - 1)
        whole = [lead + " ".join(t.split()) if t else lead for t in texts]
        self.points = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in whole], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        row = np.repeat(np.arange(len(whole)), sizes)
        place = np.arange(at[-1]) - at[row]
        self.starts = np.flatnonzero(place + ORDER <= sizes[row])
        self.rows, self.n = row[self.starts], len(whole)
        self.hashes = gram_hashes(self.points, self.starts)

    def text(self, start: int) -> str:
        return self.points[start : start + ORDER].tobytes().decode("utf-32-le", "surrogatepass")


def gram_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    values, total, factor = mix(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)), np.zeros(len(starts), np.uint64), 1
    for j in range(ORDER):
        total += values[starts + j] * np.uint64(factor)
        factor = factor * BASE % (1 << 64)
    return mix(total)


def all_grams(batches):
    """(g, c): the n-grams of a task's texts and how often each occurs, summed while there are at most SHARD of them."""
    known, count, names = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(count)], names=["g", "c"])

    for batch in batches:
        for rows, _ in chunks(batch, "text"):
            grams = Grams(rows.column("text").to_pylist())
            h, first, c = np.unique(grams.hashes, return_index=True, return_counts=True)
            place = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            old = known[place] == h if len(known) else np.zeros(len(h), bool)
            count[place[old]] += c[old]
            new = ~old
            text = np.array([grams.text(s) for s in grams.starts[first[new]].tolist()], object)
            order = np.argsort(np.concatenate([known, h[new]]), kind="stable")
            known = np.concatenate([known, h[new]])[order]
            count, names = np.concatenate([count, c[new]])[order], np.concatenate([names, text])[order]
            if len(known) > SHARD:  # memory stays bounded; the rest of the task counts anew
                yield out()
                known, count, names = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
    if len(known):
        yield out()


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of an order from its numbers of n-grams that occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = table.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.1), k - 0.05) for d, k in zip(raw, (1, 2, 3)))


def train(texts: DataFrame) -> list[tuple[DataFrame, DataFrame | None]]:
    """For the orders 1 .. ORDER: (g, p) of the known n-grams and (h, back) of their contexts (None for order 1)."""
    counts = settle(texts.mapInArrow(all_grams, "g string, c long").groupBy("g").agg(F.sum("c").alias("c")), "grams")
    tables = [counts]
    for _ in range(ORDER - 1):  # lower orders count how many different characters come before
        tables.insert(0, settle(tables[0].groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("c")), "grams"))
    model, lower = [], None
    for k, table in enumerate(tables, 1):
        d = discounts(table)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        if k == 1:
            whole = table.agg(F.sum("c").alias("total"), F.sum(cut).alias("freed"), F.count("*").alias("v")).first()
            total, freed, v = float(whole.total or 1), float(whole.freed or 0), whole.v
            p = settle(table.select("g", ((F.col("c") - cut) / total + freed / total / (v + 1)).alias("p")), "order")
            model.append((p, freed / total / (v + 1) if whole.total else 1.0))
        else:
            context = F.expr(f"substring(g, 1, {k - 1})")
            by = table.groupBy(context.alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("freed"))
            by = settle(by.select("h", "total", (F.col("freed") / F.col("total")).alias("back")), "contexts")
            long = table.withColumn("h", context).withColumn("s", F.expr("substring(g, 2)")).join(by, "h")
            long = long.join(lower.select(F.col("g").alias("s"), F.col("p").alias("low")), "s")
            p = settle(long.select("g", ((F.col("c") - cut) / F.col("total") + F.col("back") * F.col("low")).alias("p")), "order")
            model.append((p, by.select("h", "back")))
        lower = p
    return model


def resolve(wanted: DataFrame, model: list) -> DataFrame:
    """(g, logp) of every n-gram of ``wanted`` (g): each order is asked only for what the longer ones don't know."""
    done, rest = [], wanted.select("g", F.col("g").alias("s"), F.lit(0.0).alias("log"))
    for k in range(ORDER, 0, -1):
        p, back = model[k - 1]
        asked = settle(rest.join(p.select(F.col("g").alias("s"), "p"), "s", "left"), "asked")
        done.append(asked.where("p is not null").select("g", (F.col("log") + F.log("p")).alias("logp")))
        rest = asked.where("p is null").drop("p")
        if k > 1:
            rest = rest.withColumn("h", F.expr(f"substring(s, 1, {k - 1})")).join(back, "h", "left")
            rest = rest.select("g", F.expr("substring(s, 2)").alias("s"), (F.col("log") + F.coalesce(F.log("back"), F.lit(0.0))).alias("log"))
        else:
            done.append(rest.select("g", (F.col("log") + float(np.log(back))).alias("logp")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def hashed(batches):
    """(h, logp) of resolved n-grams."""
    for batch in batches:
        points = np.frombuffer("".join(batch.column("g").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        h = gram_hashes(points, np.arange(0, len(points), ORDER))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("logp")], names=["h", "logp"])


def summed(spark, shard: DataFrame) -> Column:
    """A struct (log, n): sum of the logarithms of a text's n-grams in a shard, and how many it has in all."""
    got = shard.orderBy("h").toArrow()  # about SHARD rows
    h = np.asarray(got["h"].combine_chunks()).view(np.uint64) if got.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(h)
    values = np.asarray(got["logp"].combine_chunks())[order].astype(np.float32) if got.num_rows else np.zeros(0, np.float32)
    shared = spark.sparkContext.broadcast((h[order], values))

    @F.arrow_udf("struct<log:double,n:long>")
    def total(texts: pa.Array) -> pa.Array:
        keys, values = shared.value
        logs, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for rows, _ in chunks(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            grams = Grams(rows.column("text").to_pylist())
            different, which = np.unique(grams.hashes, return_inverse=True)
            value = np.zeros(len(different))
            if len(keys):
                place = np.minimum(np.searchsorted(keys, different), len(keys) - 1)
                there = keys[place] == different
                value[there] = values[place[there]]
            logs.append(np.bincount(grams.rows, value[which], minlength=grams.n))
            sizes.append(np.bincount(grams.rows, minlength=grams.n))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(logs)), pa.array(np.concatenate(sizes).astype(np.int64))], names=["log", "n"])

    return total(F.col("text"))


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose doc_id is in ``ids``. A filter of FILTER bits comes first, so that few other texts are shuffled."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    bit = F.expr(f"shiftleft(1L, int(pmod(xxhash64(doc_id), {FILTER}) % 64))")
    bits = settle(ids.groupBy(F.floor(slot / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "filter")  # FILTER / 64 rows at most
    maybe = rows.join(F.broadcast(bits), F.floor(slot / 64) == F.col("_word")).where(bit.bitwiseAND(F.col("_bits")) != 0)
    return maybe.drop("_word", "_bits").join(ids, "doc_id")  # ids are distinct; a semi join would be moved before the filter


def scores(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, trusted, held_back, n, log_perplexity) for every row of ``docs``.

    trusted: the ids (doc_id) of trusted rows; one in HELD_BACK of them, by a hash, is kept out of the training, so
    that bounds can be taken from texts that the model has not seen. White space counts as one blank, and none at the
    ends of a text. A text without a character has n = 0 and a null perplexity; without any trusted text all characters
    are equally unlikely. Repeated rows are scored alike. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held back")), F.lit(HELD_BACK)) == 0
    ids = settle(trusted.select("doc_id").where("doc_id is not null").distinct(), "trusted")
    model = train(marked(rows.where("text is not null").select("doc_id", "text"), ids.where(~held)).select("text"))
    wanted = settle(rows.where("text is not null").select("text").mapInArrow(all_grams, "g string, c long").select("g").distinct(), "wanted")
    resolved = settle(resolve(wanted, model).mapInArrow(hashed, "h long, logp double"), "resolved")
    shards = max(1, -(-resolved.count() // SHARD))
    parts = []
    for k in range(shards):
        own = resolved.where(F.pmod("h", F.lit(shards)) == k)
        found = rows.select("doc_id", "lang", F.xxhash64("text").alias("t"), summed(spark, own).alias("s"))
        parts.append(settle(found, "sums"))
    each = parts[0].select("doc_id", "lang", "t", F.col("s.n").alias("n"), F.col("s.log").alias("log"))
    if shards > 1:  # the same rows stand in every part; copies of a row have the same sums
        more = parts[1]
        for p in parts[2:]:
            more = more.unionByName(p)
        more = more.groupBy(F.col("doc_id").alias("_doc"), F.col("t").alias("_t")).agg((F.avg("s.log") * (shards - 1)).alias("more"))
        each = each.join(more, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t")))
        each = each.withColumn("log", F.col("log") + F.col("more"))
    value = F.when(F.col("n") > 0, -F.col("log") / F.col("n"))
    each = each.select("doc_id", "lang", "n", value.alias("log_perplexity"))
    known = ids.select(F.col("doc_id").alias("_doc"), held.alias("_held"))
    return each.join(known, F.col("doc_id") == F.col("_doc"), "left").select(
        "doc_id", "lang", F.col("_doc").isNotNull().alias("trusted"), F.coalesce("_held", F.lit(False)).alias("held_back"), "n", "log_perplexity"
    )


def judged(scored: DataFrame) -> DataFrame:
    """``scored`` with ``bound`` and ``kept``: a row is kept if its logarithmic perplexity is within its language's bound.

    A language without trusted rows (held back ones) takes the bound of all trusted rows; without any, every row is kept that has a score.
    """
    scored = settle(scored, "scored")
    basis = scored.where("held_back and n > 0").withColumn("x", F.col("log_perplexity") - SHORT / F.sqrt("n"))
    quantile = F.percentile_approx("x", QUANTILE, 10_000)
    by = settle(basis.groupBy(F.col("lang").alias("_lang")).agg(quantile.alias("own")), "bounds")
    everything = basis.agg(quantile.alias("q")).first().q
    every = float("inf") if everything is None else everything
    bound = F.coalesce("own", F.lit(every)) + SLACK + SHORT / F.sqrt("n")
    out = scored.join(by, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("bound", F.when(F.col("n") > 0, bound))
    return out.withColumn("kept", F.coalesce(F.col("log_perplexity") <= F.col("bound"), F.lit(False))).drop("_lang", "own")
