"""Mixing of sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Slot k of the schedule belongs to the source in whose share of the line [0, 1) the golden-ratio point frac(k * phi)
falls. Slots are ranked per source. The documents of a source, shuffled by a hash, are cut into blocks of ``BLOCK`` words;
slot r of a source takes its block r, and after the last block it begins again with the first; its last slot is cut so
that the source's words are its target. As the points have low discrepancy, the sources are in proportion in every
stretch of the schedule; slots that they leave out (a few for each source) follow at its end. ``parts`` tells the slot of
all that is taken, ``mix`` the sums for each document.

Scale: slots and documents are ranked in two steps (totals per slot of a hash or stretch first), so that a hot source is
never in one task. Points are matched with shares by an equi-join on a grid of ``CELLS`` cells. Blocks are joined
with their slots on (source, block), at most two slots for each block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import running_total
from ..session import settle
from .common import WORD

BLOCK = 16_384
CELLS = 4_096
STRETCH = 4_096
#: Fractional part of the golden ratio in units of 2^-32.
PHI = 2_654_435_769
WEIGHTS = (3, 1, 2)
TIMES = 1.5
MOST = 2


def sized(docs: DataFrame, text: str, source: str, doc_id: str, carry: list[str]) -> DataFrame:
    """(doc_id, source, size, h, carry): words of each text (0 if null) and a hash to shuffle by."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    h = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), h.alias("h"), *carry)


def targets(rows: DataFrame) -> DataFrame:
    """(source, no, source_size, target): one row per source, numbered by code point, null last.

    Weights 3, 1, 2 repeat. The line of the water filling: sources in order of cap / weight stay at their cap
    as long as the rest of the total gives the remaining ones more than that for each unit of weight.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))  # one row per source
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    s = sizes.withColumn("no", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    s = s.withColumn("w", weights[((F.col("no") - 1) % len(WEIGHTS)).cast("int")])
    s = s.withColumn("cap", F.col("source_size") * float(MOST)).withColumn("total", F.sum("source_size").over(everything) * TIMES)
    order = everything.orderBy(F.col("cap") / F.col("w"), "no")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "no", "level"))).over(everything)
    return s.withColumn("line", first["level"]).select(
        "source", "no", "source_size", F.least("cap", F.coalesce(F.col("line") * F.col("w"), F.col("cap"))).alias("target")
    )


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """(slot, no, r): the source of each of ``slots`` slots and the slot's rank (from 0) among its source's.

    shares: (no, target). Points and shares are whole numbers of 2^-32, so that a rerun gives the same schedule.
    """
    spark = shares.sparkSession
    everything = Window.partitionBy(F.lit(0))
    upto = F.sum("target").over(everything.orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("target").over(everything)
    ends = shares.withColumn("hi", F.when(F.col("no") == F.max("no").over(everything), F.lit(1 << 32)).otherwise(F.round(upto / whole * (1 << 32))).cast("long"))
    ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(everything.orderBy("no")), F.lit(0).cast("long"))).where("hi > lo")
    width = (1 << 32) // CELLS
    cells = ends.select("no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(PHI) % F.lit(1 << 32)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") / width))
    drawn = points.join(cells, "cell").where("x >= lo and x < hi").select("slot", "no")
    ranked = running_total(drawn, ["no"], F.expr(f"slot div {STRETCH}"), ["slot"], F.lit(1).cast("bigint"), "r")
    return ranked.select("slot", "no", (F.col("r") - 1).alias("r"))


def dealt(docs: DataFrame, text: str, source: str, doc_id: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The worded rows, cut at blocks, with each slot that their block has, and the rows without words.

    Of the first: (no, start, doc_id, carry, size, source_size, target, slot, place, before, part); ``part`` is 0 and the slot null where
    a block has none. Slots that the points leave out are numbered behind the schedule.
    """
    rows = settle(sized(docs, text, source, doc_id, carry), "sized")
    goals = settle(targets(rows), "targets")
    numbered = rows.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    worded = numbered.where("size > 0")
    end = running_total(worded, ["no"], F.substring("h", 1, 3), ["h", "doc_id", "size"], F.col("size"), "end")
    placed = settle(end.withColumn("start", F.col("end") - F.col("size")), "placed")

    # Of the words of the source's repeated blocks, the first ``goal`` are taken; a block ends the round if it is the last.
    goals = goals.where("source_size > 0").select("no", F.round("target").cast("long").alias("goal"), "target", "source_size")
    goals = goals.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    rest = F.col("goal") % F.col("source_size")
    goals = goals.withColumn("turns", F.expr("goal div source_size") * F.col("blocks") + F.ceil(rest / BLOCK))
    slots = goals.agg(F.sum("turns").alias("n")).first().n or 0
    drawn = schedule(goals.select("no", "target"), slots)
    # What the points leave out, a few slots of a source at most, comes after the schedule.
    reached = drawn.groupBy("no").agg(F.count("*").alias("have"))
    short = goals.join(reached, "no", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).where("have < turns")
    late = short.select("no", F.explode(F.sequence("have", F.col("turns") - 1)).alias("r"))
    late = running_total(late, [], F.expr(f"no div {STRETCH}"), ["no", "r"], F.lit(1).cast("bigint"), "slot")
    late = late.select((F.col("slot") + (slots - 1)).alias("slot"), "no", "r")
    turn = drawn.unionByName(late).join(goals, "no").where("r < turns")
    turn = turn.withColumn("block", F.col("r") % F.col("blocks"))
    before = F.expr("r div blocks") * F.col("source_size") + F.col("block") * BLOCK
    turn = turn.select("no", "block", "slot", (F.col("block") * BLOCK + F.col("goal") - before).alias("stop"))
    pieces = placed.select(
        "no", "doc_id", *carry, "size", "source_size", "target", "start", "end",
        F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(end - 1) div {BLOCK}"))).alias("block"),
    )
    joined = pieces.join(turn, ["no", "block"], "left")
    opens = F.greatest("start", F.col("block") * BLOCK)
    inside = F.least("end", (F.col("block") + 1) * BLOCK, "stop") - opens
    part = F.when(F.col("stop").isNotNull(), F.greatest(inside, F.lit(0).cast("long"))).otherwise(0)
    return joined.select(
        "no", "start", "doc_id", *carry, "size", "source_size", "target", "slot",
        (opens - F.col("block") * BLOCK).alias("place"), (opens - F.col("start")).alias("before"), part.alias("part"),
    ), numbered.where("size = 0")


def parts(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The mix in its order: (no, start, doc_id, carry, size, slot, place, before, taken), one row for each part that is taken.

    A part is ``taken`` words of a row after its first ``before``; it stands at word ``place`` of the block in ``slot``, so (slot, place)
    is the order of the mix and no two parts share it. A slot is one block of one source; numbers without a block are possible. (no, start), the
    source's number and the row's first word in it, tell rows apart. For the rest see ``mix``.
    """
    carry = carry or []
    worded, _ = dealt(docs, text, source, doc_id, carry)
    return worded.where("part > 0").select("no", "start", "doc_id", *carry, "size", "slot", "place", "before", F.col("part").cast("long").alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, carry, size, source_size, target, taken) for every row of ``docs``; carry: further columns to keep.

    size: words (null text: 0). Each source's taken words are its target, rounded, and no row is taken more than twice. Rows of a null source form one of their own, the last. A row without words takes nothing. Repeated rows
    are rows of their own. An id that is null is shuffled like the empty text. An empty table gives an empty one.
    Only the columns named are read. ``parts`` tells where in the schedule the taken words stand.
    """
    carry = carry or []
    worded, none = dealt(docs, text, source, doc_id, carry)
    mixed = worded.groupBy("no", "start", "doc_id", *carry, "size", "source_size", "target").agg(F.sum("part").cast("long").alias("taken"))
    columns = ["doc_id", *carry, "size", "source_size", "target"]
    nothing = none.select(*columns, F.lit(0).cast("long").alias("taken"))
    return mixed.select(*columns, "taken").unionByName(nothing)
