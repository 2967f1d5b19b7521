"""Labelled anomalies: rewrites of the trace array of a case, with what was done as a label.

Input is CASES plus the columns ``kind`` (anomaly type) and ``round``. All types are worked in
one pass over the rows; for a constant ``kind`` the branches of the other types fold away.
Every draw depends on case, type and round only (see ``functions.draws``).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import distinct_places, draw, draw_below, order_hash, sized_text
from .kinds import Case, Kind, own
from .kinds import register as register_kind
from .vocab import Lookup

LABEL = (
    "struct<anomaly:string,size:int,start:int,shift_from:int,shift_to:int,indices:array<int>,"
    "inserts:array<int>,skips:array<int>,acts:array<string>,part1:array<string>,part2:array<string>>"
)


@dataclass(frozen=True)
class Limits:
    """Greatest sizes and distances of a draw."""

    sequence: int = 3
    distance: int = 5
    inserts: int = 3
    replacements: int = 3
    skips: int = 3


# Types of the standard sweep, and the further types.
SWEEP = ["SkipSequence", "Rework", "Early", "Late", "Insert"]
FURTHER = ["Replace", "Skip", "SkipAndInsert"]

# Shortest case each type can change; shorter ones stay normal.
SHORTEST = {
    "SkipSequence": 3, "Rework": 2, "Early": 3, "Late": 3, "Insert": 2, "Replace": 3, "Skip": 5, "SkipAndInsert": 3,
}


def register(kind: Kind) -> None:
    """Make a caller's type known by its name (see ``kinds``)."""
    register_kind(kind, SHORTEST)


def shortest() -> dict[str, int]:
    """The shortest case that each type can change, registered types included."""
    return SHORTEST | {name: kind.shortest for name, kind in own().items()}


def descriptor(kind: str, limits: Limits = Limits()) -> dict:
    """Type and parameters of an anomaly, as it is stored beside a generated log."""
    if kind != "Attribute" and kind not in shortest():
        raise ValueError(f"unknown anomaly {kind!r}; known: {sorted([*shortest(), 'Attribute'])}")
    return {"anomaly": kind, "parameters": asdict(limits)}


class _ByKind:
    """Chooses a value by type, for the types that can occur."""

    def __init__(self, kind: Column, kinds):
        self.kind, self.kinds = kind, set(kinds)

    def __call__(self, as_type: str, **branches) -> Column:
        """Types that share a value are joined with a double underscore; values are made when needed."""
        out = F.when(F.lit(False), F.lit(None).cast(as_type))
        for names, value in branches.items():
            live = [k for k in names.split("__") if k in self.kinds]
            if live:
                out = out.when(self.kind.isin(live), value().cast(as_type))
        return out


def _cut(trace, start, stop) -> Column:
    """Entries ``start`` up to before ``stop``, counted from 0."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.slice(trace, start + 1, F.greatest(stop - start, F.lit(0)))


def _without(trace, places) -> Column:
    return F.filter(trace, lambda x, i: ~F.array_contains(places, i))


def _with_inserts(trace, places, names) -> Column:
    """``names[j]`` placed before the entry that stood at ``places[j]``."""
    return F.flatten(
        F.transform(
            trace,
            lambda x, i: F.when(
                F.array_contains(places, i),
                F.array(F.element_at(names, F.array_position(places, i).cast("int")), x),
            ).otherwise(F.array(x)),
        )
    )


def _with_replacements(trace, places, names) -> Column:
    return F.transform(
        trace,
        lambda x, i: F.when(
            F.array_contains(places, i), F.element_at(names, F.array_position(places, i).cast("int"))
        ).otherwise(x),
    )


def inject(
    cases: DataFrame, words: Lookup, limits: Limits = Limits(), filler: bool = False, kinds=(*SWEEP, *FURTHER)
) -> DataFrame:
    """Apply each row's ``kind``; adds ``label`` and replaces ``trace`` and ``n``.

    Rows of a type outside ``kinds`` stay normal. ``kinds`` may name registered types. With ``filler`` inserted and replacing events
    are named ``Random activity k`` instead of being taken from the vocabulary.
    """
    kind, n = F.col("kind"), F.col("_n")
    size, dist, start = F.col("_size"), F.col("_dist"), F.col("_from")
    who = [F.col("case_id"), kind, F.col("round")]
    chosen = _ByKind(kind, kinds)

    def pick(limit, part):
        return draw_below(limit, *who, part)

    def part_of(divisor, limit):
        return F.least(F.expr(f"_n div {divisor}").cast("int"), F.lit(limit))

    live, least = F.lit(False), shortest()
    for name in kinds:
        live = live | ((kind == name) & (n >= least[name]))
    df = cases.withColumn("_n", F.size("trace")).withColumn("_live", live)

    # Sequence types: size, then distance, then start.
    used = set(kinds)
    df = df.withColumn("_size", chosen(
        "int",
        SkipSequence=lambda: 1 + pick(F.least(n - 1, F.lit(limits.sequence)), "size"),
        Rework=lambda: 2 + pick(F.least(n, F.lit(limits.sequence)) - 1, "size"),
        Early__Late=lambda: 1 + pick(F.least(n - 1, F.lit(limits.sequence + 1)) - 1, "size"),
    ))
    if "Rework" in used:
        df = df.withColumn("_source", F.when(kind == "Rework", pick(n - size + 1, "start")))
    if used & {"Rework", "Early", "Late"}:
        df = df.withColumn("_dist", chosen(
            "int",
            Rework=lambda: pick(F.least(n - size - F.col("_source"), F.lit(limits.distance)) + 1, "distance"),
            Early__Late=lambda: 1 + pick(F.least(n - size, F.lit(limits.distance + 1)) - 1, "distance"),
        ))
    if used & {"SkipSequence", "Rework", "Early", "Late"}:
        df = df.withColumn("_from", chosen(
            "int",
            SkipSequence=lambda: pick(n - size, "start"),
            Rework=lambda: F.col("_source"),
            Early=lambda: dist + pick(n - size - dist, "start"),
            Late=lambda: pick(n - size - dist, "start"),
        ))

    # Registered types: their draws, one after the other.
    types = [t for name, t in own().items() if name in used]
    seen = {t.name: {} for t in types}

    def case_of(t, names=None):
        return Case(F.col("trace"), n, tuple(who), dict(seen[t.name]), names)

    for at, t in enumerate(types):
        for part, value in (t.draws or {}).items():
            column = f"_own{at}_{part}"
            df = df.withColumn(column, F.when(F.col("_live") & (kind == t.name), value(case_of(t))))
            seen[t.name][part] = F.col(column)
    naming = [t for t in types if t.num_names]

    # Place types: how many, where (places of the original trace), and the new names.
    nowhere = F.array().cast("array<int>")
    if used & {"Insert", "Replace", "Skip", "SkipAndInsert"}:
        df = df.withColumn("_count", F.when(F.col("_live"), chosen(
            "int",
            Insert=lambda: 1 + pick(part_of(2, limits.inserts), "count"),
            Replace=lambda: 1 + pick(part_of(3, limits.replacements), "count"),
            Skip=lambda: 2 + pick(part_of(2, limits.skips) - 1, "count"),
            SkipAndInsert=lambda: 1 + pick(part_of(2, limits.skips), "count"),
        )))
        step = F.when(kind == "Replace", F.lit(2)).otherwise(F.lit(1))
        spots = distinct_places(F.sequence(F.lit(0), n - 2, step), F.col("_count"), *who, "place")
        df = df.withColumn("_places", F.when(F.col("_count").isNotNull(), spots).otherwise(nowhere))
    # SkipAndInsert draws again on what the skip leaves.
    if "SkipAndInsert" in used:
        both = (kind == "SkipAndInsert") & F.col("_live")
        half = F.least(F.expr("(_n - _count) div 2").cast("int"), F.lit(limits.inserts))
        spots = distinct_places(F.sequence(F.lit(0), n - F.col("_count") - 2), F.col("_more"), *who, "place2")
        df = df.withColumn("_more", F.when(both, 1 + pick(half, "more")))
        df = df.withColumn("_places2", F.when(both, spots).otherwise(nowhere))
    if used & {"Insert", "Replace", "SkipAndInsert"} or naming:
        news = chosen("int", Insert__Replace=lambda: F.col("_count"), SkipAndInsert=lambda: F.col("_more"))
        for t in naming:
            count = t.num_names(case_of(t)).cast("int")
            news = F.when(F.col("_live") & (kind == t.name), F.when(count > 0, count)).otherwise(news)
        drawn = F.transform(F.sequence(F.lit(1), news), lambda j: draw(*who, "name", j))
        df = df.withColumn("_draws", F.when(news.isNotNull(), drawn).otherwise(F.array().cast("array<bigint>")))
        if filler:
            span = F.greatest(words.size - 1, F.lit(1))
            df = df.withColumn("_names", F.transform(
                "_draws", lambda d: F.concat(F.lit("Random activity "), (1 + F.pmod(d, span)).cast("string"))
            ))
        else:
            df = words.fill(df, ["case_id", "kind", "round"], "_draws", "_names")

    t, names, places, places2 = F.col("trace"), F.col("_names"), F.col("_places"), F.col("_places2")
    target = start + size + dist
    moved = _cut(t, start, start + size)
    closed_up = F.transform(places, lambda p, j: p - j)
    new_trace = chosen(
        "array<string>",
        SkipSequence=lambda: F.concat(_cut(t, 0, start), _cut(t, start + size, n)),
        Rework=lambda: F.concat(_cut(t, 0, target), moved, _cut(t, target, n)),
        Early=lambda: F.concat(_cut(t, 0, start - dist), moved, _cut(t, start - dist, start), _cut(t, start + size, n)),
        Late=lambda: F.concat(_cut(t, 0, start), _cut(t, start + size, target), moved, _cut(t, target, n)),
        Insert=lambda: _with_inserts(t, places, names),
        Replace=lambda: _with_replacements(t, places, names),
        Skip=lambda: _without(t, places),
        SkipAndInsert=lambda: _with_inserts(_without(t, places), places2, names),
    )

    labels = {}
    for made in types:
        case = case_of(made, names if made.num_names else None)
        labels[made.name] = made.label(case)
        new_trace = F.when(kind == made.name, made.rewrite(case).cast("array<string>")).otherwise(new_trace)

    def after_inserts():
        return F.transform(closed_up, lambda p: p + F.size(F.filter(places2, lambda q: q < p)))

    label = F.struct(
        kind.alias("anomaly"),
        size.alias("size"),
        chosen("int", SkipSequence=lambda: start, Rework=lambda: target).alias("start"),
        chosen("int", Early=lambda: start + size, Late=lambda: start).alias("shift_from"),
        chosen("int", Early=lambda: start - dist, Late=lambda: start + dist).alias("shift_to"),
        chosen(
            "array<int>",
            Insert=lambda: F.transform(places, lambda p, j: p + j),
            Replace=lambda: places,
            Skip=lambda: F.array_distinct(closed_up),
        ).alias("indices"),
        chosen("array<int>", SkipAndInsert=lambda: F.transform(places2, lambda p, j: p + j)).alias("inserts"),
        chosen("array<int>", SkipAndInsert=lambda: F.array_distinct(after_inserts())).alias("skips"),
        chosen(
            "array<string>",
            SkipSequence__Rework=lambda: moved,
            Replace__Skip__SkipAndInsert=lambda: F.transform(places, lambda p: F.element_at(t, p + 1)),
        ).alias("acts"),
        F.lit(None).cast("array<string>").alias("part1"),
        F.lit(None).cast("array<string>").alias("part2"),
    )
    for name, values in labels.items():
        given = F.struct(*[
            (kind if f == "anomaly" else values.get(f, F.lit(None))).cast(as_type).alias(f) for f, as_type in label_fields(values)
        ])
        label = F.when(kind == name, given).otherwise(label)
    helpers = [c for c in df.columns if c.startswith("_")]
    return (
        df.withColumn("label", F.when(F.col("_live"), label).otherwise(normal_label()))
        .withColumn("trace", F.when(F.col("_live"), new_trace).otherwise(t))
        .drop(*helpers)
        .withColumn("n", F.size("trace"))
    )


def label_fields(given=()) -> list[list[str]]:
    """Names and types of a label's fields; an error if ``given`` holds another name."""
    fields = [part.split(":", 1) for part in LABEL[len("struct<"):-1].split(",")]
    other = set(given) - {name for name, _ in fields if name != "anomaly"}
    if other:
        raise ValueError(f"a label has no field {sorted(other)} to be told")
    return fields


def normal_label() -> Column:
    return F.struct(
        *[F.lit("normal" if name == "anomaly" else None).cast(kind).alias(name) for name, kind in label_fields()]
    )


def as_kind(cases: DataFrame, kind, round_=1) -> DataFrame:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return cases.withColumn("kind", kind).withColumn("round", F.lit(round_))


def sweep(cases: DataFrame, words: Lookup, times: int = 2, kinds=SWEEP, limits: Limits = Limits()) -> DataFrame:
    """The original cases (round 0, normal) and every type applied ``times`` times to each."""
    grid = F.array(
        F.struct(F.lit("Normal").alias("kind"), F.lit(0).alias("round")),
        *[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("round")) for r in range(1, times + 1) for k in kinds],
    )
    rows = cases.withColumn("_g", F.explode(grid)).select("*", "_g.kind", "_g.round").drop("_g")
    return inject(rows, words, limits, kinds=kinds)


def attribute_anomalies(
    events: DataFrame, domain: DataFrame, lengths: DataFrame, attrs: list[str], max_events: int = 2, max_attrs: int = 1
) -> DataFrame:
    """Cells (case, position, attribute) whose value is replaced by another one of its domain.

    Only drawn cells are looked up in the domain (``attr, val, idx``); a domain of one value
    changes nothing. Cases without attributes give no rows.
    """
    if not attrs:
        return events.sparkSession.createDataFrame([], "case_id string, pos bigint, attr string, original string, val string")
    wanted = (
        lengths.withColumn("_c", 1 + draw_below(F.least(F.col("num_events"), F.lit(max_events)), F.col("case_id"), "cells"))
        .select(
            "case_id",
            F.explode(
                distinct_places(
                    F.sequence(F.lit(1).cast("bigint"), F.col("num_events")), F.col("_c"), F.col("case_id"), "cell"
                )
            ).alias("pos"),
        )
    )
    names = F.array(*[F.lit(a) for a in sorted(attrs)])
    how_many = 1 + draw_below(min(len(attrs), max_attrs), F.col("case_id"), F.col("pos"), "attrs")
    which = distinct_places(
        F.sequence(F.lit(1), F.lit(len(attrs))), how_many, F.col("case_id"), F.col("pos"), "attr"
    )
    cells = (
        events.select("case_id", "pos", "attrs")
        .join(wanted, ["case_id", "pos"])
        .select("case_id", "pos", "attrs", F.explode(which).alias("i"))
        .select("case_id", "pos", F.element_at(names, F.col("i")).alias("attr"), "attrs")
        .select("case_id", "pos", "attr", F.col("attrs")[F.col("attr")].alias("original"))
        .where(F.col("original").isNotNull())
    )
    # One row per name in ``attrs``, so small by construction.
    sizes = F.broadcast(
        domain.where(F.col("attr").isin(attrs)).groupBy("attr").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    )
    known = domain.select("attr", F.col("val").alias("original"), F.col("idx").alias("old"))
    return (
        cells.join(sizes, "attr")
        .join(known, ["attr", "original"])
        .withColumn(
            "idx",
            (F.col("old") + 1 + F.pmod(draw(F.col("case_id"), F.col("pos"), F.col("attr")), F.col("m") - 1)) % F.col("m"),
        )
        .join(domain, ["attr", "idx"])
        .select("case_id", "pos", "attr", "original", "val")
    )


def exclusive_branches(branches: DataFrame) -> DataFrame:
    """BRANCHES rows of choices with at least two branches that hold an activity."""
    filled = branches.where(F.col("activity").isNotNull())
    kept = (
        filled.select("model_id", "xor_id", "branch_id").distinct()
        .groupBy("model_id", "xor_id").count().where(F.col("count") >= 2).select("model_id", "xor_id")
    )
    return filled.join(kept, ["model_id", "xor_id"], "left_semi")


def exclusive_anomalies(model_traces: DataFrame, branches: DataFrame, per_choice: int = 2) -> DataFrame:
    """Traces that run activities of more than one branch of a choice, two per choice.

    ``model_traces`` holds (model_id, trace). Each chosen trace is set against a different
    branch: part1 is what it runs of that branch, part2 what it runs of the others.
    """
    choices = exclusive_branches(branches)
    traces = (
        model_traces.select("model_id", "trace").distinct()
        .select("model_id", "trace", F.explode(F.array_distinct("trace")).alias("activity"))
    )
    hits = traces.join(choices, ["model_id", "activity"])
    mixed = (
        hits.groupBy("model_id", "xor_id", "trace")
        .agg(F.min("branch_id").alias("b0"), F.max("branch_id").alias("b1"))
        .where(F.col("b0") != F.col("b1"))
        .withColumn("h", order_hash("exclusive", F.col("model_id"), F.col("xor_id"), sized_text(F.col("trace"))))
    )
    by_choice = Window.partitionBy("model_id", "xor_id").orderBy("h")
    chosen = mixed.withColumn("i", F.row_number().over(by_choice)).where(F.col("i") <= per_choice)
    # Choices with fewer than ``per_choice`` such traces give none.
    enough = chosen.groupBy("model_id", "xor_id").count().where(F.col("count") == per_choice)
    chosen = chosen.join(enough.select("model_id", "xor_id"), ["model_id", "xor_id"], "left_semi")
    named = (
        choices.select("model_id", "xor_id", "branch_id").distinct()
        .withColumn("h", order_hash("branch", F.col("model_id"), F.col("xor_id"), F.col("branch_id")))
        .withColumn("i", F.row_number().over(by_choice)).where(F.col("i") <= per_choice)
        .select("model_id", "xor_id", "i", F.col("branch_id").alias("own"))
    )
    parts = (
        chosen.select("model_id", "xor_id", "i", "trace").join(named, ["model_id", "xor_id", "i"])
        .join(choices, ["model_id", "xor_id"])
        .where(F.array_contains("trace", F.col("activity")))
        .groupBy("model_id", "xor_id", "i", "trace")
        .agg(
            F.sort_array(F.collect_set(F.when(F.col("branch_id") == F.col("own"), F.col("activity")))).alias("part1"),
            F.sort_array(F.collect_set(F.when(F.col("branch_id") != F.col("own"), F.col("activity")))).alias("part2"),
        )
    )
    label = normal_label()
    for name, value in (("anomaly", F.lit("Exclusive")), ("part1", F.col("part1")), ("part2", F.col("part2"))):
        label = label.withField(name, value)
    return parts.select("model_id", "xor_id", "i", "trace", label.alias("label"))


def exclusive_rows(model_traces: DataFrame, branches: DataFrame) -> DataFrame:
    """Exclusive anomalies as rows of a sweep: model_id, case_id, kind, round, n, trace and label."""
    found = exclusive_anomalies(model_traces, branches)
    return found.select(
        "model_id", F.concat_ws("-", F.lit("exclusive"), F.col("model_id"), F.col("xor_id"), F.col("i")).alias("case_id"),
        F.lit("Exclusive").alias("kind"), F.col("i").alias("round"), F.size("trace").alias("n"), "trace", "label",
    )


def attribute_log(events: DataFrame, cells: DataFrame, attrs: list[str]) -> DataFrame:
    """EVENTS in which the drawn cells of ``attribute_anomalies`` hold their new value, with a label per case.

    label: anomaly (``Attribute``, or ``normal`` for a case without a cell) and, in order of position and attribute,
    the positions from 0, the places of the attributes among the sorted names, their names and their former values.
    """
    names = F.array(*[F.lit(a) for a in sorted(attrs)]) if attrs else F.array().cast("array<string>")
    new = cells.groupBy("case_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("attr", "val"))).alias("_new"))
    cell = F.struct(
        (F.col("pos") - 1).cast("int").alias("index"), (F.array_position(names, F.col("attr")) - 1).cast("int").alias("attribute_index"),
        F.col("attr").alias("attribute"), "original",
    )
    labels = cells.groupBy("case_id").agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
    changed = F.transform_values("attrs", lambda k, v: F.coalesce(F.col("_new")[k], v))
    none = F.array().cast("array<struct<index:int,attribute_index:int,attribute:string,original:string>>")
    made = F.coalesce("_cells", none)
    label = F.struct(
        F.when(F.size(made) > 0, "Attribute").otherwise("normal").alias("anomaly"), made["index"].alias("index"),
        made["attribute_index"].alias("attribute_index"), made["attribute"].alias("attribute"), made["original"].alias("original"),
    )
    return (
        events.join(new, ["case_id", "pos"], "left").join(labels, "case_id", "left")
        .withColumn("attrs", F.when(F.col("_new").isNull(), F.col("attrs")).otherwise(changed))
        .withColumn("label", label).drop("_new", "_cells")
    )
