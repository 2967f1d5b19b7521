"""What an anomaly label says: target classes per event, a short text and a cause sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kinds import by_own

# Class codes of an event.
CLASS_CODES = {
    "Normal Attribute": -1,
    "Normal": 0,
    "Anomaly": 1,
    "Insert": 2,
    "Skip": 3,
    "Rework": 4,
    "Early": 5,
    "Late": 6,
    "Shift": 7,
    "Replace": 8,
    "Attribute": 9,
}


def targets(injected: DataFrame) -> DataFrame:
    """Class code per row of the matrix form (row 0 is the start symbol, row n + 1 the end).

    ``code`` is the class of the activity, ``attr_code`` that of the event's attributes. Registered types tell theirs.
    """
    l = F.col("label")
    kind, size = l["anomaly"], l["size"]

    def codes(row: Column) -> Column:
        i = row - 1  # position in the trace from 0
        moved = (i >= l["shift_to"]) & (i < l["shift_to"] + size)
        known = (
            F.when((kind == "SkipSequence") & (i == l["start"]), CLASS_CODES["Skip"])
            .when((kind == "Rework") & (i >= l["start"]) & (i < l["start"] + size), CLASS_CODES["Rework"])
            .when((kind == "Early") & moved, CLASS_CODES["Early"])
            .when((kind == "Late") & moved, CLASS_CODES["Late"])
            .when(kind.isin("Early", "Late") & (i == l["shift_from"]), CLASS_CODES["Shift"])
            .when((kind == "Insert") & F.array_contains(l["indices"], i), CLASS_CODES["Insert"])
            .when((kind == "Replace") & F.array_contains(l["indices"], i), CLASS_CODES["Replace"])
            .when((kind == "Skip") & F.array_contains(l["indices"], i), CLASS_CODES["Skip"])
            .when((kind == "SkipAndInsert") & F.array_contains(l["skips"], i), CLASS_CODES["Skip"])
            .when((kind == "SkipAndInsert") & F.array_contains(l["inserts"], i), CLASS_CODES["Insert"])
            .otherwise(CLASS_CODES["Normal"])
        )
        normal = F.lit(CLASS_CODES["Normal"])
        return by_own(kind, lambda t: t.code and F.coalesce(t.code(l, i).cast("int"), normal), known)

    def attr_codes(row: Column) -> Column:
        i = row - 1
        changed = (kind.isin("Insert", "Replace") & F.array_contains(l["indices"], i)) | (
            (kind == "SkipAndInsert") & F.array_contains(l["inserts"], i)
        )
        normal = F.lit(CLASS_CODES["Normal"])
        known = F.when(changed, CLASS_CODES["Attribute"]).otherwise(normal)
        return by_own(kind, lambda t: t.attr_code and F.coalesce(t.attr_code(l, i).cast("int"), normal), known)

    return injected.select(
        "case_id", "kind", "round", "label", F.explode(F.sequence(F.lit(0), F.size("trace") + 1)).alias("event_position")
    ).select(
        "case_id", "kind", "round", "event_position",
        codes(F.col("event_position")).alias("code"), attr_codes(F.col("event_position")).alias("attr_code"),
    )


def attribute_targets(cells: DataFrame, attrs: list[str]) -> DataFrame:
    """Cells of the target matrix that hold a changed attribute; column 0 is the activity."""
    names = F.array(*[F.lit(a) for a in sorted(attrs)])
    return cells.select(
        "case_id", F.col("pos").alias("event_position"),
        F.array_position(names, F.col("attr")).cast("int").alias("column"), F.lit(CLASS_CODES["Attribute"]).alias("code"),
    )


def _listed(values: Column, sep: str = ", ") -> Column:
    return F.array_join(values, sep)


def _from_one(indices: Column) -> Column:
    return F.array_join(F.transform(indices, lambda i: (i + 1).cast("string")), ", ")


def label_text(label: Column) -> Column:
    """One-line text of a label."""
    kind = label["anomaly"]
    place = (label["start"] + 1).cast("string")
    sequence = F.concat(kind, F.lit(" "), _listed(label["acts"]), F.lit(" at "), place)
    shift = F.format_string(
        "%s %d from %d to %d", kind, label["size"], label["shift_from"] + 1, label["shift_to"] + 1
    )
    known = (
        F.when(kind.isin("SkipSequence", "Rework"), sequence)
        .when(kind.isin("Early", "Late"), shift)
        .when(kind.isin("Replace", "Skip"), F.concat(kind, F.lit(" "), _listed(label["acts"]), F.lit(" at "), _from_one(label["indices"])))
        .when(kind == "Insert", F.concat(F.lit("Insert at "), _from_one(label["indices"])))
        .when(
            kind == "SkipAndInsert",
            F.concat(
                F.lit("SkipAndInsert skip "), _listed(label["acts"]), F.lit(" at "), _from_one(label["skips"]),
                F.lit(" and insert at "), _from_one(label["inserts"]),
            ),
        )
        .otherwise("Normal")
    )
    return by_own(kind, lambda t: t.text(label) if t.text else F.lit(t.name), known)


def attribute_label_text(cells: DataFrame) -> DataFrame:
    """Text of the attribute anomaly of each case."""
    def quoted(c):
        return F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))

    steps = F.sort_array(F.collect_list(F.struct("pos", "attr", "original")))
    places = F.array_join(F.transform(F.col("s.pos"), lambda p: p.cast("string")), ", ")
    return cells.groupBy("case_id").agg(steps.alias("s")).select(
        "case_id",
        F.concat(
            F.lit("Attribute "), quoted(F.col("s.attr")), F.lit(" at ["), places, F.lit("] was "), quoted(F.col("s.original"))
        ).alias("label_text"),
    )


def _quoted_pair(acts: Column) -> Column:
    """``a' and 'b`` or ``a','b' and 'c``: the inner part of a quoted list of at least two."""
    head = F.array_join(F.slice(acts, 1, F.greatest(F.size(acts) - 1, F.lit(0))), "','")
    return F.concat(head, F.lit("' and '"), F.element_at(acts, -1))


# Wording of the causes; one activity, several activities.
CAUSE_WORDING = {
    "SkipSequence": ("The activity '%s' is skipped before '%s'.", "The activities '%s' are skipped before '%s'."),
    "Rework": ("The activity '%s' is reworked after '%s'.", "The activities '%s' are reworked after '%s'."),
    "Early": (
        "The activity '%s' is executed too early, it should be executed after '%s'.",
        "The activities '%s' are executed too early, they should be executed after '%s'.",
    ),
    "Late": (
        "The activity '%s' is executed too late, it should be executed before '%s'.",
        "The activities '%s' are executed too late, they should be executed before '%s'.",
    ),
    "Insert": ("The activity '%s' should not be executed.", "The activities '%s' should not be executed."),
    "Exclusive": (
        "The %s '%s' %s mutually exclusive with the %s '%s', meaning they should not be executed within the same "
        "process instance.",
    ),
}


def cause(label: Column, trace: Column) -> Column:
    """Why the trace is anomalous, as a sentence; null for types without a wording."""
    kind = label["anomaly"]
    acts = (
        F.when(kind.isin("SkipSequence", "Rework"), label["acts"])
        .when(kind.isin("Early", "Late"), F.slice(trace, label["shift_to"] + 1, label["size"]))
        .when(kind == "Insert", F.transform(label["indices"], lambda i: F.element_at(trace, i + 1)))
    )
    mark = (
        F.when(kind == "SkipSequence", label["start"])
        .when(kind == "Rework", label["start"] - 1)
        .when(kind == "Early", label["shift_from"] - 1)
        .when(kind == "Late", label["shift_from"])
    )
    neighbour = F.get(trace, mark)
    named = F.when(F.size(acts) > 1, _quoted_pair(acts)).when(F.size(acts) == 1, F.element_at(acts, 1))

    def worded(name):
        one, many = CAUSE_WORDING[name]
        args = [named] if name == "Insert" else [named, neighbour]
        return F.when(F.size(acts) == 1, F.format_string(one, *args)).otherwise(F.format_string(many, *args))

    def part(values):
        several = F.size(values) > 1
        noun = F.when(several, "activities").otherwise("activity")
        text = F.when(several, _quoted_pair(values)).when(F.size(values) == 1, F.element_at(values, 1)).otherwise("[Unknown]")
        return noun, text, F.when(several, "are").otherwise("is")

    noun1, text1, verb = part(label["part1"])
    noun2, text2, _ = part(label["part2"])
    out = F.when(
        kind == "Exclusive", F.format_string(CAUSE_WORDING["Exclusive"][0], noun1, text1, verb, noun2, text2)
    )
    for name in ("SkipSequence", "Rework", "Early", "Late", "Insert"):
        out = out.when(kind == name, worded(name))
    return by_own(kind, lambda t: t.cause and t.cause(label, trace), out)
