"""Normalisation of activity and model labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_breaks(label: Column) -> Column:
    """Line breaks to blanks, carriage returns and surrounding blanks removed."""
    return F.trim(F.replace(F.replace(label, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")))


def shape_text(label: Column) -> Column:
    """Line breaks to blanks, carriage returns removed, double blanks made single once."""
    flat = F.replace(F.replace(label, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    return F.replace(flat, F.lit("  "), F.lit(" "))


# Where camel case is opened.
CAMEL = ["(.)([A-Z][a-z]+)", "([a-z0-9])([A-Z])"]

# Generic names, and what structural names hold or begin with.
GENERIC = ["message", "task"]
STRUCTURAL_PART = "Gateway"
STRUCTURAL_BEGINNINGS = ["EventSubprocess", "Subprocess"]


def sanitize_label(label: Column) -> Column:
    """Letters only, single-letter parts dropped, camel case opened, lower case."""
    text = F.replace(F.replace(label, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    text = F.regexp_replace(F.replace(text, F.lit("(s)"), F.lit("s")), "[^a-zA-Z]", " ")
    text = F.array_join(F.filter(F.split(text, " +"), lambda part: F.length(part) > 1), " ")
    for place in CAMEL:
        text = F.regexp_replace(text, place, "$1 $2")
    return F.lower(text)


def label_words(label: Column) -> Column:
    """Words of a label, parted at every character that is no letter, with -ise spelt -ize."""
    return F.transform(F.split(F.lower(label), "[^a-z]"), lambda w: F.regexp_replace(w, "ise$", "ize"))


def is_relevant_label(label: Column) -> Column:
    """Whether a label names a task: null counts, blank, number, generic and structural names do not."""
    named = (label != "") & ~label.rlike(r"^\p{N}+$") & ~F.lower(label).isin(GENERIC) & ~label.contains(STRUCTURAL_PART)
    for beginning in STRUCTURAL_BEGINNINGS:
        named = named & ~label.startswith(beginning)
    return label.isNull() | named


def collapse_blanks(label: Column) -> Column:
    return F.trim(F.regexp_replace(label, r"\s+", " "))


def clean_glossary(link: Column) -> Column:
    """Bare glossary ids of a link text: brackets, quotes and the path part removed."""
    return F.regexp_replace(F.replace(link, F.lit("/glossary/"), F.lit("")), r"""[\[\]'"]""", "")
