"""Anomaly types of a caller's own, beside those of ``inject``.

A type tells, as Columns, what it draws, how it rewrites the trace and what its label holds, and, if wanted, the target
classes, the short text and the cause that follow from the label. Once registered it goes by its name through
``inject.inject``, ``inject.sweep``, ``labels.targets``, ``labels.label_text`` and ``labels.cause``. All is part of the
same pass over the rows as the other types: no UDF, no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.draws import distinct_places, draw_below


@dataclass(frozen=True)
class Case:
    """What a type sees of a case: its trace, its length and its own draws."""

    trace: Column
    n: Column
    who: tuple[Column, ...]  # keys of every draw: case, type and round
    drawn: Mapping[str, Column]  # what ``Kind.draws`` told before
    names: Column | None = None  # the drawn activities, in ``rewrite`` and ``label``

    def below(self, limit, part: str) -> Column:
        """A whole number in [0, limit), the same for the same case, type, round and ``part``."""
        return draw_below(limit, *self.who, part)

    def places(self, candidates: Column, count: Column, part: str) -> Column:
        """``count`` different entries of an integer array, in ascending order."""
        return distinct_places(candidates, count, *self.who, part)


@dataclass(frozen=True)
class Kind:
    """An anomaly type. Cases shorter than ``shortest`` stay normal.

    draws: names and functions of the case, told in this order, so that a later one may use what was drawn before.
    rewrite: the new trace. label: fields of the label beside ``anomaly``. num_names: how many activities to draw from the
    vocabulary. code, attr_code: from the label and the place of an event (from 0; -1 is the start symbol) to its class
    code, null for a normal one. text, cause: from the label (and the new trace) to a text; without them the text is the
    type's name and the cause null.
    """

    name: str
    shortest: int
    rewrite: Callable[[Case], Column]
    label: Callable[[Case], dict[str, Column]]
    draws: Mapping[str, Callable[[Case], Column]] | None = None
    num_names: Callable[[Case], Column] | None = None
    code: Callable[[Column, Column], Column] | None = None
    attr_code: Callable[[Column, Column], Column] | None = None
    text: Callable[[Column], Column] | None = None
    cause: Callable[[Column, Column], Column] | None = None


_own: dict[str, Kind] = {}


def register(kind: Kind, taken=()) -> None:
    """Make a type known by its name. Names of known types, ``taken`` ones and names with double underscores are refused."""
    if kind.name in _own or kind.name in taken or kind.name in ("normal", "Normal", "Attribute", "Exclusive") or "__" in kind.name:
        raise ValueError(f"the anomaly name {kind.name!r} can't be registered")
    _own[kind.name] = kind


def forget(name: str) -> None:
    _own.pop(name, None)


@contextmanager
def registered(*kinds: Kind, taken=()):
    """Types that are known inside a ``with`` block; plans built there keep them."""
    done = []
    try:
        for kind in kinds:
            register(kind, taken)
            done.append(kind.name)
        yield
    finally:
        for name in done:
            forget(name)


def own() -> dict[str, Kind]:
    """The registered types by name."""
    return dict(_own)


def by_own(kind: Column, value: Callable[[Kind], Column | None], rest: Column) -> Column:
    """``value`` of the registered type that ``kind`` names, else ``rest``; types without a value fall to ``rest``."""
    out = None
    for known in _own.values():
        got = value(known)
        if got is not None:
            out = F.when(kind == known.name, got) if out is None else out.when(kind == known.name, got)
    return rest if out is None else out.otherwise(rest)
