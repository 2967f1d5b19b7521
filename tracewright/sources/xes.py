"""All attributes of an XES log, however deeply they are nested: of the log, of its traces and of their events.

Files are cut in front of each trace, so a log of any size is read by many tasks and a task holds one trace at a time. What
stands between traces, mostly before the first one, is the log's own. Comments and texts must not hold ``<trace``.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attribute elements of the standard.
KINDS = ("string", "date", "int", "float", "boolean", "id", "list", "container")
#: Elements of a log that are no attributes of it.
HEADER = ("extension", "global", "classifier", "trace")

NESTED = "scope string, case_id string, pos bigint, path array<string>, place array<int>, type string, value string"


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attributes(element, skip=()):
    """(path, place, type, value) of the attributes below an element, parents first.

    place: which of the attributes of its parent each one is, from 1. One without a key is left out with all it
    holds; ``values`` in a list stands for what it holds.
    """
    waiting = [(element, [], [])]
    while waiting:
        parent, path, place = waiting.pop()
        children = [c for child in parent for c in (child if local(child.tag) == "values" else [child])]
        children = [c for c in children if local(c.tag) in KINDS and local(c.tag) not in skip and c.get("key")]
        found = [(c, [*path, c.get("key")], [*place, k]) for k, c in enumerate(children, 1)]
        for c, p, at in found:
            yield p, at, local(c.tag), c.get("value")
        waiting.extend(reversed(found))


def rows_of(part: str):
    """The NESTED rows of a piece of a file: one trace with what stands behind it, or what stands before the first one."""
    trace, closed, outside = part.partition("</trace>")
    if closed:
        head, _, body = trace.partition(">")
        if head.endswith("/"):  # a trace without content, and no end tag of its own
            trace, outside = "", part[len(head) + 1 :]
        else:
            root = ElementTree.fromstring(f"<trace{head}>{body}</trace>")
            own = list(attributes(root))
            name = next((v for p, _, _, v in reversed(own) if p == ["concept:name"]), None)
            for row in own:
                yield ("trace", name, None, *row)
            events = [e for e in root if local(e.tag) == "event"]
            for pos, event in enumerate(events, 1):
                for row in attributes(event):
                    yield ("event", name, pos, *row)
    else:
        outside = part
    for row in log_rows(outside):
        yield ("log", None, None, *row)


def log_rows(text: str):
    """The attributes in the text between two traces, or around them."""
    start = text.find("<log")
    if start >= 0:
        text = text[text.index(">", start) + 1 :]
    text = text.rpartition("</log>")[0] if "</log>" in text else text
    if text.strip() and "<" in text:
        yield from attributes(ElementTree.fromstring(f"<log>{text.partition('<')[1]}{text.partition('<')[2]}</log>"))


def read_xes_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(scope, case_id, pos, path, place, type, value) of every attribute of an XES log, plain or gzipped.

    scope: ``log``, ``trace`` or ``event``. case_id: the trace's ``concept:name``; pos: the event's number from 1; both are null
    where they don't apply. path: the keys from the outermost attribute to this one. place: which attribute of its parent each
    of these is, so entries of a list that share a key are told apart. value: null where a list or container has none.
    """

    def parse(batches):
        names = [c.split()[0] for c in NESTED.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.string()]
        for batch in batches:
            for part in batch.column("value"):
                found = list(rows_of(part.as_py()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    parts = spark.read.option("lineSep", "<trace").text(path).where(F.trim("value") != "")
    return parts.mapInArrow(parse, NESTED)
