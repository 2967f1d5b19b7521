"""What several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever an operator counts words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; ids that are null count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Ends:
    """Where the elements of a page end."""

    def __init__(self, page: str):
        self.page, self.tags, self.never = page, {}, set()

    def behind(self, name: str, start: int) -> int | None:
        """The place behind the first end tag of ``name`` from ``start`` on, None without one. Starts never decrease."""
        if name in self.never:
            return None
        tag = self.tags.get(name) or self.tags.setdefault(name, re.compile(rf"</{name}(?:[\s/][^>]*)?(?:>|\Z)", re.I))
        found = tag.search(self.page, start)
        if found is None:
            self.never.add(name)
        return found and found.end()
