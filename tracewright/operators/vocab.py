"""Activity vocabularies, and looking up drawn entries in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered

# Vocabularies up to this size travel inside the plan; larger ones are joined.
INLINE_WORDS = 5_000


def vocabulary(events: DataFrame) -> DataFrame:
    """Sorted activity names with their index from 0: ``idx bigint, activity string``."""
    names = events.select("activity").where(F.col("activity").isNotNull()).distinct()
    ranked = numbered(names, [], None, ["activity"], "idx")
    return ranked.select((F.col("idx") - 1).alias("idx"), "activity")


class Lookup:
    """Turns arrays of drawn numbers into activities.

    A vocabulary with at most ``inline`` names becomes an array literal, so no row moves.
    Beyond that the numbers are exploded and joined to the vocabulary table.
    """

    def __init__(self, words: DataFrame, inline: int = INLINE_WORDS):
        self.words = words
        # Entry i holds the name with index i. One row over the limit is enough to know.
        head = words.limit(inline + 1).collect()
        self.inline = [r.activity for r in sorted(head, key=lambda r: r.idx)] if len(head) <= inline else None

    @property
    def size(self) -> Column:
        """Number of names, as a column."""
        if self.inline is not None:
            return F.lit(len(self.inline)).cast("bigint")
        return self.words.agg(F.count("*").alias("c")).scalar()

    def fill(self, df: DataFrame, key: list[str], draws: str, out: str) -> DataFrame:
        """Add ``out``, the names for the array of raw draws in ``draws``; ``key`` identifies a row."""
        wanted = F.transform(draws, lambda d: F.pmod(d, self.size))
        if self.inline is not None:
            names = F.array(*[F.lit(w) for w in self.inline])
            return df.withColumn(out, F.transform(wanted, lambda i: F.element_at(names, (i + 1).cast("int"))))
        asked = df.withColumn("_n", self.size).select(
            *key, F.posexplode(F.transform(draws, lambda d: F.pmod(d, F.col("_n")))).alias("_p", "idx")
        )
        found = (
            asked.join(self.words, "idx")
            .groupBy(*key)
            .agg(F.sort_array(F.collect_list(F.struct("_p", "activity"))).alias("_f"))
            .select(*key, F.col("_f.activity").alias(out))
        )
        none = F.array().cast("array<string>")
        return df.join(found, key, "left").withColumn(out, F.coalesce(F.col(out), none))
