"""Reproducible draws: a draw is a function of the seed and the row's own keys.

The text ``seed|key|...`` is hashed with md5, so a retry, another partitioning or another
SQL engine makes the same choice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = "7"


def _text(keys) -> Column:
    return F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])


def sized_text(names: Column) -> Column:
    """An array of texts as one text that no other array gives: each entry after its length, a null as a dash."""
    entry = lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return F.array_join(F.transform(names, entry), "")


def order_hash(*keys) -> Column:
    """A 32-character hash that orders rows at random but always alike."""
    return F.md5(_text((SEED, *keys)))


def draw(*keys) -> Column:
    """A whole number in [0, 2**32)."""
    return F.conv(F.substring(order_hash(*keys), 1, 8), 16, 10).cast("bigint")


def draw_below(n, *keys) -> Column:
    """A whole number in [0, n); n below one counts as one."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(draw(*keys), F.greatest(n.cast("bigint"), F.lit(1))).cast("int")


def distinct_places(candidates: Column, count: Column, *keys) -> Column:
    """``count`` different entries of an integer array, in ascending order."""
    ranked = F.sort_array(
        F.transform(candidates, lambda p: F.struct(order_hash(*keys, p).alias("h"), p.alias("p")))
    )
    return F.sort_array(F.transform(F.slice(ranked, 1, count), lambda s: s.p))
