"""Quality rules whose cut-offs come from mergeable quantile sketches per language and source.

Counts of a text are taken in one pass (NumPy over Arrow batches). Four ratios in thousandths are sketched per
(language, source): a sketch is a table of counts by log-linear bucket (16 steps for each power of two, so a quantile
is off by 1/16 at most), and sketches merge by adding counts. That is what ``groupBy().sum()`` does, so a hot source is
summed map-side and no group of rows ever meets in one task. A group with fewer than ``MIN_ROWS`` measured texts takes
the merged sketch of its language, and one whose language is as rare the sketch of everything.

The cut-off of a rule is median + SPREAD * unit. The unit is the lesser of the distances from the median to both quartiles of
the group, so up to half of a group may be junk on one side without moving it. Most ratios are 0 in most texts, and both distances
with them; then the unit is the distance from the median to the 95 % quantile of the language, held between the two ``UNITS``
of the rule, so a language with much junk can't raise it without limit. ``MOST`` keeps a bound under the base rule. The word
length also has a lower bound, told alike from the 5 % quantile. Texts that fail the base rule are not sketched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import fresh
from .textarrays import bounds, chunks, windows

MIN_ROWS = 50
SPREAD = 6
#: Ratio (in thousandths) -> least and greatest unit that a language's tail may give.
UNITS = {"word_length": (150, 300), "symbols": (10, 40), "dup_lines": (30, 41), "repeats": (25, 41)}
#: Ratio -> greatest upper bound: a rule beside the base rule has to say more than that.
MOST = {"dup_lines": 499, "repeats": 499}
#: Name of a quantile -> twentieths.
QUANTILES = {"q05": 1, "q25": 5, "q50": 10, "q75": 15, "q95": 19}
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
COUNT_TYPE = pa.struct([(c, pa.int64()) for c in COUNTS])


def count_chunk(chunk) -> dict[str, np.ndarray]:
    """The counts of every text of a chunk."""
    data, n = chunk.data, chunk.n
    rows, starts, ends = chunk.words()
    sums = chunk.sums()
    at = bounds(rows, n)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    points = np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    # Lines: cut at line feeds and at the ends of texts; only those with a word count.
    feeds = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([chunk.at[:-1], feeds + 1]), kind="stable")
    line_row = np.sort(np.concatenate([np.arange(n), chunk.rows(feeds)]), kind="stable")
    line_end = np.empty_like(line_start)
    line_end[:-1] = np.where(line_row[1:] == line_row[:-1], line_start[1:] - 1, chunk.at[line_row[:-1] + 1])
    line_end[-1:] = chunk.at[-1]
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_row, line_start, line_end = line_row[worded], line_start[worded], line_end[worded]
    line = chunk.hashes(line_start, line_end, sums)
    _, again = repeated(line, line_row)

    tri, tri_row = windows(chunk.hashes(starts, ends, sums), at, 3)
    twice, _ = repeated(tri, tri_row)
    sizes = np.diff(at)
    word_row = np.repeat(np.arange(n), sizes)
    opens = np.flatnonzero(np.arange(len(word_row)) - at[word_row] + 3 <= sizes[word_row])[twice]
    covered = np.zeros(len(word_row), bool)
    for j in range(3):
        covered[opens + j] = True
    return {
        "n_words": sizes,
        "word_chars": points[at[1:]] - points[at[:-1]],
        "n_symbols": chunk.count(symbol[data]),
        "n_dup_lines": np.bincount(line_row[again], minlength=n),
        "n_repeat_words": np.bincount(word_row[covered], minlength=n),
        "n_lines": np.bincount(line_row, minlength=n),
    }


def repeated(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the value occurs twice or more in its row; it occurred earlier in its row."""
    key = values ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later = np.concatenate([[False], same]) if len(key) else np.zeros(0, bool)
    first = np.concatenate([same, [False]]) if len(key) else np.zeros(0, bool)
    twice, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order], again[order] = later | first, later
    return twice, again


def counts(docs: DataFrame, text: str = "text", name: str = "counts") -> DataFrame:
    """``docs`` with a struct of counts per row; a null text has none of anything."""

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS).join(("struct<", ">")).replace(" long", ":long"))
    def counted(texts: pa.Array) -> pa.Array:
        found = [count_chunk(chunk) for _, chunk in chunks(pa.RecordBatch.from_arrays([texts], ["text"]), "text")]
        whole = [np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for c in COUNTS]
        return pa.StructArray.from_arrays([pa.array(x) for x in whole], names=COUNTS)

    # Else a condition on the counts is told before them, by counting every text once more in a second worker of the task.
    return docs.withColumn(name, counted.asNondeterministic()(F.col(text)))


def ratios(c: str) -> dict:
    """Name -> ratio in thousandths (whole numbers) from the struct of counts in column ``c``."""
    of = lambda a, b: F.when(F.col(f"{c}.{b}") > 0, F.expr(f"{c}.{a} * 1000 div {c}.{b}")).otherwise(F.lit(0)).cast("long")
    return {
        "word_length": of("word_chars", "n_words"), "symbols": of("n_symbols", "n_words"),
        "dup_lines": of("n_dup_lines", "n_lines"), "repeats": of("n_repeat_words", "n_words"),
    }


def base_failed(c: str):
    return (F.col(f"{c}.n_words") < 50) | (100 * F.col(f"{c}.n_repeat_words") > 50 * F.col(f"{c}.n_words"))


def bucket(x):
    """Log-linear bucket of a whole number: exact below 16, then 16 steps for each power of two."""
    bits = F.length(F.bin(x)) - 5
    return F.when(x < 16, x).otherwise(bits * 16 + F.expr("shiftright(_x, int(length(bin(_x)) - 5))").cast("long"))


def bucket_top(b):
    """The largest number in a bucket."""
    return F.when(b < 16, b).otherwise(F.expr("shiftleft(_b % 16 + 17, int(_b div 16 - 1)) - 1"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, b, c): counts per bucket. ``measured``: lang, source and a column per rule."""
    long = measured.select(
        "lang", "source",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("_x")) for r in UNITS])).alias("_e"),
    ).select("lang", "source", "_e.rule", "_e._x")
    return long.groupBy("lang", "source", "rule", bucket(F.col("_x")).alias("b")).agg(F.count("*").alias("c"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, n, q05, q25, q50, q75, q95) of merged sketches."""
    merged = sketch.groupBy(*keys, "rule", "b").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*keys, "rule")
    upto = merged.withColumn("upto", F.sum("c").over(w.orderBy("b"))).withColumn("n", F.sum("c").over(w))
    upto = upto.withColumn("_b", F.col("b")).withColumn("top", bucket_top(F.col("_b")))
    at = lambda q: F.min(F.when(F.col("upto") * 20 >= F.col("n") * q, F.col("top")))
    return upto.groupBy(*keys, "rule").agg(F.max("n").alias("n"), *[at(q).alias(name) for name, q in QUANTILES.items()])


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, <rule>_low, <rule>_high): a row for each group, from its own or a merged sketch."""
    sketch = settle(sketches(measured), "sketch")
    own = quantiles(sketch, ["lang", "source"])
    by_lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("_lang"), F.col("rule").alias("_rule"), F.struct("n", *QUANTILES).alias("l"))
    overall = quantiles(sketch, []).select("rule", F.struct(*QUANTILES).alias("a"))
    q = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rule") == F.col("_rule"))).join(overall, "rule")
    merged = lambda x: F.when(F.col("l.n") >= MIN_ROWS, F.col(f"l.{x}")).otherwise(F.col(f"a.{x}"))
    pick = lambda x: F.when(F.col("n") >= MIN_ROWS, F.col(x)).otherwise(merged(x))
    of_rule = lambda values: F.create_map(*[F.lit(v) for kv in values.items() for v in kv])[F.col("rule")]
    least, greatest = (of_rule({r: u[k] for r, u in UNITS.items()}) for k in (0, 1))
    quartile = F.least(pick("q75") - pick("q50"), pick("q50") - pick("q25"))
    unit = lambda tail: F.greatest(quartile, F.least(F.greatest(tail, least), greatest))
    low = pick("q50") - SPREAD * unit(merged("q50") - merged("q05"))
    high = pick("q50") + SPREAD * unit(merged("q95") - merged("q50"))
    q = q.select(
        "lang", "source", "rule", F.when(F.col("rule") == "word_length", low).otherwise(0).alias("low"),
        F.least(high, of_rule(MOST)).alias("high"),
    )
    return q.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rule") == r, F.col(b))).alias(f"{r}_{b}") for r in UNITS for b in ("low", "high")]
    )


def limits(counted: DataFrame, lang: str = "lang", source: str = "source", c: str = "counts") -> DataFrame:
    """(_group, _bound): the bounds of every group of a counted table, written, so that Spark knows their size."""
    measured = counted.where(~base_failed(c)).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"), *[v.alias(k) for k, v in ratios(c).items()]
    )
    found = thresholds(measured)
    bound = F.struct(*[x for x in found.columns if x not in ("lang", "source")])
    return settle(found.select(F.struct("lang", "source").alias("_group"), bound.alias("_bound")), "limits")


def verdicts(counted: DataFrame, bounds: DataFrame, lang: str = "lang", source: str = "source", c: str = "counts", kept: str = "kept") -> DataFrame:
    """``counted`` with a boolean ``kept``: false if the base rule or any adaptive rule fails.

    The table of bounds is joined by broadcast only where its files are small enough for that.
    """
    group, of, bound = F.struct(F.col(lang).alias("lang"), F.col(source).alias("source")), fresh(counted, "_group"), fresh(counted, "_bound")
    fine = ~base_failed(c)
    for k, r in ratios(c).items():
        fine = fine & r.between(F.col(f"{bound}.{k}_low"), F.col(f"{bound}.{k}_high"))
    bounds = bounds.select(F.col("_group").alias(of), F.col("_bound").alias(bound))
    joined = counted.join(bounds, group.eqNullSafe(F.col(of)), "left")
    return joined.withColumn(kept, F.coalesce(fine, F.lit(False))).drop(of, bound)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that pass, with the columns they came with.

    A null or empty text has no words and fails the base rule. Null languages and sources form groups of their own.
    Repeated rows are judged alike, each on its own; an empty table gives an empty one. Texts are counted twice, for
    the bounds and for the verdict, as that costs less than carrying them through a written table.
    """
    c, kept = fresh(docs, "counts"), fresh(docs, "kept")
    slim = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    bounds = limits(counts(slim).drop("text"))
    return verdicts(counts(docs, text, c), bounds, lang, source, c, kept).where(F.col(kept)).drop(c, kept)
