"""Language identification by word-first backoff.

A word that the model knows scores its logarithmic frequency in each language. Any other word falls back to its
character n-grams (edges included): the longest length at which any n-gram is known gives the mean of the known ones.
A text scores the mean over its words. A word is a run of letters, in lower case.

The model is fitted on at most about ``SAMPLE_ROWS`` rows of each language, chosen by a hash of id and text. ``ENTRIES`` words and
as many n-grams of each length are dealt out evenly: every language gives its own most frequent ones (seen twice at
least), however many rows the others have. So what is broadcast is bounded by ENTRIES * (LONGEST + 1) rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .letters import find, letter_chunks

SAMPLE_ROWS = 2_000
ENTRIES = 100_000
LONGEST = 5
#: log10 frequency of what a language has never shown.
UNSEEN = -7.0
#: A score tells the posterior of this many words at most, so that it doesn't run to 1 with the length.
EVIDENCE = 20
UNKNOWN = "und"


class Model:
    """Sorted hashes and a row of log frequencies (one per language) for words (0) and n-grams (1 .. LONGEST)."""

    def __init__(self, langs: list[str], keys: list[np.ndarray], logs: list[np.ndarray]):
        self.langs, self.keys, self.logs = langs, keys, logs

    def scores(self, letters) -> np.ndarray:
        """Mean log frequency of every text in each language; NaN for a text without a letter."""
        hashes, first, which = letters.words()
        logs = np.full((len(hashes), len(self.langs)), UNSEEN)
        place, known = find(self.keys[0], hashes)
        logs[known] = self.logs[0][place[known]]
        rest = np.flatnonzero(~known)
        for width in range(LONGEST, 0, -1):
            if not len(rest):
                break
            gram, word = letters.grams(first[rest], width)
            place, there = find(self.keys[width], gram)
            word, place = word[there], place[there]
            n = np.bincount(word, minlength=len(rest))
            for k in range(len(self.langs)):
                total = np.bincount(word, self.logs[width][place, k], minlength=len(rest))
                logs[rest[n > 0], k] = total[n > 0] / n[n > 0]
            rest = rest[n == 0]
        n = np.bincount(letters.rows, minlength=letters.n)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.stack([np.bincount(letters.rows, logs[which, k], minlength=letters.n) / n for k in range(len(self.langs))], 1)

    def predict(self, letters) -> tuple[list[str], np.ndarray]:
        """Best language (the first of equals) and its posterior for every text."""
        n = np.minimum(np.bincount(letters.rows, minlength=letters.n), EVIDENCE)
        if not self.langs:
            return [UNKNOWN] * letters.n, np.zeros(letters.n)
        s = self.scores(letters)
        none = np.isnan(s[:, 0])
        s[none] = 0
        best = s.argmax(1)
        odds = np.exp((s - s.max(1, keepdims=True)) * np.log(10) * n[:, None])
        lang = [UNKNOWN if z else self.langs[b] for z, b in zip(none.tolist(), best.tolist())]
        return lang, np.where(none, 0.0, 1 / odds.sum(1))


def sample(rows: DataFrame, lang: str, doc_id: str, text: str, most: int = SAMPLE_ROWS) -> DataFrame:
    """About ``most`` rows of each language at most, by a hash of id and text; the same ones in every run.

    Rows that repeat an id, or have none, are drawn each by their text; only copies of a whole row are taken together.
    """
    # Written first, so that Spark knows that it is small and no text is shuffled for it.
    sizes = settle(rows.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n")), "langs")
    share = F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit("language sample")), F.lit(1 << 20)) / float(1 << 20)
    return rows.join(sizes, F.col(lang) == F.col("_lang")).where(share * F.col("_n") < most).drop("_lang", "_n")


def gram_counts(batches):
    """(lang, width, h, c) of a few texts at a time; width 0 stands for whole words."""
    for batch in batches:
        for rows, letters in letter_chunks(batch, "text"):
            names, lang = np.unique(np.asarray(rows.column("lang").to_pylist(), object), return_inverse=True)
            hashes, first, which = letters.words()
            of_word = lang[letters.rows]
            for k, name in enumerate(names):
                c = np.bincount(which[of_word == k], minlength=len(hashes))
                own = np.flatnonzero(c)
                for width in range(LONGEST + 1):
                    if width:
                        h, word = letters.grams(first[own], width)
                        h, back = np.unique(h, return_inverse=True)
                        n = np.bincount(back, c[own][word], minlength=len(h)).astype(np.int64)
                    else:
                        h, n = hashes[own], c[own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(name)] * len(h), pa.string()), pa.array(np.full(len(h), width, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "width", "h", "c"],
                    )


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """A model of the languages of ``rows``; rows without a text or a language are left out."""
    learn = rows.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    learn = learn.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    grams = (
        sample(learn, "lang", "doc_id", "text").mapInArrow(gram_counts, "lang string, width int, h long, c long")
        .groupBy("lang", "width", "h").agg(F.sum("c").alias("c"))
    ).persist()
    try:
        totals = {(r.width, r.lang): r.c for r in grams.groupBy("width", "lang").agg(F.sum("c").alias("c")).collect()}
        langs = sorted({k[1] for k in totals})
        often = grams.where(F.col("c") > 1)
        turn = F.row_number().over(Window.partitionBy("width", "lang").orderBy(F.desc("c"), "h"))
        own = often.withColumn("turn", turn).where(F.col("turn") <= max(1, ENTRIES // max(1, len(langs))))
        kept = settle(often.join(own.select("width", "h").distinct(), ["width", "h"], "left_semi"), "entries")
        keys, logs = [], []
        for width in range(LONGEST + 1):
            top = kept.where(F.col("width") == width).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by"))
            got = top.select("h", *[F.coalesce(F.col("by")[x], F.lit(0)).alias(f"c{i}") for i, x in enumerate(langs)]).toArrow()
            h = np.asarray(got["h"].combine_chunks()).view(np.uint64)
            order = np.argsort(h)
            with np.errstate(divide="ignore"):
                log = [np.maximum(UNSEEN, np.log10(np.asarray(got[f"c{i}"].combine_chunks()) / totals.get((width, x), 1))) for i, x in enumerate(langs)]
            keys.append(h[order])
            logs.append(np.stack(log, 1)[order].astype(np.float32) if langs else np.zeros((0, 0), np.float32))
    finally:
        grams.unpersist()
    return Model(langs, keys, logs)


def predicted(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct (lang, score) for each row of ``docs``: ``und`` and 0 for a null text or one without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.keys, model.logs))

    @F.arrow_udf("struct<lang:string,score:double>")
    def identify(texts: pa.Array) -> pa.Array:
        known, lang, score = Model(*shared.value), [], [np.zeros(0)]
        for _, letters in letter_chunks(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            one, p = known.predict(letters)
            lang += one
            score.append(p)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score))], names=["lang", "score"])

    return identify(F.col(text))
