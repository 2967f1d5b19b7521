"""Detection and explanation metrics. Inputs are reduced to counts first; ratios come last."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import running_total


# Patterns of a recorded answer.
VERDICT = r"The trace is (.*?)\.</s>"
CAUSE = r"\\n (.*?)</s>"


def verdict(response: Column) -> Column:
    """First answer ``The trace is ...`` of a response, empty without one."""
    return F.regexp_extract(response, VERDICT, 1)


def valid_verdict(said: Column) -> Column:
    return F.when(said.isin("normal", "anomalous"), said).otherwise("normal")


def stated_cause(response: Column) -> Column:
    """Text between the first backslash-n and the stop mark, empty without one."""
    return F.regexp_extract(response, CAUSE, 1)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(F.lit(0.0))


def binary_metrics(rows: DataFrame, truth: str = "label", predicted: str = "verdict", positive: str = "anomalous") -> DataFrame:
    t, p = F.col(truth) == positive, F.col(predicted) == positive
    counts = rows.agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        (tp + fn).alias("num_anomalous"), (fp + tn).alias("num_normal"),
        (tp + fp).alias("det_anomalous"), (fn + tn).alias("det_normal"),
    )


def weighted_metrics(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Support-weighted precision, recall and F1 from ``true_label, predicted`` (0/1) and weight ``w``."""
    t, p, w = F.col("true_label") == 1, F.col("predicted") == 1, F.col("w")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0))

    counts = outcomes.groupBy(*keys).agg(
        total(t & p).alias("a"), total(~t & p).alias("b"), total(t & ~p).alias("c"), total(~t & ~p).alias("d")
    )
    a, b, c, d = (F.col(x) for x in "abcd")
    n1, n0 = a + c, b + d

    def mean(one, zero):
        return ratio(n1 * one + n0 * zero, n1 + n0)

    return counts.select(
        *keys,
        mean(ratio(a, a + b), ratio(d, d + c)).alias("precision"),
        mean(ratio(a, n1), ratio(d, n0)).alias("recall"),
        mean(ratio(2 * a, 2 * a + b + c), ratio(2 * d, 2 * d + b + c)).alias("f1_score"),
    )


def case_outcomes(verdicts: DataFrame, *keys: str) -> DataFrame:
    return verdicts.groupBy(*keys, "true_label", "predicted").agg(F.count("*").alias("w"))


def type_outcomes(verdicts: DataFrame, *keys: str) -> DataFrame:
    """Outcomes per anomaly type, trimmed and in lower case, without normal and unnamed cases."""
    kind = F.lower(F.trim("anomaly"))
    typed = verdicts.withColumn("anomaly", kind).where(F.col("anomaly").isNotNull() & (F.col("anomaly") != "normal"))
    return case_outcomes(typed, *keys, "anomaly")


def score_counts(rows: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; rows without a score are left out."""
    return (
        rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    )


def roc_auc(rows: DataFrame, keys: list[str], slot, truth: str = "true_label", score: str = "score") -> DataFrame:
    """Area under the ROC curve from average ranks, and how many cases had no score.

    ``slot`` maps the score column to the slots of ``running_total``. Twice the rank sum is a
    whole number, so the result does not depend on the order of summation.
    """
    counts = score_counts(rows, keys, truth, score).withColumn("w", F.col("pos") + F.col("neg"))
    ranked = running_total(counts, keys, slot(F.col("score")), ["score"], F.col("w"), "upto")
    wide = F.col("pos").cast("decimal(18,0)")
    sums = ranked.groupBy(*keys).agg(
        F.sum(wide * (2 * F.col("upto") - F.col("w") + 1).cast("decimal(18,0)")).cast("double").alias("ranks2"),
        F.sum("pos").alias("n1"), F.sum("neg").alias("n0"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    auc = F.when((n1 > 0) & (n0 > 0), (F.col("ranks2") - n1 * (n1 + 1)) / 2 / F.greatest(n1 * n0, F.lit(1.0)))
    blank = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    unscored = rows.groupBy(*keys).agg(F.count_if(blank).alias("unscored"))
    out = sums.select(*keys, auc.alias("roc_auc"), "n1", "n0")
    return out.join(unscored, keys) if keys else out.select("*", unscored.scalar().alias("unscored"))


def precision_recall(rows: DataFrame, keys: list[str], slot, truth: str, score: str) -> DataFrame:
    """Curve points: counting every row with at least this score as positive.

    ``slot`` must grow with the score; the total runs from the highest score down.
    """
    counts = score_counts(rows, keys, truth, score)
    down = -slot(F.col("score"))
    curve = running_total(counts, keys, down, [F.desc("score")], F.col("pos"), "tp")
    curve = running_total(curve, keys, down, [F.desc("score")], F.col("pos") + F.col("neg"), "flagged")
    all_pos = counts.groupBy(*keys).agg(F.sum("pos").alias("n1"))
    curve = curve.join(all_pos, keys) if keys else curve.withColumn("n1", all_pos.scalar())
    return curve.select(
        *keys, "score", "pos", "tp", "flagged", "n1",
        ratio(F.col("tp"), F.col("flagged")).alias("precision"), ratio(F.col("tp"), F.col("n1")).alias("recall"),
    )


def best_f1(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Point with the best F1, the lowest score on ties; an undefined F1 counts as 0."""
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, F.round(2 * p * r / F.greatest(p + r, F.lit(1e-300)), 12)).otherwise(F.lit(0.0))
    best = F.max_by(F.struct(p.alias("precision"), r.alias("recall"), f1.alias("f1"), "score"), F.struct(f1, -F.col("score")))
    return curve.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def average_precision(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of precision times the gain in recall."""
    return curve.groupBy(*keys).agg(F.sum(F.col("precision") * ratio(F.col("pos"), F.col("n1"))).alias("aupr"))


def long_metrics(wide: DataFrame, ids: list[str]) -> DataFrame:
    values = [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, values, "metric", "value")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def _prf(hits: Column, n_hyp: Column, n_ref: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(hits, n_hyp), ratio(hits, n_ref)
    return p, r, F.when(p + r > 0, 2 * p * r / F.greatest(p + r, F.lit(1e-300))).otherwise(F.lit(0.0))


def rouge_2(hypothesis: Column, reference: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F of the distinct word pairs."""
    def pairs(text):
        w = _words(text)
        later = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
        both = F.zip_with(w, later, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.filter(both, lambda x: x.isNotNull()))

    h, r = pairs(hypothesis), pairs(reference)
    return _prf(F.size(F.array_intersect(h, r)), F.size(h), F.size(r))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of words, in Arrow batches.

    One bit for each word of ``b``: a word of ``a`` moves the ends of common subsequences by one addition.
    """
    @F.arrow_udf("int")
    def lengths(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            if x is None or y is None:
                out.append(None)
                continue
            places, whole = {}, (1 << len(y)) - 1
            for i, word in enumerate(y):
                places[word] = places.get(word, 0) | 1 << i
            open_ = whole
            for word in x:
                hit = open_ & places.get(word, 0)
                open_ = ((open_ + hit) | (open_ - hit)) & whole
            out.append(len(y) - open_.bit_count())
        return pa.array(out, pa.int32())

    return lengths(a, b)


def rouge_l(hypothesis: Column, reference: Column) -> tuple[Column, Column, Column]:
    h, r = _words(hypothesis), _words(reference)
    return _prf(lcs_length(h, r), F.size(h), F.size(r))


def mean_scores(rows: DataFrame, scores: tuple[Column, Column, Column], name: str) -> DataFrame:
    p, r, f = scores
    return rows.select(p.alias("p"), r.alias("r"), f.alias("f")).agg(
        F.avg("p").alias(f"{name}_p"), F.avg("r").alias(f"{name}_r"), F.avg("f").alias(f"{name}_f")
    )
