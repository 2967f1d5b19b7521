"""Anomaly detection on prefixes: one reconstruction model and threshold per prefix length.

The frequency model reconstructs every position of a prefix of length k by the activity shares
seen at that position in the training prefixes of length k. All counts are whole numbers, so a
score does not depend on the order of summation.

Scores depend on the trace only. Traces are therefore scored once per variant, however many
cases follow it, and cases pick up the result of their variant.

``keys`` name columns that tell several logs or runs in one table apart (say ``dataset`` and ``run``): each of them is
worked as if it were alone, in one plan for all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import order_hash, sized_text
from ..functions.ordering import edge_rows, hash_slot, running_total, slot_edges
from ..session import settle

# Candidate percentiles for a threshold.
PERCENTILES = range(80, 100)

# Errors are rounded to 9 digits, so a slot of 1/65,536 holds at most 15,259 different errors.
ERROR_SLOTS = 65_536


def noise(prefix_len: Column, factor: float = 0.3) -> Column:
    """Noise deviation used for a prefix length."""
    return F.least(F.lit(float(factor)), F.lit(0.3) / F.greatest(F.lit(1.0), prefix_len / 3))


def tail_size(n: Column) -> Column:
    """Size of the validation tail of n samples."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(n.cast("double") * 0.1))


def sample_hash() -> Column:
    """Order of the training samples. Rows have no file order; this one is even and repeatable."""
    return order_hash("sample", F.col("case_id"))


def tail_cuts(train: DataFrame, keys=()) -> DataFrame:
    """Per prefix length: ``cut``, the last hash before the tail, ``n`` samples, ``n_fit`` before it.

    Length 1 has every case as a sample. Counts per (case length, slot) are summed over the longer
    cases after aggregation, and only the slot that holds a cut is ranked.
    """
    rows = train.where(F.col("n") > 0).select(*keys, "n", sample_hash().alias("h")).withColumn("_slot", hash_slot(F.col("h")))
    counts = rows.groupBy(*keys, "n", "_slot").agg(F.count("*").alias("c"))
    totals = over_longer(counts, [*keys, "_slot"], F.lit(0)).select(*keys, "prefix_len", "_slot", F.col("c").alias("_c"))
    edge = slot_edges(totals, [*keys, "prefix_len"], lambda n: n - tail_size(n))
    near = rows.withColumnRenamed("n", "len").join(edge, [*keys, "_slot"]).where(F.col("len") >= F.col("prefix_len"))
    return edge_rows(near, [*keys, "prefix_len"], "h").withColumn("n_fit", F.col("n") - tail_size(F.col("n")))


def over_longer(counts: DataFrame, keys: list[str], above: Column) -> DataFrame:
    """(prefix_len, keys, c) from counts ``c`` per case length ``n`` and keys: sums over the cases of at least that length.

    For every prefix length over ``above``. Between two lengths that occur the sum is the same, so each row is
    spread only over the lengths down to the next one.
    """
    longest_first = Window.partitionBy(*keys).orderBy(F.desc("n"))
    summed = counts.withColumn("_sum", F.sum("c").over(longest_first)).withColumn("_next", F.coalesce(F.lead("n").over(longest_first), F.lit(0)))
    low = F.greatest(F.col("_next"), above) + 1
    spread = summed.where(low <= F.col("n")).withColumn("prefix_len", F.explode(F.sequence(low, F.col("n"))))
    return spread.select("prefix_len", *keys, F.col("_sum").alias("c"))


def samples(train: DataFrame, cuts: DataFrame, *keep: str | Column, keys=()) -> DataFrame:
    """(case, prefix length) with ``in_tail``; lengths without a model are left out."""
    return (
        train.select("*", sample_hash().alias("h"))
        .select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("prefix_len"))
        .join(cuts.select(*keys, "prefix_len", "cut"), [*keys, "prefix_len"])
        .select(*keys, "case_id", "prefix_len", (F.col("h") > F.col("cut")).alias("in_tail"), *keep)
    )


def position_runs(train: DataFrame, cuts: DataFrame, keys=()) -> DataFrame:
    """MODEL: ``keys, pos, activity, since, until, c, d`` over the training samples before the tail.

    ``c`` samples of each prefix length from ``since`` to ``until`` have the activity at ``pos``; ``d`` is how many more
    these are than at the length before. A count changes only where a case ends or goes into or out of the tail, so there
    is a row for each change, not for each length. The tenth of the samples in the tail is taken off again.
    """
    change = lambda k, d: F.struct(k.cast("int").alias("since"), d.cast("bigint").alias("d"))
    place = [*keys, "pos", "activity"]
    ended = (
        train.select(*keys, "n", F.posexplode("trace").alias("p", "activity"))
        .groupBy(*keys, "n", "p", "activity").agg(F.count("*").alias("c")).withColumn("pos", F.col("p") + 1)
        .select(*place, F.explode(F.array(change(F.col("pos"), F.col("c")), change(F.col("n") + 1, -F.col("c")))).alias("x"))
    )
    # Lengths at which a sample is in the tail, as stretches of consecutive ones.
    hashed = train.where(F.col("n") > 0).select(*keys, "n", "trace", sample_hash().alias("h"))
    within = Window.partitionBy(*keys, "h").orderBy("prefix_len")
    stretches = (
        hashed.groupBy(*keys, "h").agg(F.max("n").alias("n"))
        .select(*keys, "h", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("prefix_len"))
        .join(cuts.select(*keys, "prefix_len", "cut"), [*keys, "prefix_len"]).where(F.col("h") > F.col("cut"))
        .withColumn("_island", F.col("prefix_len") - F.row_number().over(within))
        .groupBy(*keys, "h", "_island").agg(F.min("prefix_len").alias("k1"), F.max("prefix_len").alias("k2"))
    )
    last = F.least("k2", "n")
    tail = (
        hashed.join(stretches, [*keys, "h"]).where(F.col("k1") <= F.col("n"))
        .select(*keys, "k1", last.alias("k2"), F.posexplode(F.slice("trace", F.lit(1), last)).alias("p", "activity"))
        .withColumn("pos", F.col("p") + 1)
        .select(*place, F.explode(F.array(change(F.greatest("k1", "pos"), F.lit(-1)), change(F.col("k2") + 1, F.lit(1)))).alias("x"))
    )
    changes = ended.unionByName(tail).groupBy(*place, "x.since").agg(F.sum("x.d").alias("d")).where(F.col("d") != 0)
    along = Window.partitionBy(*place).orderBy("since")
    runs = changes.withColumn("c", F.sum("d").over(along)).withColumn("until", F.lead("since").over(along) - 1)
    # Behind the last length with a model nothing is taken off, and nothing is asked for.
    lengths = cuts.select(*keys, F.col("prefix_len").alias("since"))
    return runs.join(lengths, [*keys, "since"], "left_semi").select(*place, "since", "until", "c", "d")


def with_tid(cases: DataFrame) -> DataFrame:
    """``cases`` with ``tid``, 128 bits of hash of the trace: told in the row, so traces need not be joined on."""
    return cases.withColumn("tid", F.md5(sized_text(F.col("trace"))))


def variant_table(cases: DataFrame, keys=()) -> DataFrame:
    """``keys, tid, trace, n``: every distinct trace once."""
    return with_tid(cases).groupBy(*keys, "tid").agg(F.any_value("trace").alias("trace"), F.any_value("n").alias("n"))


def prefix_paths(variants: DataFrame, keys=(), keep=()) -> DataFrame:
    """``keys, tid, n, keep, pos, activity, node``: the way of every variant down the tree of prefixes.

    ``node`` is 128 bits of hash of the events so far: equal for variants that share the prefix. The hash of an event is
    that of its place and activity, and a node is the exclusive or of them, so it is told along the trace in one pass.
    """
    down = Window.partitionBy(*keys, "tid").orderBy("pos")
    half = lambda seed: F.lpad(F.hex(F.bit_xor(F.xxhash64(F.lit(seed), "pos", "activity", F.isnull("activity"))).over(down)), 16, "0")
    events = variants.select(*keys, "tid", "n", *keep, F.posexplode("trace").alias("p", "activity")).withColumn("pos", F.col("p") + 1).drop("p")
    return events.withColumn("node", F.concat(half(1), half(2)))


def prefix_tree(cases: DataFrame, keys=()) -> DataFrame:
    """NODES of the prefix tree: ``keys, node, parent, depth, activity, cases, ends, children``.

    One row for each different prefix of the traces. ``cases`` have the prefix, ``ends`` of them no event after it;
    ``parent`` is null for the first event. Cases are counted by variant before anything is spread; a variant's own row
    has its number of cases, so a prefix that many cases share is one sum, taken before the shuffle too.
    """
    counted = with_tid(cases).groupBy(*keys, "tid").agg(F.any_value("trace").alias("trace"), F.any_value("n").alias("n"), F.count("*").alias("w"))
    paths = prefix_paths(counted, keys, ["w"])
    down = Window.partitionBy(*keys, "tid").orderBy("pos")
    nodes = (
        paths.withColumn("parent", F.lag("node").over(down)).groupBy(*keys, "node", "parent", F.col("pos").alias("depth"), "activity")
        .agg(F.sum("w").alias("cases"), F.sum(F.when(F.col("pos") == F.col("n"), F.col("w")).otherwise(0)).alias("ends"))
    )
    below = nodes.where("parent is not null").groupBy(*keys, F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    return nodes.join(below, [*keys, "node"], "left").withColumn("children", F.coalesce("children", F.lit(0)))


@dataclass
class FrequencyModel:
    runs: DataFrame  # keys, pos, activity, since, until, c, d; settled
    norms: DataFrame  # keys, prefix_len, n_fit, squares: sum of squared counts, size of the vocabulary; settled
    vocabulary: DataFrame  # keys, activity of the training cases; settled
    encoding: str = "onehot"
    keys: tuple = ()

    @cached_property
    def counts(self) -> DataFrame:
        """``keys, prefix_len, pos, activity, c``: the runs spread over their lengths."""
        spread = self.runs.where(F.col("c") > 0).select(
            *self.keys, F.explode(F.sequence("since", "until")).alias("prefix_len"), "pos", "activity", "c"
        )
        return settle(spread.join(self.norms.select(*self.keys, "prefix_len"), [*self.keys, "prefix_len"], "left_semi"))

    def score(self, variants: DataFrame) -> DataFrame:
        """(keys, tid, prefix_len, score): mean squared reconstruction error, 9 digits.

        For an event x with share p_x the squared error over the vocabulary is
        1 - 2 p_x + sum of all p_b squared; an unknown event is a zero vector and has only the sum.

        The counts hit by a prefix are a running sum down its trace: of what each event adds at its own length and of
        what the counts of the events before change there. A prefix that several variants share is a node of one of
        them, its owner; only there are the changes looked up.
        """
        keys = [*self.keys]
        paths = prefix_paths(variants, keys)
        owners = paths.groupBy(*keys, "node").agg(F.min("tid").alias("owner"))
        # What a variant owns is the end of it: whoever is the first at a prefix is so at all longer ones.
        first = F.min(F.when(F.col("owner") == F.col("tid"), F.col("pos"))).over(Window.partitionBy(*keys, "tid"))
        paths = settle(paths.join(owners, [*keys, "node"]).drop("node").withColumn("first", first), "paths")
        changes = (
            paths.where("first is not null").drop("owner")
            .join(self.runs.select(*keys, "pos", "activity", "since", "d"), [*keys, "pos", "activity"])
            .where((F.col("since") >= F.col("first")) & (F.col("since") <= F.col("n")))
            .groupBy(*keys, F.col("tid").alias("owner"), F.col("since").alias("pos")).agg(F.sum("d").alias("d"))
        )
        down = Window.partitionBy(*keys, "tid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = (
            paths.join(changes, [*keys, "owner", "pos"], "left").join(self._known(), [*keys, "activity"], "left")
            .select(
                *keys, "tid", F.col("pos").alias("prefix_len"),
                F.sum(F.coalesce("d", F.lit(0))).over(down).alias("hits"), F.count("known").over(down).alias("known"),
            )
        )
        return self._errors(summed)

    def score_whole(self, variants: DataFrame) -> DataFrame:
        """The same for the whole traces only."""
        keys = self.keys
        events = (
            variants.select(*keys, "tid", F.col("n").alias("prefix_len"), F.posexplode("trace").alias("p", "activity"))
            .withColumn("pos", F.col("p") + 1).join(self._known(), [*keys, "activity"], "left")
        )
        summed = (
            events.join(self.counts, [*keys, "prefix_len", "pos", "activity"], "left")
            .groupBy(*keys, "tid", "prefix_len")
            .agg(F.sum(F.coalesce("c", F.lit(0))).alias("hits"), F.count("known").alias("known"))
        )
        return self._errors(summed)

    def _known(self) -> DataFrame:
        return self.vocabulary.select(*self.keys, "activity", F.lit(1).alias("known"))

    def _errors(self, summed: DataFrame) -> DataFrame:
        keys = self.keys
        fit = F.col("n_fit").cast("double")
        error = (
            F.col("known").cast("double")
            + F.col("squares").cast("double") / (fit * fit)
            - F.lit(2.0) * F.col("hits").cast("double") / fit
        ) / (F.col("size") * F.col("prefix_len")).cast("double")
        return summed.join(self.norms, [*keys, "prefix_len"]).select(*keys, "tid", "prefix_len", F.round(error, 9).alias("score"))


def frequency_model(train: DataFrame, cuts: DataFrame, vocabulary: DataFrame, keys=()) -> FrequencyModel:
    runs = settle(position_runs(train, cuts, keys), "runs")
    whole = lambda c: c.cast("decimal(18,0)") * c.cast("decimal(18,0)")
    grown = runs.groupBy(*keys, F.col("since").alias("prefix_len")).agg(F.sum(whole(F.col("c")) - whole(F.col("c") - F.col("d"))).alias("grown"))
    # A row for each length.
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("prefix_len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    norms = cuts.select(*keys, "prefix_len", "n_fit").join(grown, [*keys, "prefix_len"], "left")
    norms = norms.select(*keys, "prefix_len", "n_fit", F.sum(F.coalesce("grown", F.lit(0))).over(upto).alias("squares"))
    sizes = vocabulary.groupBy(*keys).agg(F.count("*").alias("size"))
    norms = norms.join(sizes, [*keys]) if keys else norms.withColumn("size", sizes.scalar())
    return FrequencyModel(runs, settle(norms, "norms"), vocabulary, keys=tuple(keys))


def sample_errors(train: DataFrame, cuts: DataFrame, scores: DataFrame, keys=()) -> DataFrame:
    """Training errors with their multiplicity: ``keys, prefix_len, score, in_tail, label, w``."""
    return (
        samples(with_tid(train), cuts, "tid", F.element_at("flags", F.col("prefix_len")).alias("label"), keys=keys)
        .groupBy(*keys, "tid", "prefix_len", "in_tail", "label").agg(F.count("*").alias("w"))
        .join(scores, [*keys, "tid", "prefix_len"])
        .groupBy(*keys, "prefix_len", "score", "in_tail", "label").agg(F.sum("w").alias("w"))
    )


def thresholds(errors: DataFrame, percentiles=PERCENTILES, keys=()) -> DataFrame:
    """Candidate thresholds: percentiles of the errors before the tail, linearly interpolated.

    The percentile p of n ascending errors lies at place (n - 1) p / 100, between two order
    statistics. Each error finds the places it covers from its running count, so no group is
    sorted in one task.
    """
    length = [*keys, "prefix_len"]
    fit = errors.where(~F.col("in_tail")).groupBy(*length, "score").agg(F.sum("w").alias("w"))
    n = fit.groupBy(*length).agg(F.sum("w").alias("n"))
    ranked = running_total(
        fit, length, F.floor(F.col("score") * ERROR_SLOTS), ["score"], F.col("w"), "upto"
    ).join(n, length)
    last = F.col("n") - 1

    def between(p):
        at = F.floor(last * p / 100)
        return F.array(
            F.struct(p.alias("p"), F.lit(0).alias("side"), at.alias("at")),
            F.struct(p.alias("p"), F.lit(1).alias("side"), F.least(at + 1, last).alias("at")),
        )

    marks = F.flatten(F.transform(F.array(*[F.lit(p) for p in percentiles]), between))
    covered = F.filter(marks, lambda m: (m.at >= F.col("upto") - F.col("w")) & (m.at < F.col("upto")))
    part = F.pmod((F.col("n") - 1) * F.col("p"), F.lit(100)) / F.lit(100.0)
    return (
        ranked.select(*length, "n", "score", F.explode(covered).alias("m"))
        .groupBy(*length, "n", F.col("m.p").alias("p"))
        .agg(F.max(F.when(F.col("m.side") == 0, F.col("score"))).alias("lo"),
             F.max(F.when(F.col("m.side") == 1, F.col("score"))).alias("hi"))
        .select(*length, "p", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * part, 12).alias("threshold"))
    )


def best_thresholds(candidates: DataFrame, errors: DataFrame, keys=()) -> DataFrame:
    """Per length the candidate with the best F1 on the tail, the lowest percentile on ties.

    Tails of normal samples only give F1 = 0 throughout, so the first candidate is taken.
    """
    length = [*keys, "prefix_len"]
    tail = errors.where("in_tail").groupBy(*length, "score", "label").agg(F.sum("w").alias("w"))
    # One row per length, with as many entries as there are percentiles.
    per_length = candidates.groupBy(*length).agg(F.collect_list(F.struct("p", "threshold")).alias("c"))
    hit, wrong = F.col("c.threshold") < F.col("score"), F.col("label") == 1
    judged = (
        tail.join(per_length, length)
        .select(*length, "score", "label", "w", F.explode("c").alias("c"))
        .groupBy(*length, F.col("c.p").alias("p"), F.col("c.threshold").alias("threshold"))
        .agg(
            F.sum(F.when(hit & wrong, F.col("w")).otherwise(0)).alias("tp"),
            F.sum(F.when(hit & ~wrong, F.col("w")).otherwise(0)).alias("fp"),
            F.sum(F.when(~hit & wrong, F.col("w")).otherwise(0)).alias("fn"),
        )
    )
    below = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(below > 0, 2 * F.col("tp") / F.greatest(below, F.lit(1))).otherwise(F.lit(0.0))
    return (
        judged.withColumn("f1", f1)
        .groupBy(*length)
        .agg(F.max_by(F.struct("p", "threshold", "f1"), F.struct(F.col("f1"), -F.col("p"))).alias("b"))
        .select(*length, "b.p", "b.threshold", "b.f1")
    )


@dataclass
class Detection:
    scores: DataFrame  # keys, tid, prefix_len, score, predicted: at least every test prefix that has a model
    verdicts: DataFrame  # keys, tid, predicted, score, first_flag
    test: DataFrame  # labelled test cases with tid and true_label (the flag of the first event)
    keys: tuple = ()


def detect(test: DataFrame, model, chosen: DataFrame, scores: DataFrame | None = None) -> Detection:
    """Score every test prefix that has a model; flagged when the score is over the threshold.

    ``scores``: those of all test variants (others may be there too), where they are known already.
    """
    keys = getattr(model, "keys", ())
    limits = chosen.select(*keys, "prefix_len", "threshold")
    tagged = with_tid(test).withColumn("true_label", F.get("flags", F.lit(0)))
    if scores is None:
        scores = settle(model.score(variant_table(test, keys)), "scores")
    scores = (
        scores.join(limits, [*keys, "prefix_len"])
        .select(*keys, "tid", "prefix_len", "score", (F.col("score") > F.col("threshold")).cast("int").alias("predicted"))
    )
    verdicts = scores.groupBy(*keys, "tid").agg(
        F.max("predicted").alias("predicted"),
        F.max("score").alias("score"),
        F.min(F.when(F.col("predicted") == 1, F.col("prefix_len"))).alias("first_flag"),
    )
    return Detection(scores, verdicts, tagged, tuple(keys))


def prefix_records(found: Detection) -> DataFrame:
    """One row per test case and scored prefix."""
    keys = found.keys
    return found.test.select(*keys, "case_id", "tid", "trace", "true_label").join(found.scores, [*keys, "tid"]).select(
        *keys, "case_id", "prefix_len",
        F.array_join(F.slice("trace", 1, F.col("prefix_len")), ", ").alias("trace"),
        "score", "true_label", "predicted",
    )


def case_verdicts(found: Detection) -> DataFrame:
    """Predicted label and greatest score per test case; without any model 0 and null."""
    keys = found.keys
    return found.test.join(found.verdicts, [*keys, "tid"], "left").select(
        *keys, "case_id", "n", "true_label", F.coalesce("predicted", F.lit(0)).alias("predicted"), "score", "first_flag"
    )


def earliness(found: Detection) -> DataFrame:
    """Shortest flagged prefix of each flagged case and its share of the case."""
    return case_verdicts(found).where(F.col("first_flag").isNotNull()).select(
        *found.keys, "case_id", "first_flag", "n", (F.col("first_flag") / F.col("n")).alias("share")
    )


def prefix_outcomes(found: Detection) -> DataFrame:
    """Counts per ``prefix_len, true_label, predicted``, summed over variants instead of cases."""
    keys = found.keys
    weights = found.test.groupBy(*keys, "tid", "true_label").agg(F.count("*").alias("w"))
    return (
        weights.join(found.scores, [*keys, "tid"])
        .groupBy(*keys, "prefix_len", "true_label", "predicted").agg(F.sum("w").alias("w"))
    )


def prefix_counts(found: Detection) -> DataFrame:
    """Normal and anomalous test prefixes per length."""
    return prefix_outcomes(found).groupBy(*found.keys, "prefix_len").agg(
        F.sum(F.when(F.col("true_label") == 1, F.lit(0)).otherwise(F.col("w"))).alias("normal_count"),
        F.sum(F.when(F.col("true_label") == 1, F.col("w")).otherwise(F.lit(0))).alias("anomaly_count"),
    )
