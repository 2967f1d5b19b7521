"""The detection run from a labelled log to verdicts and metrics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect as d
from ..operators import metrics as m
from ..operators.embeddings import learnt_vectors
from ..operators.linear import linear_model
from ..operators.prefixes import split, word_vectors
from ..operators.vocab import vocabulary
from ..session import settle

SCORE_SLOTS = 65_536


def score_slot(score):
    """Slots of scores of 9 digits: at most 15,259 different scores each."""
    return F.floor(score * SCORE_SLOTS)


@dataclass
class Run:
    """One detection run; each stage is built when first asked for."""

    labelled: DataFrame  # case_id, n, trace, flags, and optionally anomaly
    encoding: str = "onehot"
    model_kind: str = "frequency"
    run: int = 1
    bottleneck: int | None = None  # directions of the linear model, all of them if None
    embedding: str = "hashed"  # or "learnt"
    keys: tuple = ()  # columns of labelled that tell logs and runs apart; with ``run`` among them it names the split

    def __post_init__(self):
        if self.encoding not in ("onehot", "word2vec"):
            raise ValueError(f"unsupported encoding {self.encoding!r}")
        if self.model_kind not in ("frequency", "linear"):
            raise ValueError(f"unknown model {self.model_kind!r}")
        if self.embedding not in ("hashed", "learnt"):
            raise ValueError(f"unknown embedding {self.embedding!r}")
        if self.encoding == "word2vec":
            self.model_kind = "linear"
        if self.bottleneck is not None and self.model_kind != "linear":
            raise ValueError("only the linear model has a bottleneck")
        if self.keys and self.model_kind != "frequency":
            raise ValueError("only the frequency model is fitted for several logs at once")

    @cached_property
    def cases(self) -> DataFrame:
        return settle(self.labelled)

    @cached_property
    def parts(self) -> tuple[DataFrame, DataFrame]:
        return split(self.cases, run=F.col("run") if "run" in self.keys else self.run, keys=self.keys)

    @property
    def train(self) -> DataFrame:
        return self.parts[0]

    @property
    def test(self) -> DataFrame:
        return self.parts[1]

    @cached_property
    def vocabulary(self) -> DataFrame:
        words = self.train.select(*self.keys, F.explode("trace").alias("activity"))
        return settle(words.where("activity is not null").distinct() if self.keys else vocabulary(words))

    @cached_property
    def cuts(self) -> DataFrame:
        return settle(d.tail_cuts(self.train, self.keys))

    @cached_property
    def model(self):
        if self.model_kind == "frequency":
            return d.frequency_model(self.train, self.cuts, self.vocabulary, self.keys)
        embedded = learnt_vectors if self.embedding == "learnt" else word_vectors
        vectors = embedded(self.train) if self.encoding == "word2vec" else None
        return linear_model(self.train, self.cuts, self.vocabulary, vectors=vectors, bottleneck=self.bottleneck)

    @cached_property
    def scores(self) -> DataFrame:
        """Scores of the variants of training and test cases, many of which are the same."""
        columns = [*self.keys, "n", "trace"]
        both = self.train.select(*columns).unionByName(self.test.select(*columns))
        return settle(self.model.score(d.variant_table(both, self.keys)), "scores")

    @cached_property
    def errors(self) -> DataFrame:
        return settle(d.sample_errors(self.train, self.cuts, self.scores, self.keys), "errors")

    @cached_property
    def candidates(self) -> DataFrame:
        return d.thresholds(self.errors, keys=self.keys)

    @cached_property
    def chosen(self) -> DataFrame:
        return settle(d.best_thresholds(self.candidates, self.errors, self.keys), "chosen")

    @cached_property
    def found(self) -> d.Detection:
        return d.detect(self.test, self.model, self.chosen, self.scores)

    @cached_property
    def verdicts(self) -> DataFrame:
        return d.case_verdicts(self.found)

    def metrics(self, dataset: str | None = None) -> DataFrame:
        """Weighted precision, recall and F1 and the ROC AUC, one row, or one for each log and run with ``keys``."""
        rated = self.verdicts if dataset is None else self.verdicts.withColumn("dataset", F.lit(dataset))
        rated = settle(rated.withColumn("encoding", F.lit(self.encoding)))
        keys = [*(self.keys or ["dataset"]), "encoding"]
        weighted = m.weighted_metrics(m.case_outcomes(rated, *keys), *keys)
        auc = m.roc_auc(rated, keys, score_slot).select(*keys, "roc_auc", "unscored")
        # A log without any score has no area, but has its other figures.
        return weighted.join(auc, keys, "left") if self.keys else weighted.join(auc, keys)

    def f1_by_prefix(self) -> DataFrame:
        length = [*self.keys, "prefix_len"]
        return m.weighted_metrics(d.prefix_outcomes(self.found), *length).select(*length, "f1_score")

    def f1_by_type(self) -> DataFrame:
        case, kind = [*self.keys, "case_id"], [*self.keys, "anomaly"]
        typed = self.verdicts.join(self.found.test.select(*case, "anomaly"), case)
        return m.weighted_metrics(m.type_outcomes(typed, *self.keys), *kind).select(*kind, "f1_score")
