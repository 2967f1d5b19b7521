"""Detection runs over several logs, with all result tables written as CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect as dt
from ..operators.prefixes import prefix_dims
from ..sources.sinks import write_keyed_results, write_results
from .detection import Run

KEYS = ("dataset", "run")


def keyed_run(datasets: dict[str, DataFrame], runs=range(1, 6)) -> Run:
    """All logs and runs as one run: log and run are keys, so the number of jobs doesn't depend on how many there are."""
    logs = [log.select("case_id", "n", "trace", "flags", "anomaly", F.lit(name).alias("dataset")) for name, log in datasets.items()]
    every = F.explode(F.array(*[F.lit(int(k)) for k in runs]))
    return Run(reduce(DataFrame.unionByName, logs).withColumn("run", every), keys=KEYS)


def run_sweep(datasets: dict[str, DataFrame], out: str, encoding: str = "onehot", runs=range(1, 6), vector_size: int = 32) -> None:
    """Run every labelled log ``runs`` times (each run draws another split) and append the results.

    Under ``out``: ``metrics``, ``prefix_counts``, ``f1_by_prefix``, ``f1_by_type`` and
    ``encoding_dims``, each partitioned by dataset, encoding and run. With one-hot encoding all logs and runs are one plan;
    embedded logs, whose linear models are fitted one by one, follow each other.
    """
    if encoding == "onehot" and datasets and list(runs):
        r = keyed_run(datasets, runs)
        size = r.vocabulary.groupBy(*KEYS).agg(F.count("*").alias("size"))
        tables = {
            "metrics": r.metrics(),
            "prefix_counts": dt.prefix_counts(r.found),
            "f1_by_prefix": r.f1_by_prefix(),
            "f1_by_type": r.f1_by_type(),
            "encoding_dims": prefix_dims(r.test.join(size, [*KEYS]), F.col("size"), [*KEYS, "size"]).select(*KEYS, "prefix_len", "avg_dim"),
        }
        for name, rows in tables.items():
            write_keyed_results(rows.withColumn("encoding", F.lit(encoding)), f"{out}/{name}")
        return
    for dataset, labelled in datasets.items():
        for run in runs:
            r = Run(labelled, encoding=encoding, run=run)
            size = r.vocabulary.agg(F.count("*").alias("c")).scalar() if encoding == "onehot" else F.lit(vector_size)
            tables = {
                "metrics": r.metrics(dataset),
                "prefix_counts": dt.prefix_counts(r.found),
                "f1_by_prefix": r.f1_by_prefix(),
                "f1_by_type": r.f1_by_type(),
                "encoding_dims": prefix_dims(r.test, size).select("prefix_len", "avg_dim"),
            }
            for name, rows in tables.items():
                write_results(rows, f"{out}/{name}", dataset, encoding, run)
