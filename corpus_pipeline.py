"""From documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents, and may keep others that docs has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm import language_id, mixing, ngram_join, packing, quality_rules
from tracewright.llm.common import fresh
from tracewright.session import settle

#: A text is rejected if no language reaches this posterior.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told. A null text, or one without a letter, has none."""
    name = fresh(docs, "language")
    judged = docs.withColumn(name, language_id.predicted(docs, language_id.fit(docs)))
    return judged.where((F.col(f"{name}.lang") != language_id.UNKNOWN) & (F.col(f"{name}.score") >= SURE)).drop(name)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the adaptive bounds of their language and source."""
    return quality_rules.judge(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of copies and near copies.

    Of rows that repeat this id in one group, one stays: the text of the smallest hash, once. Rows without an id can't be told apart and all stay.
    """
    found = ngram_join.join(docs.select("doc_id", "text"))
    group = F.coalesce("group_key", "text_hash")
    h, turn, stay_id, stay_hash = (fresh(docs, c) for c in ("text_hash", "turn", "stay_id", "stay_hash"))
    stay = found.where("doc_id = class_id").groupBy(F.col("doc_id").alias(stay_id), group.alias("group")).agg(F.min("text_hash").alias(stay_hash))
    stay = settle(stay.select(stay_id, stay_hash), "stay")
    hashed = docs.withColumn(h, F.xxhash64("text"))
    kept = hashed.join(stay, (F.col("doc_id") == F.col(stay_id)) & (F.col(h) == F.col(stay_hash)), "left_semi")
    one = kept.withColumn(turn, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(F.lit(0)))).where(F.col(turn) == 1)
    return one.drop(h, turn).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two whole copies (the one at a source's end is rounded).

    Rows of the same id and text are one document here, taken as often as they are together. The rows are in the order of the
    schedule, over the partitions as well as inside them: a copy stands where its first word does.
    """
    h, turn, places, taken_id, taken_hash, alike = (fresh(docs, c) for c in ("text_hash", "turn", "places", "taken_id", "taken_hash", "alike"))
    hashed = docs.withColumn(h, F.xxhash64("text"))
    worded, _ = mixing.dealt(hashed.select("doc_id", "text", "source", F.col(h).alias("_hash")), "text", "source", "doc_id", ["_hash"])
    opening = F.collect_list(F.when((F.col("before") == 0) & (F.col("part") > 0), F.struct("slot", "place")))
    rows = worded.groupBy("no", "start", "doc_id", "_hash", "size").agg(F.sum("part").alias("taken"), opening.alias("at"))
    of_row = F.slice(F.sort_array("at"), F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int"))
    taken = rows.groupBy(F.col("doc_id").alias(taken_id), F.col("_hash").alias(taken_hash)).agg(F.flatten(F.collect_list(of_row)).alias(places), F.count("*").alias(alike))
    taken = settle(taken.where(F.size(places) > 0), "taken")
    same = F.col("doc_id").eqNullSafe(F.col(taken_id)) & (F.col(h) == F.col(taken_hash))
    # Only texts of documents that stand more than once are shuffled for being told from each other.
    once, several = (hashed.join(taken.where(k), same) for k in (F.col(alike) == 1, F.col(alike) > 1))
    several = several.withColumn(turn, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(F.lit(0)))).where(F.col(turn) == 1)
    one = once.unionByName(several.drop(turn))
    repeated = one.withColumn(turn, F.explode(places))
    order = [f"{turn}.slot", f"{turn}.place"]
    return repeated.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their place in sequences of 2048."""
    return packing.pack(packing.pieces(docs.select("doc_id", "text")))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A learned language model and byte-pair tokens can't be told in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what lies between two of them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = settle(docs, "stage")
    return docs
