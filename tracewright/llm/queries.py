"""Registered queries of the operators; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import settle
from . import (
    divergence, language_id, main_text, mixing, nearest, ngram_join, packing, periodic, perplexity, quality_rules, simhash, toxicity, warc,
)
from .common import remainder, table
from .oracle import ORACLE  # noqa: F401


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op6_warc(spark, sf_dir):
    found = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")), "page_id")
    columns = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "payload_digest", "block_digest", "http_status"]
    return found.select(
        *columns, F.to_json("http_headers").alias("http_headers"), F.length("block").cast("long").alias("n_chars"),
        F.crc32("record").alias("record_crc32"), "error",
    )


def op7_ngram_join(spark, sf_dir):
    found = ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "copy_id")


def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    counted = settle(quality_rules.counts(docs).drop("text"), "counts")
    judged = quality_rules.verdicts(counted, quality_rules.limits(counted))
    return judged.select(
        "doc_id", *[f"counts.{c}" for c in quality_rules.COUNTS[:5]],
        quality_rules.base_failed("counts").alias("base_failed"), "kept",
    )


def op1_main_text(spark, sf_dir):
    pages = main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.fit(docs.where(~held_out).join(labels, "doc_id", "left"))
    found = docs.select("doc_id", held_out.alias("held_out"), toxicity.scored(docs, model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= toxicity.CALLED).cast("int"))


def op3_perplexity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return perplexity.judged(perplexity.scores(docs, labels.where("quality = 1")))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.predicted(docs, model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op9_packing(spark, sf_dir):
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(rows, rows.where(F.col("vec_id") % 50 == 0))


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    altered = docs.withColumn("g", F.when(h % 10 == 0, F.call_function("div", h, F.lit(10))))
    found = periodic.find(altered, tile="g")
    higher = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    best = F.reduce("runs", F.lit(None).cast(periodic.RUN), lambda best, x: F.when(best.isNull() | higher(x, best), x).otherwise(best))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    told = found.withColumn("best", best)
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(best.length * 1000) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_simhash(spark, sf_dir):
    return simhash.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_toxicity": op2_toxicity,
    "op3_perplexity": op3_perplexity,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_nearest": op10_nearest,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_divergence": op12_divergence,
    "op13_simhash": op13_simhash,
}
