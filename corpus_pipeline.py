"""A training-data pipeline out of the operators of glyphspark.llm.

quality classifier -> exact dedup -> SimHash near-dedup -> benchmark decontamination -> mixing to target weights. Every
stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns the columns of documents; the last
adds what the mix takes of each document. Stages move texts once each: decisions are made on narrow rows and meet the
texts by (id, text hash).

Edge cases, in every stage: a null text is a text without words and equals an empty one; null ids, sources and languages are values of
their own, and rows with null or equal ids are told apart by their texts; of rows with equal id and text a dedup stage keeps one, the others treat
them alike; very long texts are read whole; an empty table gives an empty one; further columns are carried along, whatever their names
(other than the mix_ columns that the last stage adds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphspark.llm.common import materialise, null_safe, pick, scratch, without
from glyphspark.llm.decontaminate import decontaminate
from glyphspark.llm.exact_dedup import exact_dedup
from glyphspark.llm.mixing import label_weights, mix
from glyphspark.llm.quality import documents_quality
from glyphspark.llm.simhash import near_copies


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without(docs, documents_quality(spark, docs, sf_dir).filter(~F.col("kept")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts stays."""
    return pick(docs, materialise(exact_dedup(docs).filter("kept").select("id", "text_hash", "copies"), "exact-kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word shingles, about 0.8 alike or more) stays: the smallest id, then the smallest text
    hash; null ids come last."""
    found = near_copies(docs).groupBy("root", "id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "copies")
    stays = found.groupBy("root").agg(F.min(rank).alias("one")).select("one.id", "one.text_hash", "one.copies")
    return pick(docs, materialise(stays, "near-kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return without(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with mix_size, mix_source_size, mix_target and mix_taken (words, repeats counted)."""
    weights = label_weights(docs.select(F.col("doc_id").alias("id")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    taken = mix(docs, weights=weights).filter("taken > 0").select("id", "text_hash", *(F.col(c).alias(f"mix_{c}") for c in ("size", "source_size", "target", "taken")))
    one = taken.dropDuplicates(["id", "text_hash"])
    keyed = docs.withColumn("id", F.col("doc_id")).withColumn("text_hash", F.xxhash64("text"))
    return null_safe(keyed, one.hint("shuffle_hash"), ["id", "text_hash"], "inner").drop("id", "text_hash")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: Two stages (a fitted classifier and components of fingerprints) have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote on its way goes when its result is written
            docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower(), lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
