"""Exact deduplication of texts and files: a key, its SHA-256, one kept sample a group.

The best sample has the largest quality (for texts: the length of the normalised text); ties go to the smallest id as a string.
Rows whose key is empty or null are in no group and are to be reviewed. Groups are joined back so that one group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.normalize import dedup_key
from sparkloom.plans.hot import join_groups
from sparkloom.plans.shared import Scratch


def normalize_for_dedup(df: DataFrame, text: str = "text") -> DataFrame:
    """df with normalized_text, normalized_length and the issue of a text that is empty once normalised."""
    out = df.withColumn("normalized_text", dedup_key(F.col(text)))
    empty = F.col("normalized_text") == ""
    return out.withColumn("normalized_length", F.length("normalized_text")).withColumn("issue", F.when(empty, "empty_text_after_normalize")).withColumn("action", F.when(empty, "review").otherwise("pending"))


def hash_groups(df: DataFrame, id_col: str, key: Column, quality: Column) -> DataFrame:
    """(id, hash, keep_id, group_size, action) of every row."""
    kind = dict(df.dtypes)[id_col]
    work = Scratch(df.sparkSession, "exact")
    hashed = df.select(F.col(id_col).alias("id"), key.alias("key"), quality.cast("double").alias("q"))
    rows = work.keep(hashed.select("id", F.when(F.length("key") > 0, F.sha2(F.col("key").cast("binary"), 256)).alias("hash"), "q"))
    best = F.min_by(F.col("id").cast("string"), F.struct(-F.coalesce(F.col("q"), F.lit(0.0)), F.col("id").cast("string")))
    groups = work.keep(rows.where("hash is not null").groupBy("hash").agg(best.alias("keep"), F.count(F.lit(1)).alias("n")))
    held = join_groups(rows.where("hash is not null").drop("q"), groups, ["hash"], "n")
    action = F.when(F.col("id").cast("string") == F.col("keep"), "keep").otherwise("remove")
    out = held.select("id", "hash", F.col("keep").cast(kind).alias("keep_id"), F.col("n").alias("group_size"), action.alias("action"))
    none = rows.where("hash is null").select("id", "hash", F.lit(None).cast(kind).alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit("review").alias("action"))
    return out.unionByName(none)


def exact_dedup(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, keep_id, group_size, action) of every row; action: keep, remove or review."""
    rows = normalize_for_dedup(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return hash_groups(rows, "id", F.col("normalized_text"), F.col("normalized_length")).drop("hash")


def hash_edges(df: DataFrame, id_col: str, key: Column, reason: str = "sha256") -> DataFrame:
    """Star edges from the first id of each group to the others, score 1."""
    groups = hash_groups(df, id_col, key, F.lit(0))
    lo, hi = F.least(F.col("keep_id").cast("string"), F.col("id").cast("string")), F.greatest(F.col("keep_id").cast("string"), F.col("id").cast("string"))
    return groups.where("hash is not null and id <> keep_id").select(lo.alias("left_id"), hi.alias("right_id"), F.lit(1.0).alias("score"), F.lit(reason).alias("reason"), F.lit("exact").alias("duplicate_type"), F.lit("exact_hash").alias("operator"))


def text_dedup_exact(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").withColumnRenamed("id", "doc_id")
