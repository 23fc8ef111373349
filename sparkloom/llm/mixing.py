"""A selection of documents in which each source has its target share of the tokens.

Method: every document gets a random key by hash; a range sort by (source, key) and prefix sums (sums of the partitions first, then within each) give the
tokens before it. The total is the largest that the scarcest source allows at ``max_repeats``. Each source gives whole rounds of all its documents, then the
first in key order up to its share; the last one is taken if more than half of it fits, so a share is off by half a document at most.

A listed source without a document can reach nothing: it is reported with 0, and the others share the total in their proportions.
Sources that are not listed, and null or blank texts, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.llm.tokens import token_counts
from sparkloom.plans.shared import Scratch


def quotas(held: dict[str, int], target: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Tokens that each source gives."""
    live = {s: t for s, t in target.items() if held.get(s) and t[0] > 0 and t[1] > 0}
    total = min((held[s] * most / share for s, (share, most) in live.items()), default=0)
    return {s: min(round(total * share), held[s] * most) for s, (share, most) in live.items()}


def mix(sizes: DataFrame, target: dict[str, tuple[float, int]], work: Scratch, seed: int = 0) -> DataFrame:
    """(source, id, copies, tokens) of (id, source, n): tokens of one copy."""
    spark = sizes.sparkSession
    keyed = sizes.where(F.col("source").isin(list(target))).withColumn("key", F.xxhash64(F.lit(seed), "id"))
    rows = work.keep(keyed.repartitionByRange("source", "key", "id").withColumn("p", F.spark_partition_id()))
    sums = sorted((r["source"], r["p"], r["n"]) for r in rows.groupBy("source", "p").agg(F.sum("n").alias("n")).collect())
    held: dict[str, int] = {}
    before = []
    for s, p, n in sums:
        before.append((s, p, held.get(s, 0)))
        held[s] = held.get(s, 0) + n
    give = quotas(held, target)
    each = [(s, p, b, give[s] // held[s], give[s] % held[s]) for s, p, b in before if s in give]
    part = spark.createDataFrame(each, "source string, p int, base long, rounds long, rest long")
    own = Window.partitionBy("source", "p").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = rows.withColumn("upto", F.sum("n").over(own)).join(F.broadcast(part), ["source", "p"])
    extra = (2 * (F.col("base") + F.col("upto")) - F.col("n") < 2 * F.col("rest")).cast("long")
    return sorted_.select("source", "id", (F.col("rounds") + extra).alias("copies"), F.col("n").alias("tokens")).where("copies > 0")


def _targets(spark, sf_dir: str) -> dict[str, tuple[float, int]]:
    return {r["source"]: (r["target_share"], r["max_repeats"]) for r in spark.read.parquet(f"{sf_dir}/mix_target.parquet").collect()}


def p8_selected(spark, sf_dir: str) -> DataFrame:
    """(source, doc_id, copies, tokens)."""
    target, work = _targets(spark, sf_dir), Scratch(spark, "mixing")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("source").isin(list(target)))
    return mix(token_counts(d, "doc_id", "text", "source"), target, work).withColumnRenamed("id", "doc_id")


def p8_shares(spark, sf_dir: str) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_copies) of every listed source."""
    got = p8_selected(spark, sf_dir).groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    all_ = spark.read.parquet(f"{sf_dir}/mix_target.parquet").join(F.broadcast(got), "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    return all_.select("source", "target_share", (F.col("tokens") / F.sum("tokens").over(Window.partitionBy())).alias("reached_share"), "tokens", "documents", "most_copies")
