"""From edges to groups: fusion of equal pairs, connected components, numbered groups, the kept sample of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.plans.shared import Scratch

#: Order of the stages that edges come from: reasons and types are listed in it.
STAGES = ("exact_hash", "simhash_deduplicator", "minhash_lsh_deduplicator", "ann_recall", "cross_encoder_rerank")


def fuse(edges: DataFrame, semantic: bool = False, weights: dict[str, float] | None = None) -> DataFrame:
    """One edge a pair: highest score, reasons and operators in the order of their stages, the strongest type.

    A pair that any stage calls exact is exact; with ``semantic`` a semantic one comes before near, else the first stage's type holds.
    ``weights`` by operator multiply scores up to 1; a weight below 1 counts as 1.
    """
    a, b = F.col("left_id").cast("string"), F.col("right_id").cast("string")
    order = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), F.col("operator")), F.lit(0))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("operator") == name, F.lit(max(1.0, w))).otherwise(weight)
    rows = edges.where(a != b).select(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id"), F.least(F.lit(1.0), F.col("score") * weight).alias("score"), "reason", "duplicate_type", "operator", order.alias("o"))
    once = rows.groupBy("left_id", "right_id", "reason", "duplicate_type", "operator", "o").agg(F.max("score").alias("score"))
    listed = F.array_sort(F.collect_list(F.struct("o", "reason", "operator", "duplicate_type")))
    out = once.groupBy("left_id", "right_id").agg(F.max("score").alias("score"), listed.alias("l"))
    has = lambda kind: F.exists("l", lambda x: x["duplicate_type"] == kind)
    kind = F.when(has("exact"), "exact")
    if semantic:
        kind = kind.when(has("semantic"), "semantic")
    reasons, operators = (F.array_distinct(F.transform("l", lambda x: x[c])) for c in ("reason", "operator"))
    return out.select("left_id", "right_id", F.round("score", 6).alias("score"), reasons.alias("reasons"), operators.alias("operators"), kind.otherwise(F.col("l")[0]["duplicate_type"]).alias("duplicate_type"))


def components(edges: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """(id, root) of every id on an edge; root is the least id of its component.

    Every round takes each vertex to the least vertex around it, in the order of a hash, and contracts the graph by that map, so
    that chains shrink geometrically whatever the ids. Rounds are tables in the shared folder; no component is gathered in one task.
    """
    work = Scratch(edges.sparkSession, "clusters")
    vertex = lambda c: F.struct(F.xxhash64(F.col(c).cast("string")).alias("h"), F.col(c).cast("string").alias("id"))
    graph = work.keep(edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).select(vertex(left).alias("u"), vertex(right).alias("v")).distinct())
    maps = []
    while graph.limit(1).count():
        both = graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = work.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("to")))
        maps.append(to)
        met = graph.join(to.withColumnRenamed("to", "x"), "u").join(to.select(F.col("u").alias("v"), F.col("to").alias("y")), "v")
        graph = work.keep(met.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    if not maps:
        return edges.sparkSession.createDataFrame([], "id string, root string")
    ends = maps[-1]
    for m in reversed(maps[:-1]):
        ends = work.keep(m.join(ends.select(F.col("u").alias("to"), F.col("to").alias("end")), "to", "left").select("u", F.coalesce("end", "to").alias("to")))
    named = ends.select(F.col("u.id").alias("id"), F.col("to.id").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("root"))
    return work.keep(named.join(least, "label").select("id", "root"))


def duplicate_groups(items: DataFrame, fused: DataFrame, min_score: float = 0.75, position: str | None = None) -> DataFrame:
    """(duplicate_group_id, id, ...) of the members of every group of two or more.

    Edges below ``min_score`` link nothing. Groups are numbered dup_group_000001 and on in the order of their first member (by ``position``, a column of
    items, else by id). Score: highest; type: exact if an edge is, else near; reasons: all, in order.
    """
    live = fused.where(F.col("score") >= min_score)
    roots = components(live)
    at = F.col(position) if position else F.col("id").cast("string")
    where = items.select(F.col("id").cast("string").alias("id"), at.alias("at"))
    first = roots.join(where, "id", "left").groupBy("root").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("group_size"))
    named = number_groups(first)
    edge = live.join(roots, live["left_id"] == roots["id"]).select("root", "score", "reasons", "duplicate_type")
    facts = edge.select("root", "score", "duplicate_type", F.explode("reasons").alias("reason")).groupBy("root", "reason").agg(F.max("score").alias("score"), F.max((F.col("duplicate_type") == "exact").cast("int")).alias("exact"))
    facts = facts.groupBy("root").agg(F.round(F.max("score"), 6).alias("score"), F.max("exact").alias("exact"), F.sort_array(F.collect_set("reason")).alias("reasons"))
    return roots.join(named, "root").join(facts, "root").select("duplicate_group_id", "id", "group_size", "score", F.when(F.col("exact") == 1, "exact").otherwise("near").alias("duplicate_type"), "reasons")


def number_groups(first: DataFrame) -> DataFrame:
    """(root, group_size, duplicate_group_id): numbers in the order of ``at``, by prefix sums over a range sort, not in one task."""
    from pyspark.sql import Window

    spark = first.sparkSession
    work = Scratch(spark, "numbers")
    rows = work.keep(first.repartitionByRange("at", "root").withColumn("p", F.spark_partition_id()))
    before, sizes = {}, sorted((r["p"], r["count"]) for r in rows.groupBy("p").count().collect())
    total = 0
    for p, n in sizes:
        before[p] = total
        total += n
    start = spark.createDataFrame(list(before.items()), "p int, start long")
    own = F.row_number().over(Window.partitionBy("p").orderBy("at", "root"))
    return rows.withColumn("k", own).join(F.broadcast(start), "p").select("root", "group_size", F.format_string("dup_group_%06d", F.col("start") + F.col("k")).alias("duplicate_group_id"))


def select_best(members: DataFrame, items: DataFrame, quality: Column) -> DataFrame:
    """members with keep_id and action: the highest quality of each group is kept, ties by the smallest id as a string."""
    graded = members.join(items.select(F.col("id").cast("string").alias("id"), quality.cast("double").alias("quality")), "id", "left")
    best = graded.groupBy("duplicate_group_id").agg(F.min_by("id", F.struct(-F.coalesce("quality", F.lit(0.0)), F.col("id"))).alias("keep_id"))
    return graded.join(best, "duplicate_group_id").withColumn("action", F.when(F.col("id") == F.col("keep_id"), "keep").otherwise("remove"))


def apply_actions(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """items with duplicate_group_id and action; what is in no group keeps review, anything else is kept."""
    own = F.col("action") if "action" in items.columns else F.lit("pending")
    rest = items.withColumn("_own", own).drop("action", "duplicate_group_id")
    joined = rest.join(chosen.select(F.col("id").alias("_id"), "duplicate_group_id", F.col("action").alias("_act")), rest["id"].cast("string") == F.col("_id"), "left")
    action = F.coalesce(F.col("_act"), F.when(F.col("_own") == "pending", "keep").otherwise(F.col("_own")))
    return joined.withColumn("action", action).drop("_id", "_act", "_own")


def text_quality(items: DataFrame) -> Column:
    return F.col("normalized_length")


def image_quality(width: str = "width", height: str = "height", size: str = "file_size") -> Column:
    return F.coalesce(F.col(width) * F.col(height), F.lit(0)) + F.coalesce(F.col(size), F.lit(0)) / 1024


def audio_quality(duration: str = "duration", rate: str = "sample_rate", size: str = "file_size") -> Column:
    return F.coalesce(F.col(duration), F.lit(0)) * 1000 + F.coalesce(F.col(rate), F.lit(0)) / 100 + F.coalesce(F.col(size), F.lit(0)) / 1024


def merge_branches(branches: list[DataFrame]) -> DataFrame:
    """Rows (id, issues, action) of parallel branches, one a id: issues without repeats in order, the strongest action (review, remove, keep, pending)."""
    rank = F.create_map(*(F.lit(x) for kv in (("review", 3), ("remove", 2), ("keep", 1), ("pending", 0)) for x in kv))
    rows = None
    for k, b in enumerate(branches):
        one = b.select("id", F.lit(k).alias("k"), "issues", "action")
        rows = one if rows is None else rows.unionByName(one)
    got = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "issues"))).alias("l"), F.max_by("action", F.coalesce(rank[F.col("action")], F.lit(0))).alias("action"))
    return got.select("id", F.array_distinct(F.flatten(F.transform("l", lambda x: F.coalesce(x["issues"], F.array().cast("array<string>"))))).alias("issues"), "action")


def resume(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The items whose key is not among the done ones."""
    return items.join(done.select(key).distinct(), key, "left_anti")
