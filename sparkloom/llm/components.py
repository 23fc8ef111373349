"""Consolidation of pairwise matches into groups (connected components).

Method: peel the giant component by frontier breadth-first joins from the vertex of highest degree, take it
out of the graph, and label the small components that remain by minimum propagation.

* Ids become 64-bit keys by xxhash64 over a seed. Keys are checked: should two ids ever share one, the next
  seed is tried, so no link can be invented by a collision. Keys order the vertices at random, which is what
  makes minimum propagation shrink long sorted chains geometrically.
* A frontier up to ``FRONTIER_ROWS`` keys is broadcast (8 bytes each, counted before the join), so the hub
  whose edges are a large part of the table never meets a shuffle; beyond the bound it is a shuffle join.
* Peeling stops once a frontier adds less than ``PEEL_SHARE`` of what is already peeled (a long tail costs one job a hop). What is peeled is
  taken away by anti-joins, and the keys of the last frontier, which stay, are tied to the root: nothing is cut off, and
  the tails are labelled with the rest. The share decides who labels a vertex, never its label.
* Each propagation round takes every vertex to the least key around it and contracts the graph by that map,
  dropping loops and doubles. Round maps shrink geometrically and are composed once, from the last to the
  first. A round is one aggregation and two joins, whatever the size of the groups: no component is ever
  gathered in one task.

Nulls link nothing; self pairs, repeated pairs and pairs in both directions are one link or none; an empty
input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkloom.plans.shared import Scratch

#: Keys of a frontier that may be broadcast (8 bytes each: 4 MB).
FRONTIER_ROWS = 500_000
PEEL_SHARE = 0.01


def group_links(groups: DataFrame, members: str = "member_ids", group: str = "group_id") -> DataFrame:
    """Rows of arrays as a star per row, and a star over the rows that name the same group."""
    live = F.array_compact(F.array_distinct(F.col(members)))
    rows = groups.select(F.col(group).alias("g"), live.alias("m")).where(F.size("m") > 0).select("g", "m", F.array_min("m").alias("left_id"))
    within = rows.select("left_id", F.explode("m").alias("right_id"))
    heads = rows.where("g is not null").select("g", "left_id")
    over = heads.join(heads.groupBy("g").agg(F.min("left_id").alias("right_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "g")
    return within.unionByName(over.select("left_id", "right_id"))


def pair_links(edges: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    return edges.select(F.col(left).cast("string").alias("left_id"), F.col(right).cast("string").alias("right_id"))


def _keyed(links: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """(u, v) with u < v, once each, and (key, id) of every linked vertex."""
    links = links.where("left_id is not null and right_id is not null and left_id <> right_id")
    ends = links.select(F.explode(F.array("left_id", "right_id")).alias("id"))
    for seed in range(64):
        key = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: E731, B023
        ids = ends.groupBy(key(F.col("id")).alias("key")).agg(F.min("id").alias("id"), F.max("id").alias("other"))
        ids = work.keep(ids)
        if ids.where("id <> other").limit(1).count() == 0:
            a, b = key(F.col("left_id")), key(F.col("right_id"))
            pairs = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).groupBy("u", "v").count().select("u", "v")
            return work.keep(pairs), ids.select("key", "id")
        work.drop(ids)
    raise RuntimeError("no seed without a key collision")


def _near(side: DataFrame, n: int) -> DataFrame:
    return F.broadcast(side) if n <= FRONTIER_ROWS else side


def _peel(pairs: DataFrame, work: Scratch) -> tuple[DataFrame | None, int | None, DataFrame]:
    """Keys of the giant as far as breadth-first search went, its root, and the pairs that remain."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b")
    top = both.groupBy("a").count().orderBy(F.desc("count"), "a").limit(1).collect()
    if not top or top[0]["count"] < 3:
        return None, None, pairs
    root, spark = top[0]["a"], pairs.sparkSession
    giant = work.keep(spark.createDataFrame([(root,)], "key long"))
    frontier, n, total = giant, 1, 1
    while True:
        near = _near(frontier.select(F.col("key").alias("a")), n)
        ahead = pairs.join(near.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("key")).unionByName(pairs.join(near.withColumnRenamed("a", "v"), "v").select(F.col("u").alias("key")))
        fresh = work.keep(ahead.groupBy("key").count().select("key").join(_near(giant, total), "key", "left_anti"))
        n = fresh.count()
        if n < max(1, PEEL_SHARE * total):
            break
        giant = giant.unionByName(fresh)
        frontier, total = fresh, total + n
    known = _near(giant, total)
    rest = pairs.where((F.col("u") != F.lit(root)) & (F.col("v") != F.lit(root)))  # the hub's own pairs go without a join
    for end in ("u", "v"):
        rest = rest.join(known.withColumnRenamed("key", end), end, "left_anti")
    tied = fresh.select(F.least(F.lit(root), "key").alias("u"), F.greatest(F.lit(root), "key").alias("v"))
    return giant, root, work.keep(rest.select("u", "v").unionByName(tied))


def _propagate(pairs: DataFrame, work: Scratch) -> DataFrame | None:
    """(key, label): the same label for the keys of one component."""
    maps, graph = [], pairs
    while graph.limit(1).count():
        ends = graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.keep(ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("key"), F.least("u", "m").alias("label")))
        maps.append(least)
        nxt = (
            graph.join(least.select(F.col("key").alias("u"), F.col("label").alias("lu")), "u")
            .join(least.select(F.col("key").alias("v"), F.col("label").alias("lv")), "v")
            .where("lu <> lv")
            .select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v"))
            .distinct()
        )
        nxt = work.keep(nxt)
        if graph is not pairs:
            work.drop(graph)
        graph = nxt
    if not maps:
        return None
    final = maps[-1]
    for m in reversed(maps[:-1]):
        ends = final.select(F.col("key").alias("label"), F.col("label").alias("end"))
        new = work.keep(m.join(ends, "label", "left").select("key", F.coalesce("end", "label").alias("label")))
        work.drop(final)
        final = new
    return final


def components(links: DataFrame) -> DataFrame:
    """(record_id, group_id) for every id linked with another; group_id is the least id of its component by bytes."""
    spark = links.sparkSession
    work = Scratch(spark, "components")
    pairs, ids = _keyed(links, work)
    giant, root, rest = _peel(pairs, work)
    small = _propagate(rest, work)
    none = spark.createDataFrame([], "key long, label long")
    small = small if small is not None else none
    if giant is None:
        labelled = small
    else:
        # the root's label after propagation is the label of all that was peeled: one row
        end = small.where(F.col("key") == F.lit(root)).select("label").collect()
        end = end[0]["label"] if end else root
        labelled = small.where(F.col("key") != F.lit(root)).unionByName(giant.select("key", F.lit(end).cast("long").alias("label")))
    named = work.keep(ids.join(labelled, "key").select("id", "label"))
    least = named.groupBy("label").agg(F.min("id").alias("group_id"))
    if giant is None:
        out = named.join(least, "label")
    else:  # the giant's name is one value; joining on its label would send a third of the rows to one task
        big = named.where(F.col("label") == F.lit(end)).agg(F.min("id")).collect()[0][0]
        out = named.where(F.col("label") != F.lit(end)).join(least, "label").select("id", "group_id").unionByName(named.where(F.col("label") == F.lit(end)).select("id", F.lit(big).alias("group_id")))
    return out.select(F.col("id").alias("record_id"), "group_id")


def consolidate(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups over pairwise matches (left_id, right_id) and provisional groups (member_ids, group_id)."""
    return components(pair_links(edges).unionByName(group_links(groups)))


def p1_found(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return consolidate(read("dup_edges").select("left_id", "right_id"), read("dup_groups").select("group_id", "member_ids"))
