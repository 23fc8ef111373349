from pyspark.sql import functions as F

import __spark_entry__ as e
from sparkloom.llm import containers, mixing
from sparkloom.plans.shared import Scratch


def test_containers_hold_every_token_once(spark):
    sizes = [(i, 1 + (i * i * 37) % 90) for i in range(400)] + [(1000, 250), (1001, 100), (1002, 300)]
    rows = containers.fill(spark.createDataFrame(sizes, "id long, n long"), 100, Scratch(spark, "t")).collect()
    load, seen = {}, {}
    for r in rows:
        load[r.container_id] = load.get(r.container_id, 0) + r.tokens
        seen.setdefault(r.id, []).append((r.first_token, r.tokens))
    assert max(load.values()) <= 100
    for i, n in sizes:
        parts = sorted(seen[i])
        assert sum(t for _, t in parts) == n and [a for a, _ in parts] == [100 * k for k in range(len(parts))]
        assert len(parts) == -(-n // 100)
    assert len(load) <= 1.05 * sum(n for _, n in sizes) / 100


def test_mix_meets_shares_and_repeats(spark):
    rows = [(i, s, 10 + i % 7) for i in range(900) for s in [("a", "b", "c")[i % 3]]] + [(9999, "not listed", 5)]
    target = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.1, 3), "absent": (0.1, 2)}
    got = mixing.mix(spark.createDataFrame(rows, "id long, source string, n long"), target, Scratch(spark, "t")).collect()
    total = sum(r.copies * r.tokens for r in got)
    for s, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.tokens for r in own) - share * total) < 20 and max(r.copies for r in own) <= target[s][1]
    assert {r.source for r in got} == {"a", "b", "c"}


def test_registered_over_the_whole_table(spark):
    assert {"p7_packed", "p8_selected", "p8_shares"} <= set(e.queries())
    got = e.queries()["p7_packed"](spark, e.SMOKE_DIR)
    cap = {r.container: r.capacity_tokens for r in spark.read.parquet(f"{e.SMOKE_DIR}/container_spec.parquet").collect()}
    whole = spark.read.parquet(f"{e.SMOKE_DIR}/documents.parquet").where(F.col("text").rlike(r"\S")).count()
    for r in got.groupBy("container").agg(F.countDistinct("doc_id").alias("n"), F.sum("tokens").alias("t"), F.countDistinct("container_id").alias("c")).collect():
        assert r.n == whole
        print(r.container, r.t / r.c / cap[r.container])
    e.queries()["p8_shares"](spark, e.SMOKE_DIR).show(20, False)


def test_no_rows_no_containers(spark):
    assert containers.fill(spark.createDataFrame([], "id long, n long"), 100, Scratch(spark, "t")).count() == 0
    assert containers.plan({}, 100) == []


def test_combinations_fit_and_plans_meet_the_histogram():
    counts = {n: 1 + (n * 7) % 13 for n in range(3, 240, 2)}
    got: dict[int, int] = {}
    for filling, times in containers.plan(dict(counts), 256):
        assert sum(s * m for s, m in filling.items()) <= 256
        for s, m in filling.items():
            got[s] = got.get(s, 0) + m * times
    assert got == counts
