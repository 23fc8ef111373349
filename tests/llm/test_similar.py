import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from sparkloom.llm import similar
from sparkloom.llm.similar import similar_pairs


def brute(rows):
    s = {i: set(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if s[a] and s[b] and 17 * len(s[a] & s[b]) >= 7 * (len(s[a]) + len(s[b]))}


def found(spark, rows):
    return {tuple(r) for r in similar_pairs(spark.createDataFrame(rows, "id string, text string"), "id", F.col("text")).collect()}


def test_every_pair_and_no_other(spark):
    rng, rows = random.Random(3), [("n", None), ("o", " -- "), ("p", "Same words"), ("q", "words, SAME"), ("p", "Same words")]
    for k in range(60):
        base = rng.sample(range(90), rng.randint(1, 60))
        for j in range(4):  # 0.7 is met from both sides
            cut = rng.randint(0, len(base) // 3)
            rows.append((f"r{k}_{j}", " ".join(f"w{x}" for x in base[cut:] + rng.sample(range(200, 260), rng.randint(0, max(1, len(base) // 6))))))
    assert found(spark, rows) == brute(rows)


@pytest.mark.skipif(not os.path.exists(e.SMOKE_DIR), reason="no test data")
def test_p4_found_on_the_smoke_table(spark):
    rows = {(r.id, r.text) for r in spark.read.parquet(f"{e.SMOKE_DIR}/dedup_input.parquet").select("id", F.col("payload.text").alias("text")).collect()}
    assert {tuple(r) for r in e.queries()["p4_found"](spark, e.SMOKE_DIR).collect()} == brute(rows)


def test_keys_that_many_sets_share_become_tiles(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE", 400)
    rng = random.Random(5)
    rows = [(f"t{k}", " ".join(["the", "same", "long", "opening", "of", "all", "texts"] + rng.sample(["a", "b", "c", "d"], 2))) for k in range(150)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_one_word_sets(spark):
    assert found(spark, [("a", None), ("b", "")]) == set()
    assert found(spark, [("a", "one"), ("b", "ONE."), ("c", "two"), ("d", "one two")]) == {("a", "b")}
    assert similar_pairs(spark.createDataFrame([], "id string, text string, a string, rid long, w string"), "id", F.col("text")).count() == 0


def test_very_long_texts(spark):
    long = [f"w{k}" for k in range(3000)]
    rows = [("a", " ".join(long)), ("b", " ".join(long[:2200])), ("c", " ".join(long[:2099])), ("d", " ".join(long[900:]))]
    assert found(spark, rows) == brute(rows)
