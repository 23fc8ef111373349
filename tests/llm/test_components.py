import random

import pytest

import __spark_entry__ as e
from sparkloom.llm.components import consolidate


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_hub_chains_and_groups(spark, seed):
    rng = random.Random(seed)
    pairs = [("hub", f"h{k}") for k in range(120)] + [(f"h{k}", f"t{k}") for k in range(40)] + [(f"t0_{k}", f"t0_{k + 1}") for k in range(25)] + [("t0", "t0_0")]
    pairs += [(f"c{k}", f"c{k + 1}") for k in range(30)] + [("second", f"s{k}") for k in range(60)] + [("self", "self"), (None, "x"), ("y", None), ("a", "b"), ("b", "a"), ("a", "b")]
    rng.shuffle(pairs)
    groups = [("g1", ["m1", None, "m2", "m1"]), ("g1", ["m3", "c5"]), (None, ["n1", "n2"]), ("g2", []), ("g3", None), ("g4", ["lone"])]
    links = pairs + [("m1", "m2"), ("m3", "c5"), ("m1", "m3"), ("n1", "n2")]
    got = consolidate(spark.createDataFrame(pairs, "left_id string, right_id string"), spark.createDataFrame(groups, "group_id string, member_ids array<string>")).collect()
    assert {tuple(r) for r in got} == union_find(links)


def test_nothing_to_link(spark):
    got = consolidate(spark.createDataFrame([("a", "a"), (None, None)], "left_id string, right_id string"), spark.createDataFrame([], "group_id string, member_ids array<string>"))
    assert got.count() == 0


def test_registered():
    assert "p1_found" in e.queries()
