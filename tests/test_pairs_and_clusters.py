import itertools
import random

from pyspark.sql import functions as F

from sparkloom.functions.vectors import hamming, simhash_of
from sparkloom.operators import clusters, pairs


def near(rows):
    """Components that a list of pairs makes."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {frozenset(k for k in root if find(k) == r) for r in map(find, list(root))}


def test_hamming_bands_lose_no_pair(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(4)]
    rows = [(f"i{k:03}", p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)] + [("none", None)]
    got = pairs.hamming_pairs(spark.createDataFrame(rows, "id string, p long"), "id", "p", 6).collect()
    want = {(a, b) for (a, p), (b, q) in itertools.combinations(rows[:-1], 2) if bin((p ^ q) & (1 << 64) - 1).count("1") <= 6}
    assert near((r.left_id, r.right_id) for r in got) == near(want) and {(r.left_id, r.right_id) for r in got} <= want
    assert spark.range(1).select(hamming(F.lit(7), F.lit(-1))).first()[0] == 61


def test_simhash_of_alike_texts():
    a, b = (simhash_of([t[k : k + 2] for k in range(len(t) - 1)]) for t in ("数据治理平台需要执行文本去重处理", "数据治理平台需要进行文本去重处理"))
    assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 12 and simhash_of([]) == 0


def test_jaccard_is_exact(spark):
    rng, rows = random.Random(2), []
    for k in range(25):
        words = [rng.choice(["alpha", "bravo", "delta", "golf", "hotel", "india", "kilo"]) + str(rng.randint(0, 9)) for _ in range(14)]
        rows += [(f"a{k}", " ".join(words)), (f"b{k}", " ".join(words[: rng.randint(9, 14)])), (f"c{k}", " ".join([*words[:7], *reversed(words[7:])]))]
    rows += [("n", None), ("s", "short"), ("dup", rows[0][1]), ("dup", rows[0][1])]
    gram = lambda t: {"".join(t.split())[i : i + 5] for i in range(len("".join(t.split())) - 4)}
    live = {i: gram(t) for i, t in rows if t and len(t) >= 40}
    want = {(x, y) for x, y in itertools.combinations(sorted(live), 2) if len(live[x] & live[y]) >= 0.6 * len(live[x] | live[y])}
    got = {(r.left_id, r.right_id) for r in pairs.jaccard_pairs(spark.createDataFrame(rows, "id string, t string"), "id", "t", 0.6).collect()}
    assert got <= want and near(got) == near(want)


def test_cosine_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 7)
    rng = random.Random(3)
    rows = [(f"v{k:02}", [rng.gauss(0, 1) for _ in range(6)]) for k in range(30)] + [("zero", [0.0] * 6), ("null", None)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(a, b) for (a, u), (b, v) in itertools.combinations(rows[:30], 2) if dot(u, v) >= 0.5 * (dot(u, u) * dot(v, v)) ** 0.5}
    got = {(r.left_id, r.right_id) for r in pairs.cosine_pairs(spark.createDataFrame(rows, "id string, v array<double>"), "id", "v", 0.5).collect()}
    assert got == want


def test_fusion_groups_and_best_sample(spark):
    edges = [("b", "a", 0.8, "r2", "near", "minhash_lsh_deduplicator"), ("a", "b", 1.0, "r1", "exact", "exact_hash"), ("b", "c", 0.9, "r2", "near", "minhash_lsh_deduplicator"), ("x", "y", 0.5, "r3", "near", "other"), ("10", "9", 0.99, "r4", "near", "other"), ("z", "z", 1.0, "r5", "exact", "exact_hash")]
    df = spark.createDataFrame(edges, "left_id string, right_id string, score double, reason string, duplicate_type string, operator string")
    fused = clusters.fuse(df)
    ab = fused.where("left_id = 'a' and right_id = 'b'").first()
    assert (ab.score, ab.reasons, ab.duplicate_type) == (1.0, ["r1", "r2"], "exact")
    items = spark.createDataFrame([("a", 3), ("b", 9), ("c", 9), ("x", 1), ("y", 1), ("10", 5), ("9", 5)], "id string, q int")
    groups = clusters.duplicate_groups(items, fused, 0.75)
    got = {(r.duplicate_group_id, r.id, r.duplicate_type) for r in groups.collect()}
    assert got == {("dup_group_000001", "10", "near"), ("dup_group_000001", "9", "near"), ("dup_group_000002", "a", "exact"), ("dup_group_000002", "b", "exact"), ("dup_group_000002", "c", "exact")}
    chosen = clusters.select_best(groups, items, F.col("q"))
    acted = {r.id: r.action for r in clusters.apply_actions(items, chosen).collect()}
    assert acted == {"a": "remove", "b": "keep", "c": "remove", "x": "keep", "y": "keep", "10": "keep", "9": "remove"}


def test_branches_and_resume(spark):
    one = spark.createDataFrame([("a", ["x"], "keep"), ("b", None, "pending")], "id string, issues array<string>, action string")
    two = spark.createDataFrame([("a", ["y", "x"], "review")], one.schema)
    got = {r.id: (r.issues, r.action) for r in clusters.merge_branches([one, two]).collect()}
    assert got == {"a": (["x", "y"], "review"), "b": ([], "pending")}
    assert [r.id for r in clusters.resume(one, two).collect()] == ["b"]
