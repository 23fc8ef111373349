"""Pairs of records whose word sets have a similarity (shared over all distinct words) of at least 7/10, exactly.

Method: partition of the universe and pigeonhole. Words are dealt by hash to m segments, m set by bands of set sizes. Two sets of sizes s <= l reach
the threshold only if they differ in at most H(s, l) words. Grant H + 1 steps to the segments of the larger set, at most two each: a segment with one step
has to be equal, one with two steps may differ in one word. If every segment broke its grant, the sets would differ in more than H words; so
at least one segment meets. The smaller set is indexed with every segment and every segment less one word; the larger looks up
the segments it granted steps to, less one word where it granted two.

* Allocation by cost: a step costs the signatures it adds and the sets it will meet by chance (frequencies of its words), and the H + 1 cheapest steps
  are taken. The choice costs or saves candidates, never pairs.
* Signatures travel as blocks: sorted 24-bit keys within a bucket as differences, local row numbers and, once a row and block, the size and a 128-bit
  parity sketch. The sketches of two sets differ in no more bits than the sets do in words, so what differs in more than H bits is dropped
  where it meets; the rest is verified on the words themselves.
* A key that many sets share is cut into tiles, which are spread over the tasks.
* Equal word sets are worked on once and spread to their ids by joins at the end; no group is gathered in one row.

Null ids, null texts and texts without a word are in no pair; an id that is delivered again counts once per text. Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.plans.shared import Scratch

#: Frequent words whose counts every task gets; all others count as rarer. Bounds the broadcast, not the result.
HOT_WORDS = 4000
#: Sizes of a band: hi <= BAND * lo. A set looks into at most two bands.
BAND = 1.43
#: Segments for each step to be granted: 0.5 would leave no choice between them.
SPARE = 0.6
#: Cost of a signature, in sets met by chance.
SIGNATURE = 2.0
#: Sets of a block, and meetings of one key in a tile.
BLOCK, TILE = 20_000, 4_000_000
#: Signatures of a bucket, about; sets the number of buckets by the number of sets.
BUCKET = 6_000_000


def least_shared(n: int) -> int:
    """Words that two sets must share if their sizes add up to n: 10 o >= 7 (n - o)."""
    return -(-7 * n // 17)


def most_apart(s: int, l: int) -> int:  # noqa: E741
    return s + l - 2 * least_shared(s + l)


def smallest(l: int) -> int:  # noqa: E741
    return -(-7 * l // 10)


@lru_cache(None)
def size_band(s: int) -> tuple[int, int, int]:
    """(lo, hi, segments) of the band that holds size s."""
    lo = 1
    while (hi := int(lo * BAND)) < s:
        lo = hi + 1
    steps = most_apart(hi, 10 * hi // 7) + 3
    return lo, hi, max(1, -int(-SPARE * steps // 1))


@lru_cache(None)
def lookups(l: int) -> list[tuple[int, int, int]]:  # noqa: E741
    """(lo, segments, H) of the bands that a set of size l must look into."""
    out, s = [], smallest(l)
    while s <= l:
        lo, hi, m = size_band(s)
        out.append((lo, m, max(most_apart(x, l) for x in range(s, min(hi, l) + 1))))
        s = hi + 1
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Sets:
    """Word sets of one block, laid flat."""

    def __init__(self, words: list[np.ndarray]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.h = np.concatenate(words).astype(np.int64).view(np.uint64)
        place = _mix(self.h + np.uint64(77)) >> np.uint64(57)
        bit = np.left_shift(np.uint64(1), place & np.uint64(63))
        self.sketch = [np.bitwise_xor.reduceat(np.where((place >> np.uint64(6)) == np.uint64(k), bit, np.uint64(0)), self.start[:-1]) for k in (0, 1)]

    def flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position in h) of every word of the rows."""
        n = self.size[rows]
        first = np.cumsum(n) - n
        return np.repeat(np.arange(len(rows)), n), np.arange(n.sum()) + np.repeat(self.start[rows] - first, n)

    def segments(self, rows: np.ndarray, lo: int, m: int):
        """row and cell (row * m + segment) of each word; key of each cell; key of each word's cell without it; word positions."""
        row, at = self.flat(rows)
        h = self.h[at]
        cell = row * m + (_mix(h + np.uint64(lo)) % np.uint64(m)).astype(np.int64)
        worth = _mix(h)
        whole = np.zeros(len(rows) * m, np.uint64)
        np.add.at(whole, cell, worth)
        salt = np.tile(_mix(np.arange(m, dtype=np.uint64) + np.uint64(lo << 20)), len(rows))
        return row, cell, _mix(whole + salt), _mix(whole[cell] - worth + salt[cell]), at


#: Kinds of signatures: indexed segments, indexed less a word; looked up: equal only, equal or one word more, less a word.
WHOLE, LESS, SAME, NEAR, SHORT = range(5)


def _index(sets: _Sets):
    bands: dict[tuple, list[int]] = {}
    for k, s in enumerate(sets.size.tolist()):
        bands.setdefault(size_band(s), []).append(k)
    for (lo, _, m), rows in bands.items():
        rows = np.array(rows)
        row, _, whole, less, _ = sets.segments(rows, lo, m)
        yield WHOLE, whole, np.repeat(rows, m)
        yield LESS, less, rows[row]


def _look_up(sets: _Sets, weight: np.ndarray, total: int):
    jobs: dict[tuple, list[int]] = {}
    for k, s in enumerate(sets.size.tolist()):
        for j in lookups(s):
            jobs.setdefault(j, []).append(k)
    for (lo, m, apart), rows in jobs.items():
        rows = np.array(rows)
        n, steps = len(rows), apart + 1
        row, cell, whole, less, at = sets.segments(rows, lo, m)
        p = weight[at]
        met = 0.05 * total * np.exp(np.bincount(cell, p, n * m))
        one = SIGNATURE + met
        words = np.bincount(cell, minlength=n * m)
        two = np.maximum(one, SIGNATURE * words + 2 * met + np.bincount(cell, met[cell] * np.exp(-p), n * m)) * (1 + 1e-9)
        granted = np.ones((n, 2 * m), bool)
        if steps < 2 * m:
            cost = np.stack([one.reshape(n, m), two.reshape(n, m)], 2).reshape(n, 2 * m)
            granted[:] = False
            np.put_along_axis(granted, np.argpartition(cost, steps - 1, axis=1)[:, :steps], True, 1)
        g = granted.reshape(n, m, 2).sum(2).ravel()  # a second step is never cheaper than the first: the count is what matters
        owner = np.repeat(rows, m)
        yield SAME, whole[g == 1], owner[g == 1]
        yield NEAR, whole[g == 2], owner[g == 2]
        yield SHORT, less[g[cell] == 2], rows[row][g[cell] == 2]


def _pack(a: np.ndarray) -> bytes:
    """Bytes of equal rank stand together."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1) if len(a) else b""


def _unpack(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    if not b:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


BLOCKS = "bucket int, rid binary, size binary, sketch array<binary>, key array<binary>, own array<binary>"
KEY_BITS = 24


def _blocks(hot: dict[int, float], rare: float, total: int, buckets: int):
    known = np.array(sorted(hot), np.int64)
    worth = np.array([hot[k] for k in known.tolist()])

    def weights(h: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(h), rare)
        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[k] == h, worth[k], rare)

    def blocks(rid: np.ndarray, words: list[np.ndarray]):
        sets = _Sets(words)
        parts: list[list] = [[] for _ in range(5)]
        for kind, key, own in (*_index(sets), *_look_up(sets, weights(sets.h.view(np.int64)), total)):
            parts[kind].append((key, own))
        sorted_ = []
        for p in parts:
            key, own = (np.concatenate(x) for x in zip(*p)) if p else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            short = (key >> np.uint64(64 - KEY_BITS)).astype(np.uint32)
            order = np.lexsort((short, bucket))
            sorted_.append((np.searchsorted(bucket[order], np.arange(buckets + 1)), short[order], own[order]))
        for b in range(buckets):
            own = [o[cut[b] : cut[b + 1]] for cut, _, o in sorted_]
            here = np.unique(np.concatenate(own))
            if len(here):
                keys = [_pack(np.diff(k[cut[b] : cut[b + 1]], prepend=np.uint32(0))) for cut, k, _ in sorted_]
                own = [_pack(np.searchsorted(here, o).astype(np.uint16)) for o in own]
                yield b, _pack(np.diff(rid[here], prepend=0)), _pack(sets.size[here].astype(np.uint32)), [_pack(x[here]) for x in sets.sketch], keys, own

    def run(it):
        rids, words = [], []

        def flush():
            rows = list(blocks(np.array(rids, np.int64), words))
            for a in range(0, len(rows), 500):
                yield pd.DataFrame(rows[a : a + 500], columns=["bucket", "rid", "size", "sketch", "key", "own"])

        for pdf in it:
            for r, h in zip(pdf["rid"], pdf["h"]):
                rids.append(r)
                words.append(np.asarray(h))
                if len(rids) == BLOCK:
                    yield from flush()
                    rids, words = [], []
        if rids:
            yield from flush()

    return run


def _fit(ra, sa, x0, x1, rb, sb, y0, y1) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that size and sketch let pass; a is the smaller, ties by rid."""
    ok = np.flatnonzero((sa <= sb) & (10 * sa >= 7 * sb) & ((sa < sb) | (ra < rb)))
    n = (sa + sb)[ok]
    differ = np.bitwise_count(x0[ok] ^ y0[ok]).astype(np.int64) + np.bitwise_count(x1[ok] ^ y1[ok])
    ok = ok[differ <= n - 2 * -(-7 * n // 17)]
    return ra[ok], rb[ok]


class _Side:
    def __init__(self):
        self.key, self.rid, self.size, self.sketch = [], [], [], ([], [])

    def add(self, rid, size, sketch, key: bytes, own: bytes) -> None:
        o = _unpack(own, np.uint16)
        self.key.append(np.cumsum(_unpack(key, np.uint32), dtype=np.uint32))
        self.rid.append(rid[o])
        self.size.append(size[o])
        for held, x in zip(self.sketch, sketch):
            held.append(x[o])

    def sort(self):
        key = np.concatenate(self.key)
        o = np.argsort(key, kind="stable")
        return key[o], *(np.concatenate(x)[o] for x in (self.rid, self.size, *self.sketch))


def _meet(index, probe):
    """(a, b, tile): pairs that meet, in pieces; keys that meet too often become tiles."""
    key, *i = index
    wanted, *p = probe
    a, b = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
    n = b - a
    live = np.flatnonzero(n)
    if not len(live):
        return
    wanted, a, n, p = wanted[live], a[live], n[live], [x[live] for x in p]
    first = np.flatnonzero(np.diff(wanted.astype(np.int64), prepend=-1))
    times = np.diff(np.append(first, len(wanted)))
    big = times * n[first] > TILE
    for f, t in zip(first[big].tolist(), times[big].tolist()):
        side = int(TILE**0.5)
        for x in range(a[f], a[f] + n[f], side):
            for y in range(f, f + t, side):
                left = [_pack(v[x : min(x + side, a[f] + n[f])]) for v in i]
                right = [_pack(v[y : min(y + side, f + t)]) for v in p]
                yield None, None, [*left, *right]
    small = ~np.repeat(big, times)
    a, n, p = a[small], n[small], [x[small] for x in p]
    ends = np.cumsum(n)
    cut = 0
    while cut < len(n):
        upto = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + TILE, "right")))
        m = n[cut:upto]
        e = np.repeat(np.arange(cut, upto), m)
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + a[e]
        yield *_fit(*(v[at] for v in i), *(v[e] for v in p)), None
        cut = upto


def _bucket(sides: list[_Side]):
    s = [v.sort() for v in sides]
    for x, y in ((WHOLE, SAME), (WHOLE, NEAR), (WHOLE, SHORT), (LESS, NEAR)):
        yield from _meet(s[x], s[y])


PAIRS = "a long, b long, tile array<binary>"


def _join(it):
    """Blocks sorted by bucket to pairs and tiles, bucket by bucket."""
    now, sides = None, []

    def flush():
        seen = []
        for a, b, tile in _bucket(sides):
            if tile is not None:
                yield pd.DataFrame({"a": pd.array([None], "Int64"), "b": pd.array([None], "Int64"), "tile": [tile]})
            elif len(a):
                seen.append(np.stack([a, b], 1))
                if sum(map(len, seen)) > TILE:
                    yield _frame(seen)
                    seen = []
        if seen:
            yield _frame(seen)

    for pdf in it:
        for r in pdf.itertuples(index=False):
            if r.bucket != now:
                if sides:
                    yield from flush()
                now, sides = r.bucket, [_Side() for _ in range(5)]
            rid, size = np.cumsum(_unpack(r.rid, np.int64)), _unpack(r.size, np.uint32).astype(np.int64)
            sketch = [_unpack(x, np.uint64) for x in r.sketch]
            for side, key, own in zip(sides, r.key, r.own):
                side.add(rid, size, sketch, key, own)
    if sides:
        yield from flush()


def _frame(seen: list[np.ndarray]) -> pd.DataFrame:
    both = np.unique(np.concatenate(seen), axis=0)
    return pd.DataFrame({"a": pd.array(both[:, 0], "Int64"), "b": pd.array(both[:, 1], "Int64"), "tile": None})


def _untile(it):
    kinds = (np.int64, np.int64, np.uint64, np.uint64)
    for pdf in it:
        for tile in pdf["tile"]:
            left = [_unpack(x, k) for x, k in zip(tile[:4], kinds)]
            right = [_unpack(x, k) for x, k in zip(tile[4:], kinds)]
            n, m = len(left[0]), len(right[0])
            a, b = _fit(*(np.repeat(v, m) for v in left), *(np.tile(v, n) for v in right))
            yield pd.DataFrame({"a": a, "b": b})


def words(text: Column) -> Column:
    """The distinct words in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def _hashes(joined: str) -> Column:
    return F.transform(F.split(joined, " "), lambda x: F.xxhash64(x))


def word_sets(df: DataFrame, id_col: str, text: Column, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rid, w: the words in one string), once per set, and (rid, id)."""
    rows = df.select(F.col(id_col).alias("id"), F.array_join(words(text), " ").alias("w")).where("id is not null and w <> ''")
    rows = work.keep(rows.select("id", "w", F.xxhash64("w").alias("s1"), F.xxhash64(F.lit(1), "w").alias("s2")))
    once = rows.groupBy("s1", "s2").agg(F.min("w").alias("w"), F.max("w").alias("v"))
    same = F.when(F.col("w") == F.col("v"), F.col("w")).otherwise(F.raise_error(F.lit("two word sets share a 128-bit hash")).cast("string"))
    sets = work.keep(once.select(F.monotonically_increasing_id().alias("rid"), same.alias("w"), "s1", "s2"))
    members = work.keep(rows.select("id", "s1", "s2").distinct().join(sets.select("rid", "s1", "s2"), ["s1", "s2"]).select("rid", "id"))
    work.drop(rows)
    return sets.select("rid", "w"), members


def candidates(sets: DataFrame, work: Scratch) -> DataFrame:
    """(a, b) of sets that the index lets meet, a the smaller one; every pair that reaches the threshold is among them."""
    hashed = sets.select("rid", _hashes("w").alias("h"))
    counts = hashed.select(F.explode("h").alias("h")).groupBy("h").count().orderBy(F.desc("count"), "h").limit(HOT_WORDS).collect()
    total = sets.count()
    hot = {r["h"]: float(np.log(r["count"] / max(1, total))) for r in counts}
    rare = min([0.0, *hot.values()])
    spark = sets.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 160 * total // BUCKET + 1)
    made = hashed.mapInPandas(_blocks(hot, rare, total, buckets), BLOCKS)
    met = work.keep(made.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(_join, PAIRS))
    tiles = met.where("tile is not null").select("tile").repartition(buckets).mapInPandas(_untile, "a long, b long")
    return met.where("tile is null").select("a", "b").unionByName(tiles).distinct()


def similar_pairs(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id_a, id_b) with id_a < id_b."""
    work = Scratch(df.sparkSession, "similar")
    sets, members = word_sets(df, id_col, text, work)
    cand = work.keep(candidates(sets, work))
    split = lambda c: F.split(F.col(c), " ")
    both = cand.join(sets.select(F.col("rid").alias("a"), F.col("w").alias("wa")), "a").join(sets.select(F.col("rid").alias("b"), F.col("w").alias("wb")), "b")
    shared = F.size(F.array_intersect(split("wa"), split("wb")))
    true = work.keep(both.where(17 * shared >= 7 * (F.size(split("wa")) + F.size(split("wb")))).select("a", "b"))
    x, y = members.select(F.col("rid").alias("a"), F.col("id").alias("x")), members.select(F.col("rid").alias("b"), F.col("id").alias("y"))
    across = true.join(x, "a").join(y, "b").where("x <> y").select("x", "y")
    within = x.join(y, x["a"] == y["b"]).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p4_found(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/dedup_input.parquet").select("id", F.col("payload.text").alias("text"))
    return similar_pairs(d, "id", F.col("text"))
