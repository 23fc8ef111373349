"""Texts assigned to containers of a fixed number of tokens with little space left.

Method: the histogram of lengths goes to the driver (one number for each length up to the capacity, whatever the rows). For every length, shallow
combinations (at most three different lengths, each as often as needed) that fill a window below the capacity are enumerated, and the best filled are
kept. Non-negative least squares tell how often each is to be repeated so that the histogram is met, the numbers are rounded
down, and what the rounding leaves is packed greedily, longest first. Of a few shares of the numbers the one that ends in the fewest containers is taken. The texts are then numbered within their length, and the number gives the container.

A text longer than the capacity is split into full containers and one rest, which is filled like any other; no other text is split.
Null and blank texts have no tokens and are in no container. An empty table gives no containers.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.llm.tokens import token_counts
from sparkloom.plans.shared import Scratch

#: Space that a combination may leave, of the capacity; combinations kept a length; second lengths tried a length.
WINDOW, KEPT, SECONDS = 0.01, 6, 24
#: Sweeps of the least squares.
SWEEPS = 40
#: Shares of the numbers of repeats that are rounded down.
ROUNDINGS = (1.0, 0.8, 0.6, 0.4, 0.2, 0.1)
#: Parts that the texts of one length are numbered in.
BUCKETS = 64


def combinations(sizes: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """For every size a the best filled of: a i times, b j times and c k times, b and c no longer than a. Longest a first, for they find the fewest partners."""
    spread = np.unique(np.linspace(0, len(sizes) - 1, min(SECONDS, len(sizes))).astype(int))
    out: dict[tuple, None] = {}
    for a, size in reversed([*enumerate(sizes.tolist())]):
        most = capacity // size
        tried = []
        for i in sorted({1, 2, most - 1, most} & set(range(1, most + 1))):
            left = capacity - i * size
            tried.append((left, ((size, i),)))
            b = np.unique(np.append(spread[spread < a], a - 1)) if a else np.zeros(0, int)
            b = b[sizes[b] <= left]
            for j in (1, 2, None):
                n = left // sizes[b] if j is None else np.full(len(b), j)
                rest = left - n * sizes[b]
                for k in (1, 2, 3, 5, 8):  # c is the longest that fits k times
                    c = np.searchsorted(sizes[: a + 1], rest // k, "right") - 1
                    ok = np.flatnonzero((rest >= 0) & (c >= 0) & (n > 0))
                    space = rest[ok] - k * sizes[c[ok]]
                    for x in np.argsort(space, kind="stable")[:2].tolist():
                        o = ok[x]
                        tried.append((int(space[x]), ((size, i), (int(sizes[b[o]]), int(n[o])), (int(sizes[c[o]]), k))))
        tried.sort(key=lambda t: t[0])
        for space, parts in [t for t in tried if t[0] <= WINDOW * capacity][:KEPT] or tried[:1]:
            filling: dict[int, int] = {}
            for s, n in parts:
                filling[s] = filling.get(s, 0) + n
            out[tuple(sorted(filling.items()))] = None
    return [dict(f) for f in out]


def nnls(columns: list[dict[int, int]], target: dict[int, int]) -> list[float]:
    """x >= 0 that minimises |W (A x - b)| by coordinate descent; a column has few entries, so a step is a few sums. W is the length: what is left over of
    short lengths finds a place anywhere."""
    left = {k: float(v) for k, v in target.items()}
    x = [0.0] * len(columns)
    norm = [sum((m * s) ** 2 for s, m in c.items()) for c in columns]
    for _ in range(SWEEPS):
        moved = 0.0
        for k, c in enumerate(columns):
            step = max(-x[k], sum(m * s * s * left[s] for s, m in c.items()) / norm[k])
            if step:
                x[k] += step
                for s, m in c.items():
                    left[s] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return x


def longest_first(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(filling, times) until nothing is left."""
    left = {k: v for k, v in left.items() if v}
    order, out = sorted(left), []
    while order:
        filling: dict[int, int] = {}
        space, k = capacity, len(order)
        while space and (k := bisect_right(order, space, 0, k)):
            size = order[k - 1]
            fit = min(space // size, left[size] - filling.get(size, 0))
            if fit:
                filling[size] = fit
                space -= fit * size
            k -= 1
        times = min(left[s] // m for s, m in filling.items())
        for s, m in filling.items():
            left[s] -= m * times
            if not left[s]:
                order.remove(s)
        out.append((filling, times))
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(filling, times) until nothing is left."""
    columns = combinations(np.array(sorted(counts)), capacity)
    x = nnls(columns, counts)
    best: list[tuple[dict[int, int], int]] = []
    for share in ROUNDINGS:
        left, out = dict(counts), []
        for k in sorted(range(len(x)), key=lambda k: -x[k]):
            times = min(int(x[k] * share), *(left[s] // m for s, m in columns[k].items()))
            if times > 0:
                out.append((columns[k], times))
                for s, m in columns[k].items():
                    left[s] -= m * times
        out += longest_first(left, capacity)
        if not best or sum(t for _, t in out) < sum(t for _, t in best):
            best = out
    return best


def fill(sizes: DataFrame, capacity: int, work: Scratch) -> DataFrame:
    """(id, part, first_token, tokens, container_id) of (id, n)."""
    cut = F.expr(f"transform(sequence(0L, (n - 1) div {capacity}L), k -> struct(k as part, k * {capacity}L as first_token, least({capacity}L, n - k * {capacity}L) as tokens))")
    parts = sizes.select("id", F.explode(cut).alias("p")).select("id", "p.*")
    whole = parts.where(F.col("tokens") == capacity).withColumn("container_id", F.concat_ws("-", F.lit("full"), "id", "part"))
    rest = parts.where(F.col("tokens") < capacity)
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    rest = work.keep(rest.withColumn("place", F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("id", "part")) - 1))
    held = rest.groupBy("tokens", "bucket").count().collect()
    base, counts = {}, {}
    for r in sorted(held, key=lambda r: (r["tokens"], r["bucket"])):
        base[r["tokens"], r["bucket"]] = counts.get(r["tokens"], 0)
        counts[r["tokens"]] = counts.get(r["tokens"], 0) + r["count"]
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used, first = dict.fromkeys(counts, 0), 0
    for filling, times in plan(counts, capacity):
        for s, m in filling.items():
            slots.setdefault(s, []).append((used[s], first, m))
            used[s] += m * times
        first += times

    def place(it):
        for pdf in it:
            cid = []
            for s, b, k in zip(pdf["tokens"], pdf["bucket"], pdf["place"]):
                rank = base[s, b] + k
                own = slots[s]
                start, c, m = own[bisect_right(own, rank, key=lambda x: x[0]) - 1]
                cid.append(str(c + (rank - start) // m))
            yield pd.DataFrame({"id": pdf["id"], "part": pdf["part"], "first_token": pdf["first_token"], "tokens": pdf["tokens"], "container_id": cid})

    kind = dict(sizes.dtypes)["id"]
    return whole.unionByName(rest.mapInPandas(place, f"id {kind}, part long, first_token long, tokens long, container_id string"))


def p7_packed(spark, sf_dir: str) -> DataFrame:
    """(container, container_id, doc_id, part, first_token, tokens)."""
    work = Scratch(spark, "containers")
    sizes = work.keep(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    out = None
    for r in spark.read.parquet(f"{sf_dir}/container_spec.parquet").collect():
        one = fill(sizes, r["capacity_tokens"], work).select(F.lit(r["container"]).alias("container"), "container_id", F.col("id").alias("doc_id"), "part", "first_token", "tokens")
        out = one if out is None else out.unionByName(one)
    return out
