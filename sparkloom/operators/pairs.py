"""Near-duplicate pairs: fingerprints by Hamming distance, n-gram sets by Jaccard, vectors by cosine.

Every join works on distinct keys (equal fingerprints, sets or texts are worked on once) and emits edges (left_id, right_id, score, reason, duplicate_type,
operator) with left_id < right_id as strings. No cross join: Hamming and Jaccard meet by equal bands or prefix grams, which miss no pair;
cosine works in blocks, a stated all-pairs operator.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.vectors import hamming, jaccard, shingles, simhash
from sparkloom.plans.shared import Scratch

EDGE = ("left_id", "right_id", "score", "reason", "duplicate_type", "operator")


def edges(pairs: DataFrame, score: Column, reason: str, kind: str, operator: str) -> DataFrame:
    """Edges of (a, b) rows of ids; pairs of one id are dropped, scores rounded to 6 places."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    return pairs.where(a != b).select(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id"), F.round(score, 6).alias("score"), F.lit(reason).alias("reason"), F.lit(kind).alias("duplicate_type"), F.lit(operator).alias("operator"))


def _stars(members: DataFrame) -> DataFrame:
    """(a, b) from the least id of each key to its other ids."""
    least = members.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(least, "key").where("id <> a").select("a", F.col("id").alias("b"))


def hamming_pairs(df: DataFrame, id_col: str, print_col: str, distance: int, bits: int = 64, ngrams: str = "simhash", operator: str = "simhash_deduplicator", kind: str = "near") -> DataFrame:
    """Pairs of fingerprints at most ``distance`` bits apart.

    distance + 1 bands of bits: two prints that close agree on one band at least. Equal prints are one vertex, its ids
    a star (score 1); pairs of different prints are emitted between the least ids of either. So components are as over all pairs.
    """
    work = Scratch(df.sparkSession, "hamming")
    members = work.keep(work.keep(df.select(F.col(print_col).alias("key"), F.col(id_col).cast("string").alias("id"))).where("key is not null and id is not null").distinct())
    prints = members.groupBy("key").agg(F.min("id").alias("id"))
    n = distance + 1
    cuts = [bits * k // n for k in range(n + 1)]
    band = lambda k: F.shiftrightunsigned(F.shiftleft(F.col("key"), 64 - cuts[k + 1]), 64 - cuts[k + 1] + cuts[k])
    banded = prints.select("key", "id", F.posexplode(F.array(*(band(k) for k in range(n)))).alias("no", "band"))
    x, y = banded.alias("x"), banded.alias("y")
    met = x.join(y, F.expr("x.no = y.no and x.band = y.band and x.key < y.key")).select(F.col("x.key").alias("p"), F.col("y.key").alias("q"), F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    near = met.withColumn("d", hamming(F.col("p"), F.col("q"))).where(F.col("d") <= distance).distinct()
    reason = f"{ngrams}_hamming<={distance}"
    return edges(near, 1 - F.col("d") / bits, reason, kind, operator).unionByName(edges(_stars(members), F.lit(1.0), reason, kind, operator))


def simhash_pairs(df: DataFrame, id_col: str, text_col: str, distance: int = 3, ngram: int = 2) -> DataFrame:
    prints = df.select(F.col(id_col), simhash(F.col(text_col), ngram).alias("_print"))
    return hamming_pairs(prints, id_col, "_print", distance)


def jaccard_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, ngram: int = 5, min_length: int = 40) -> DataFrame:
    """Pairs of texts whose sets of character n-grams reach the threshold, exactly.

    Prefix filter: grams in order of rarity (ties by value); sets as similar share a gram within their first n - ceil(t n) + 1. Sizes must
    agree within the threshold. Candidates are verified on the whole sets. Equal texts are one vertex (a star of score 1).
    """
    work = Scratch(df.sparkSession, "jaccard")
    live = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("key")).where((F.length("key") >= min_length) & F.col("id").isNotNull()).distinct()
    members = work.keep(live)
    sets = work.keep(members.groupBy("key").agg(F.min("id").alias("id")).select("id", F.transform(shingles(F.col("key"), ngram), lambda g: F.xxhash64(g)).alias("grams")))
    flat = sets.select("id", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    often = flat.groupBy("g").agg(F.count(F.lit(1)).alias("f")).where("f > 1")  # a gram that stands once meets nothing
    ranked = flat.join(often, "g").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("by"))
    # grams that stand once would come first: they count into the prefix, but need not be sent
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1 - (F.col("n") - F.size("by"))
    prefix = ranked.where(keep > 0).select("id", "n", F.explode(F.slice("by", F.lit(1), keep.cast("int"))).alias("e")).select("id", "n", F.col("e.g").alias("g"))
    x, y = prefix.alias("x"), prefix.alias("y")
    fits = F.expr(f"x.g = y.g and (x.n < y.n or (x.n = y.n and x.id < y.id)) and x.n >= {threshold}D * y.n")
    cand = x.join(y, fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both = cand.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    near = both.withColumn("s", jaccard(F.col("ga"), F.col("gb"))).where(F.col("s") >= threshold)
    reason = f"minhash_jaccard>={threshold}"
    return edges(near, F.col("s"), reason, "near", "minhash_lsh_deduplicator").unionByName(edges(_stars(members), F.lit(1.0), reason, "near", "minhash_lsh_deduplicator"))


#: Vectors of a block of the cosine join; a task holds two blocks.
BLOCK = 4096


def cosine_pairs(df: DataFrame, id_col: str, vec_col: str, threshold: float, top_k: int | None = None, operator: str = "ann_recall", kind: str = "semantic") -> DataFrame:
    """Pairs of vectors with a cosine of at least ``threshold``, exact, in blocks: every pair of blocks is one task's matrix product.

    The number of block pairs grows with the square of the rows (the operator is all-pairs by definition); blocks keep memory bounded and
    spread the work. With ``top_k`` the highest pairs of all. Null vectors are in no pair; a vector of zeros is similar to nothing.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    n = rows.count()
    blocks = max(1, -(-n // BLOCK))
    held = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    first, second = F.least("own", F.col("o")), F.greatest("own", F.col("o"))
    sent = held.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("i", first).withColumn("j", second)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])

        def side(b):
            part = pdf[pdf["own"] == b]
            width = max(map(len, pdf["v"]), default=0)
            m = np.zeros((len(part), width))
            for k, v in enumerate(part["v"]):
                m[k, : len(v)] = v
            norm = np.sqrt((m * m).sum(1))
            return part["id"].to_numpy(), np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)

        (ids, a), (jds, b) = side(i), side(j)
        s = np.clip(a @ b.T, -1, 1)
        x, y = np.nonzero(s >= threshold)
        out = pd.DataFrame({"a": ids[x], "b": jds[y], "s": s[x, y]})
        return out[out["a"] < out["b"]] if i == j else out

    near = sent.groupBy("i", "j").applyInPandas(multiply, "a string, b string, s double")
    out = edges(near, F.col("s"), f"cosine>={threshold}", kind, operator)
    return out if top_k is None else out.orderBy(F.desc("score"), "left_id", "right_id").limit(top_k)


def rerank(edge: DataFrame, texts: DataFrame, id_col: str, text_col: str, threshold: float = 0.85) -> DataFrame:
    """Edges whose better of their own score and the Jaccard similarity of character triples reaches the threshold; the reason notes it."""
    t = texts.select(F.col(id_col).cast("string").alias("id"), shingles(F.coalesce(F.col(text_col), F.lit("")), 3).alias("g"))
    both = edge.join(t.select(F.col("id").alias("left_id"), F.col("g").alias("ga")), "left_id").join(t.select(F.col("id").alias("right_id"), F.col("g").alias("gb")), "right_id")
    scored = both.withColumn("score", F.round(F.greatest("score", jaccard(F.col("ga"), F.col("gb"))), 6))
    return scored.where(F.col("score") >= threshold).withColumn("reason", F.lit("lexical_rerank_fallback")).withColumn("operator", F.lit("cross_encoder_rerank")).select(*EDGE)
