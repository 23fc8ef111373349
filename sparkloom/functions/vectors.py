"""Hashed vectors, fingerprints and similarities."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def grams(text: Column, n: int) -> Column:
    """Character n-grams of the text without white space; a text of at most n characters is its only gram."""
    from sparkloom.functions.chars import SPACE, let

    bare = F.regexp_replace(text, f"[{SPACE}]", "")
    return let(bare, lambda s: F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) <= n, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))))


def shingles(text: Column, n: int) -> Column:
    return F.array_distinct(grams(text, n))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays without repeats; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length, held within -1 and 1; 0 if a norm is 0."""
    short = lambda x, y: F.slice(x, 1, F.least(F.size(x), F.size(y)))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    u, v = short(a, b), short(b, a)
    norm = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / norm)))


def _digest(token: str, size: int) -> bytes:
    return hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=size).digest()


def simhash_of(tokens: list[str], bits: int = 64) -> int:
    """Signed 64-bit fingerprint: a bit is set if more token occurrences set it than not."""
    if not tokens:
        return 0
    words = np.frombuffer(b"".join(_digest(t, 8) for t in tokens), dtype=">u8")
    ones = np.array([int(((words >> np.uint64(k)) & np.uint64(1)).sum()) for k in range(min(bits, 64))])
    value = sum(1 << k for k in np.flatnonzero(2 * ones > len(words)).tolist())
    return value - (1 << 64) if value >> 63 else value


def simhash(text: Column, ngram: int = 2, bits: int = 64) -> Column:
    """Fingerprint of the character n-grams of a text without white space; null for a text without any."""

    @F.pandas_udf(T.LongType())
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            bare = "".join((t or "").split())
            if not bare:
                return None
            return simhash_of([bare] if len(bare) <= ngram else [bare[k : k + ngram] for k in range(len(bare) - ngram + 1)], bits)

        return pd.Series([one(t) for t in s], dtype="Int64")

    return run(text)


def hashed(pieces: list[bytes], dim: int) -> list[float]:
    """Signed hashing of the pieces into ``dim`` cells, of length 1 unless all cells are 0."""
    v = np.zeros(dim)
    for p in pieces:
        d = hashlib.blake2b(p, digest_size=16).digest()
        v[int.from_bytes(d[:4], "big") % dim] += 1.0 if d[4] & 1 else -1.0
    norm = float(np.sqrt((v * v).sum()))
    return (v / norm if norm else v).tolist()


def text_vector(text: Column, dim: int = 128) -> Column:
    """Words split at white space; a text of one piece is taken by pairs of characters."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            t = t or ""
            pieces = t.split() or [t[k : k + 2] for k in range(len(t) - 1)]
            out.append(hashed([p.encode("utf-8", "surrogatepass") for p in pieces], dim))
        return pd.Series(out)

    return run(text)


def bytes_vector_of(data: bytes, dim: int = 128, pieces: int = 256) -> list[float]:
    step = max(1, len(data) // pieces)
    return hashed([data[k : k + step] for k in range(0, len(data), step)], dim)
