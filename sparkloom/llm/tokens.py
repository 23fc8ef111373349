"""Sizes of texts in tokens of a public byte-level tokenizer (public_tokenizers/byte_bpe_multi_50k)."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F


@lru_cache(1)
def encoding():
    import base64

    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("multi", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, *extra: str) -> DataFrame:
    """(id, extra..., n) of the rows whose text is not null or blank."""

    def run(it):
        for pdf in it:
            yield pdf.drop(columns="text").assign(n=pd.Series([len(encoding().encode_ordinary(t)) for t in pdf["text"]], index=pdf.index, dtype="int64"))

    rows = df.where(F.col(text_col).rlike(r"\S")).select(F.col(id_col).alias("id"), *extra, F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("id", *extra)) + ", n long")
