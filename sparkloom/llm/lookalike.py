"""Texts that look the same but hold different characters, brought to one form.

Method: compatibility mapping in composed form, mapped white space and removal of default-ignorable characters, vectorised over
the distinct values of each Arrow batch. The test data count letter case and signs against their spelled-out form as visible, so full case
folding is the option ``fold_case`` and the compatibility mappings are taken by kind: wide, narrow, no-break, font and presentation forms and
ligatures are mapped, while superscripts, fractions, circled, squared and other signs stay. With ``signs`` all of them are mapped (plain NFKC).

Steps: drop default-ignorable characters, map every single space to U+0020, map compatible forms, decompose, map look-alike letters of other
scripts to Latin ones, compose, strip. Lengths of runs of spaces and line breaks stay as they are.

Null stays null; a text of nothing but invisible characters becomes the empty string, and such texts are equal to each other.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkloom.plans.shared import Scratch

# Letters that look like a Latin one, after canonical decomposition.
CYRILLIC = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ԍ": "G", "Ѵ": "V", "Ӏ": "I"}
GREEK = {"ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J"}
OTHER = {"օ": "o", "ո": "n", "հ": "h", "ս": "u", "ց": "g", "յ": "j", "Տ": "S", "Օ": "O", "ɡ": "g", "ɑ": "a", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "‐": "-", "ʼ": "’"}
CHEROKEE = {"Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B"}
COPTIC = {"Ⲁ": "A", "Ⲃ": "B", "Ⲍ": "Z", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X"}
LISU = {"ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z"}
# The default-ignorable code points of the Unicode standard, as ranges.
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
LINE_BREAKS = "\n\x85  "
#: Kinds of compatibility mapping that do not change what a reader sees.
UNSEEN_KINDS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Ligatures, digraphs and Roman numerals: the same letters, drawn from one code point.
LIGATURES = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xFB00, 0xFB17))


def _within(cp: int, ranges) -> bool:
    return any(a <= cp <= b for a, b in ranges)


class _Forms(dict):
    """The first mapping, worked out per character as it is met."""

    def __init__(self, signs: bool):
        super().__init__()
        self.signs = signs

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        if _within(cp, IGNORABLE):
            out = ""
        elif ch in LINE_BREAKS:
            out = "\n"
        elif ch == "\t" or unicodedata.category(ch) == "Zs":
            out = " "
        else:
            kind, _, parts = unicodedata.decomposition(ch).partition(" ")
            if kind[:1] == "<" and (self.signs or kind in UNSEEN_KINDS or _within(cp, LIGATURES)):
                out = "".join(self[int(p, 16)] for p in parts.split())
            else:
                out = ch
        self[cp] = out
        return out


class _Letters(dict):
    def __missing__(self, cp: int) -> str:
        self[cp] = chr(cp)
        return self[cp]


@cache
def _tables(signs: bool) -> tuple[_Forms, _Letters]:
    return _Forms(signs), _Letters({ord(k): v for k, v in (CYRILLIC | GREEK | OTHER | CHEROKEE | COPTIC | LISU).items()})


def one_form(text: str, fold_case: bool = False, signs: bool = False) -> str:
    forms, letters = _tables(signs)
    text = text.replace("\r\n", "\n").translate(forms)
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(letters))
    text = text.strip(" \n\r")
    return unicodedata.normalize("NFC", text.casefold()) if fold_case else text


def _over_distinct(s: pd.Series, **how) -> pd.Series:
    codes, values = pd.factorize(s)  # nulls are coded -1
    done = [one_form(v, **how) for v in values]
    return pd.Series([done[c] if c >= 0 else None for c in codes], index=s.index, dtype=object)


def canonical(text: Column, fold_case: bool = False, signs: bool = False) -> Column:
    @F.pandas_udf(T.StringType())
    def form(s: pd.Series) -> pd.Series:
        return _over_distinct(s, fold_case=fold_case, signs=signs)

    return form(text)


def forms(df: DataFrame, id_col: str = "id", text_col: str = "text", **how) -> DataFrame:
    """(id, form) of every row."""
    return df.select(F.col(id_col).alias("id"), canonical(F.col(text_col), **how).alias("form"))


#: Rows of one form that one task pairs with others; a form of more is dealt out by hash.
SHARE = 20_000


def equal_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b by bytes: equal forms, different characters.

    The form is worked out and hashed where the text is read; only hashes are shuffled. Only forms that occur with at least two different
    texts reach the join, and pairs are made between texts that differ, never among the copies of one. Two forms that share a 128-bit hash
    but not the third one stop the query. Null ids and null texts are in no pair; an id that is delivered again counts once a text.
    """
    work = Scratch(df.sparkSession, "lookalike")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw")).where("id is not null and raw is not null").withColumn("form", canonical(F.col("raw")))
    hashed = work.keep(rows.select("id", *(F.xxhash64(F.lit(k), c).alias(f"{c[0]}{k}") for c in ("form", "raw") for k in (1, 2)), F.xxhash64(F.lit(3), "form").alias("chk")).distinct())
    by_text = hashed.groupBy("f1", "f2", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min("chk").alias("c0"), F.max("chk").alias("c1"))
    by_form = by_text.groupBy("f1", "f2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    sound = F.when(F.col("c0") == F.col("c1"), F.col("n")).otherwise(F.raise_error(F.lit("two forms share a 128-bit hash")).cast("long"))
    mixed = work.keep(by_form.withColumn("n", sound).where("texts > 1").select("f1", "f2", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")))
    some = work.keep(hashed.join(mixed, ["f1", "f2"]).select("id", "f1", "f2", "r1", "r2", "shares"))
    a = some.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares").cast("long")).cast("int")).alias("a")
    b = some.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).alias("b")
    on = "a.f1 = b.f1 and a.f2 = b.f2 and a.share = b.share and a.id < b.id and (a.r1 <> b.r1 or a.r2 <> b.r2)"
    return a.join(b, F.expr(on)).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def classes(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(form, ids, spellings) of every form: how many ids have it, in how many different texts."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw")).where("id is not null and raw is not null").withColumn("form", canonical(F.col("raw")))
    texts = rows.select("id", "form", F.xxhash64(F.lit(1), "raw").alias("r1"), F.xxhash64(F.lit(2), "raw").alias("r2"))
    return texts.distinct().groupBy("form", "r1", "r2").agg(F.count(F.lit(1)).alias("n")).groupBy("form").agg(F.sum("n").alias("ids"), F.count(F.lit(1)).alias("spellings"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return equal_pairs(spark.read.parquet(f"{sf_dir}/text_sample.parquet"))


def p3_forms(spark, sf_dir: str) -> DataFrame:
    return forms(spark.read.parquet(f"{sf_dir}/text_sample.parquet")).distinct()


def p3_classes(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/text_sample.parquet"))
