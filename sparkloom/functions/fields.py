"""Tokens and key fields of captions and recognised text, and how far two texts agree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkloom.functions.chars import CJK, let

# Words that stand for each other.
SYNONYMS = (
    ("chair", "seat", "椅子"), ("plug", "socket", "插头"), ("bicycle", "bike", "自行车"), ("circuit", "pcb", "电路板"), ("desk", "table", "桌面"), ("receiver", "reciever", "接收器"), ("fruit", "水果"), ("toy", "玩具"),
    ("waterhouse", "水屋"), ("book", "书本"), ("printer", "打印机"), ("ball", "球"), ("comproom", "computerroom", "机房"), ("classroom", "教室"), ("planandsofa", "sofa", "plant", "沙发", "植物"),
    ("person", "people", "human", "人物"), ("document", "paper", "sign", "文档", "标牌"),
)
_DATE = r"\d{4}[-年/]\d{1,2}(?:[-月/]\d{1,2})?"


def tokens(text: Column) -> Column:
    """Different words of at least two characters in lower case, and runs of Chinese characters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{CJK}]+|[a-z0-9]{{2,}}"), F.lit(0))
    return F.array_distinct(found)


def expand(words: Column, groups=SYNONYMS) -> Column:
    """The words with all that stand for one of them."""
    more = F.flatten(F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, g))), F.array(*map(F.lit, g))).otherwise(F.array().cast("array<string>")) for g in groups)))
    return F.array_distinct(F.concat(words, more))


def overlap(a: Column, b: Column) -> Column:
    """Share of the (expanded) tokens of a that b has; 0 if either has none."""
    both = F.struct(tokens(a).alias("a"), tokens(b).alias("b"))
    return let(both, lambda t: F.when((F.size(t["a"]) == 0) | (F.size(t["b"]) == 0), 0.0).otherwise(F.size(F.array_intersect(expand(t["a"]), expand(t["b"]))) / F.size(expand(t["a"]))))


def recall(wanted: Column, text: Column) -> Column:
    """Share of the wanted words that the text has (synonyms count); null without wanted words."""
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda w: F.arrays_overlap(expand(F.array(F.lower(w))), expand(tokens(text))))) / F.size(wanted))


def key_fields(text: Column) -> Column:
    """struct(numbers, dates, codes): numbers of 2 to 8 digits that are no part of a date, dates as y-m-d, codes of capitals."""
    up = F.upper(F.coalesce(text, F.lit("")))
    raw = F.regexp_extract_all(up, F.lit(_DATE), F.lit(0))
    parts = F.flatten(F.transform(raw, lambda d: F.regexp_extract_all(d, F.lit(r"\d+"), F.lit(0))))
    dates = F.transform(raw, lambda d: F.array_join(F.transform(F.regexp_extract_all(d, F.lit(r"\d+"), F.lit(0)), lambda x: F.when(F.length(x) < 2, F.concat(F.lit("0"), x)).otherwise(x)), "-"))
    numbers = F.array_except(F.regexp_extract_all(up, F.lit(r"(?<!\d)\d{2,8}(?!\d)"), F.lit(0)), parts)
    codes = F.array_distinct(F.regexp_extract_all(up, F.lit(r"\b[A-Z]{2,}[A-Z0-9-]{0,12}\b"), F.lit(0)))
    return F.struct(F.array_distinct(numbers).alias("numbers"), F.array_distinct(dates).alias("dates"), codes.alias("codes"))


def key_conflicts(a: Column, b: Column) -> Column:
    """struct(compared, conflicts, score): kinds of fields that both texts have, those that share none, and 1 less their share (null if none is compared)."""
    fields = F.struct(key_fields(a).alias("a"), key_fields(b).alias("b"))
    kinds = ("numbers", "dates", "codes")
    both = lambda t, k: (F.size(t["a"][k]) > 0) & (F.size(t["b"][k]) > 0)
    off = lambda t, k: both(t, k) & ~F.arrays_overlap(t["a"][k], t["b"][k])
    n = lambda t, f: sum((f(t, k).cast("int") for k in kinds), F.lit(0))
    return let(fields, lambda t: let(F.struct(n(t, both).alias("c"), n(t, off).alias("x")), lambda s: F.struct(s["c"].alias("compared"), s["x"].alias("conflicts"), F.when(s["c"] > 0, 1 - s["x"] / s["c"]).alias("score"))))
