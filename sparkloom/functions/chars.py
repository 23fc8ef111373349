"""Character classes, spelled out so that Java regular expressions, RE2 and Python agree on them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What Python's str.isspace takes for white space.
SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ALNUM = r"\p{L}\p{N}"
WORD = r"\p{L}\p{N}_"
CJK = r"\x{4E00}-\x{9FFF}"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(c: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def when_issues(*rules: tuple[str, Column]) -> Column:
    """The names whose condition holds, in this order: one expression, however many rules."""
    return F.filter(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules)), lambda x: x.isNotNull())


def penalty(issues: Column, table: dict[str, float], other: float) -> Column:
    """Sum of the table's values over the issues; ``other`` for one that is not listed."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in (kv[0], float(kv[1]))))
    return F.aggregate(issues, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(known, x), F.lit(float(other))))
