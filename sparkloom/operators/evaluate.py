"""Evaluation of text datasets: ten checks, score, level, action, suggestions; then the summary over all rows.

All checks are native expressions over one row, but for the share of duplicates, which is an aggregate joined back. ``rules`` overrides thresholds. Null texts
count as empty; an empty table gives an empty result and a summary of zeros.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions import tables
from sparkloom.functions.chars import ALNUM, CJK, SPACE, count, let, penalty, strip, text_or_empty, when_issues
from sparkloom.functions.normalize import eval_key
from sparkloom.plans.hot import join_groups

RULES = {"min_length": 10, "max_length": 2000, "max_abnormal_ratio": 0.3, "max_char_ratio": 0.6, "max_ellipsis_repeat": 6, "max_period_repeat": 3, "max_repeat": 2}
CHECKS = ("schema", "completeness", "length", "unicode", "duplicates", "low_quality", "consecutive", "special", "pairing", "label")
# Characters that a text may hold, runs that are looked at, runs that are fine, and residues of wrong decoding.
PLAIN_MARKS = "，。！？；：、“”‘’（）《》,.!?;:-_()[]{}<>/\\@#%&+=*'\""
RUN_MARKS = "!?.,;:，。！？；：、…~～"
FINE_RUNS = ("?!", "!?", "！？", "？！", "!？", "！?", "!!!", "???", "！！", "？？", "……")
INVISIBLE = r"\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}\x{AD}"
RESIDUES = ("ï»¿", "â€™", "â€œ", "â€\x9d", "â€¦", "Â", "Ã", "¤", "�")
PAIRED = ("()", "[]", "{}", "（）", "【】", "《》", "“”", "‘’")


def _class(chars: str) -> str:
    return "".join(re.escape(c) for c in chars)


def abnormal_ratio(text: Column) -> Column:
    plain = F.regexp_replace(text, f"[{SPACE}{CJK}{ALNUM}{_class(PLAIN_MARKS)}]", "")
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.length(plain) / F.length(text))


def top_char_share(text: Column) -> Column:
    """Share of the most frequent character among those that are no white space."""
    bare = F.regexp_replace(text, f"[{SPACE}]", "")
    most = lambda s: F.array_max(F.transform(F.array_distinct(F.split(s, "")), lambda c: F.when(c == "", 0).otherwise(F.length(s) - F.length(F.replace(s, c, F.lit(""))))))
    return let(bare, lambda s: F.when(F.length(s) == 0, F.lit(0.0)).otherwise(most(s) / F.length(s)))


def punctuation_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{_class(RUN_MARKS)}]{{2,}}"), F.lit(0))


def abnormal_run(run: Column, rules: dict) -> Column:
    one = F.regexp_replace(run, r"^(.)\1*$", "") == ""
    first = F.substring(run, 1, 1)
    most = F.when(first == "…", rules["max_ellipsis_repeat"]).when(first == ".", rules["max_period_repeat"]).otherwise(rules["max_repeat"])
    return ~run.isin(*FINE_RUNS) & (~one | (F.length(run) > most))


def pairing_errors(text: Column) -> Column:
    """struct(unpaired, mismatched): a stack of the opening marks that are still open; straight quotes pair off in turn, and one inside a word is none."""
    marks = "".join(PAIRED)
    loose = F.regexp_replace(text, f"(?<=[{ALNUM}])['\"](?=[{ALNUM}])", "")
    opened = F.create_map(*(F.lit(x) for p in PAIRED for x in (p[1], p[0])))
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("unpaired"), F.lit(0).alias("mismatched"))

    def step(acc: Column, c: Column) -> Column:
        wanted = F.try_element_at(opened, c)
        top = F.substring(acc["open"], -1, 1)
        closing, empty = wanted.isNotNull(), acc["open"] == ""
        shorter = F.when(empty, F.lit("")).otherwise(F.left(acc["open"], F.length(acc["open"]) - 1))
        return F.struct(
            F.when(closing, shorter).otherwise(F.concat(acc["open"], c)).alias("open"),
            (acc["unpaired"] + F.when(closing & empty, 1).otherwise(0)).alias("unpaired"),
            (acc["mismatched"] + F.when(closing & ~empty & (top != wanted), 1).otherwise(0)).alias("mismatched"),
        )

    seen = F.aggregate(F.regexp_extract_all(loose, F.lit(f"[{_class(marks)}]"), F.lit(0)), start, step)
    quotes = count(loose, '"') % 2 + count(loose, "'") % 2
    return let(seen, lambda s: F.struct((s["unpaired"] + F.length(s["open"]) + quotes).alias("unpaired"), s["mismatched"].alias("mismatched")))


def duplicate_sizes(df: DataFrame, key: Column) -> DataFrame:
    """df with duplicate_size: rows of the same key; blank keys count 0."""
    from sparkloom.plans.shared import Scratch

    work = Scratch(df.sparkSession, "evaluate")
    rows = work.keep(df.withColumn("_key", F.xxhash64(key)).withColumn("_key2", F.xxhash64(F.lit(1), key)).withColumn("_blank", key == ""))
    sizes = work.keep(rows.where("not _blank").groupBy("_key", "_key2").agg(F.count(F.lit(1)).alias("duplicate_size")).where("duplicate_size > 1"))
    out = join_groups(rows.where("not _blank"), sizes, ["_key", "_key2"], "duplicate_size", how="left")
    out = out.withColumn("duplicate_size", F.coalesce("duplicate_size", F.lit(1).cast("long"))).unionByName(rows.where("_blank").withColumn("duplicate_size", F.lit(0).cast("long")))
    return out.drop("_key", "_key2", "_blank")


def evaluate_text(df: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "label", checks: tuple[str, ...] = CHECKS, rules: dict | None = None) -> DataFrame:
    """df with the metrics of the checks, issues, score, level, action and suggestions."""
    r = RULES | (rules or {})
    raw, label, ident = F.col(text_col), F.col(label_col), F.col(id_col).cast("string")
    text = text_or_empty(raw)
    blank = strip(text) == ""
    missing = lambda c: c.isNull() | (strip(c.cast("string")) == "")
    found: list[tuple[str, Column]] = []
    out = df
    if "duplicates" in checks:
        out = duplicate_sizes(out, eval_key(raw))
        found.append(("duplicate_text", F.col("duplicate_size") > 1))
    metrics: dict[str, Column] = {"text_length": F.length(text)}
    if "schema" in checks:
        metrics["schema_valid"] = ~missing(ident) & raw.isNotNull()
        found += [("missing_id", missing(ident)), ("missing_text_field", raw.isNull())]
    if "completeness" in checks:
        metrics["completeness"] = F.round(((~missing(ident)).cast("int") + (~blank).cast("int") + (~missing(label)).cast("int")) / 3 * 100, 2)
        found.append(("empty_text", blank))
    if "completeness" in checks or "label" in checks:
        found.append(("missing_label", missing(label)))
    if "length" in checks:
        found += [("too_short", ~blank & (F.length(text) < r["min_length"])), ("too_long", ~blank & (F.length(text) > r["max_length"]))]
    if "unicode" in checks:
        metrics["abnormal_char_ratio"] = abnormal_ratio(text)
        found.append(("abnormal_chars", F.col("abnormal_char_ratio") > r["max_abnormal_ratio"]))
    if "low_quality" in checks:
        metrics["top_char_share"] = top_char_share(text)
        found.append(("high_repetition", (F.col("top_char_share") >= r["max_char_ratio"]) | text.rlike(r"(.{2,8})\1{3,}")))
    if "consecutive" in checks:
        metrics["punctuation_runs"] = punctuation_runs(text)
        metrics["abnormal_runs"] = F.size(F.filter("punctuation_runs", lambda x: abnormal_run(x, r)))
        found.append(("consecutive_punctuation_abnormal", F.col("abnormal_runs") > 0))
    if "special" in checks:
        metrics["control_characters"] = count(text, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]")
        metrics["invisible_characters"] = count(text, f"[{INVISIBLE}]|\\p{{Cf}}")
        metrics["residues"] = sum((count(text, re.escape(x)) for x in RESIDUES), F.lit(0))
        found.append(("special_characters_abnormal", F.col("control_characters") + F.col("invisible_characters") + F.col("residues") > 0))
    if "pairing" in checks:
        metrics["pairing"] = pairing_errors(text)
        found.append(("punctuation_pairing_abnormal", (F.col("pairing.unpaired") > 0) | (F.col("pairing.mismatched") > 0)))
    for name, c in metrics.items():
        out = out.withColumn(name, c)
    return graded(out.withColumn("issues", when_issues(*found)))


def graded(df: DataFrame) -> DataFrame:
    """df (with issues) with score, level, action and suggestions."""
    out = df.withColumn("score", F.round(F.greatest(F.lit(0.0), 100 - penalty(F.col("issues"), tables.PENALTIES, 10)), 2))
    return out.withColumn("level", level(F.col("score"))).withColumn("action", action(F.col("score"), F.col("issues"))).withColumn("suggestions", suggestions(F.col("issues")))


def level(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 60, "Average").otherwise("Poor")


def action(score: Column, issues: Column) -> Column:
    fatal = F.arrays_overlap(issues, F.array(*map(F.lit, tables.FATAL)))
    return F.when(fatal | (score < 50), "drop").when((F.size(issues) > 0) | (score < 75), "review").otherwise("keep")


def suggestions(issues: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in tables.SUGGESTIONS.items() for x in kv))
    return F.filter(F.transform(issues, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull())


def issue_counts(df: DataFrame) -> DataFrame:
    """(issue, n), most frequent first; ties by name."""
    return df.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issue")


def distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


#: Dimensions of the summary: name, issues, weight.
DIMENSIONS = (
    ("completeness", ("missing_id", "missing_text_field", "empty_text", "missing_label"), 0.3),
    ("validity", ("too_short", "too_long", "abnormal_chars", "special_characters_abnormal", "consecutive_punctuation_abnormal", "punctuation_pairing_abnormal"), 0.3),
    ("uniqueness", ("duplicate_text",), 0.2),
    ("content", ("high_repetition",), 0.2),
)


def summarize(df: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """One row: rows, average score, rows by action, a score for each dimension (100 less the issues a hundred rows) and their weighted mean."""
    hits = lambda names: F.sum(F.size(F.filter("issues", lambda x: x.isin(*names))))
    total = F.count(F.lit(1))
    parts = {n: F.greatest(F.lit(0.0), 100 - F.coalesce(hits(i), F.lit(0)) / F.greatest(total, F.lit(1)) * 100) for n, i, _ in dimensions}
    weights = sum(w for _, _, w in dimensions)
    acts = {a: F.sum((F.col("action") == a).cast("long")) for a in ("keep", "review", "drop")}
    row = df.agg(total.alias("rows"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 2).alias("average_score"), *(F.coalesce(c, F.lit(0)).alias(a) for a, c in acts.items()), *(c.alias(f"raw_{n}") for n, c in parts.items()))
    mean = sum((F.col(f"raw_{n}") * w for n, _, w in dimensions), F.lit(0.0)) / weights
    return row.select("rows", "average_score", *acts, *(F.round(f"raw_{n}", 2).alias(f"{n}_score") for n in parts), F.round(mean, 2).alias("weighted_score"))


def worst(df: DataFrame, id_col: str, k: int = 20, below: float = 60) -> DataFrame:
    """The k lowest scores below the bound; ties by id."""
    return df.where(F.col("score") < below).orderBy("score", F.col(id_col)).limit(k)
