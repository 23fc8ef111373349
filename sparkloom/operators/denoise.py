"""Denoising of texts, images, image-text pairs and videos: steps that each add metrics and issues, a score, and the gate.

A step is a function of a DataFrame with ``text`` and ``issues``; ``denoise_text`` chains them. Steps are narrow (no shuffle). Null texts count as empty. The language step
passes the languages it is given; none is built in.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions import normalize as N, tables
from sparkloom.functions.chars import CJK, SPACE, WORD, count, let, penalty, strip
from sparkloom.functions.pii import masked



def start(df: DataFrame, text_col: str = "text") -> DataFrame:
    out = df.withColumn("text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return out if "issues" in out.columns else out.withColumn("issues", F.array().cast("array<string>"))


def flag(df: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """df with the names of the rules that hold added to issues, none twice."""
    new = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules)), lambda x: x.isNotNull())
    return df.withColumn("issues", F.array_distinct(F.concat("issues", new)))


def _changed(df: DataFrame, to: Column, issue: str) -> DataFrame:
    out = df.withColumn("_to", F.explode(F.array(to)))  # past a generator the new text is not worked out again for each use
    return flag(out, (issue, F.col("_to") != F.col("text"))).withColumn("text", F.col("_to")).drop("_to")


def garbled_score(text: Column) -> Column:
    return sum((count(text, m) for m in tables.GARBLED), F.lit(0)) + count(text, r"[\x{80}-\x{9F}]")


def _plausible(text: str) -> float:
    """How much of a text reads as text: letters and digits, Chinese counted once more, signs of garbling off."""
    n = max(len(text), 1)
    useful = sum(c.isalnum() or c == "_" for c in text) / n
    chinese = sum("一" <= c <= "鿿" for c in text) / n
    garbled = (sum(text.count(m) for m in tables.GARBLED) + sum("\x80" <= c <= "\x9f" for c in text)) / n
    return useful + min(chinese, 0.6) - min(garbled, 0.8)


def _reread(text: str) -> str:
    best, top = text, _plausible(text)
    for table, to in (("latin-1", "utf-8"), ("cp1252", "utf-8"), ("latin-1", "gb18030")):
        try:
            again = text.encode(table).decode(to)
        except UnicodeError:
            continue
        if (p := _plausible(again)) >= top + 0.15:
            best, top = again, p
    return best


_reread_batch = N._batch(lambda t: t if t.isascii() else _reread(t))


def encoding_detect(df: DataFrame) -> DataFrame:
    """Texts that read better through another table are replaced; what stays garbled is flagged."""
    out = _changed(df, _reread_batch(F.col("text")), "mojibake_repaired")
    out = out.withColumn("mojibake_score", garbled_score(F.col("text")))
    return flag(out, ("possible_mojibake", F.col("mojibake_score") >= 3))


def unicode_repair(df: DataFrame) -> DataFrame:
    return _changed(df, N.repair_unicode(F.col("text")), "unicode_repaired")


def chinese_normalize(df: DataFrame, join: bool = True) -> DataFrame:
    return _changed(df, N.normalize_chinese(F.col("text"), join), "chinese_normalized")


def whitespace_normalize(df: DataFrame) -> DataFrame:
    return _changed(df, N.normalize_space(F.col("text")), "text_normalized")


def html_clean(df: DataFrame) -> DataFrame:
    return _changed(df, N.clean_html(F.col("text")), "html_or_url_removed")


def markdown_clean(df: DataFrame) -> DataFrame:
    return _changed(df, N.clean_markdown(F.col("text")), "markdown_noise_removed")


def language_detect(df: DataFrame, allowed: tuple[str, ...] = ("zh", "mixed", "en"), mixed_from: float = 0.12) -> DataFrame:
    """language by script: zh, en (Latin letters), mixed, or unknown below four letters."""
    han, latin = count(F.col("text"), f"[{CJK}]"), count(F.col("text"), "[A-Za-z]")
    share = F.least(han, latin) / F.greatest(han + latin, F.lit(1))
    lang = F.when(han + latin < 4, "unknown").when(share >= mixed_from, "mixed").when(han >= latin, "zh").otherwise("en")
    out = df.withColumn("language", lang)
    return flag(out, ("language_unknown", F.col("language") == "unknown"), ("language_mismatch", (F.col("language") != "unknown") & ~F.col("language").isin(*allowed)))


def length_filter(df: DataFrame, least: int = 12, most: int = 2000) -> DataFrame:
    n = F.length("text")
    return flag(df.withColumn("text_length", n), ("empty_text", n == 0), ("too_short", (n > 0) & (n < least)), ("too_long", n > most))


def char_run_share(text: Column) -> Column:
    """Longest run of one character over the length: runs are cut by a pattern, not counted character by character."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)(.)\1*"), F.lit(0))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.array_max(F.transform(runs, F.length)) / F.length(text))


def triple_repetition(text: Column) -> Column:
    """1 less the share of different word triples; 0 below six words."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), F.lit(0))
    three = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - 2), lambda i: F.array_join(F.slice(t, i, 3), " "))
    return let(toks, lambda t: F.when(F.size(t) < 6, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(three(t))) / (F.size(t) - 2)))


def chunk_share(t: str | None) -> float:
    """Share of the most frequent piece when a text is cut into pieces of 1, 2, ... 12 characters: the largest over these sizes."""
    from collections import Counter

    best = 0.0
    if t and len(t) >= 8:
        for unit in range(1, min(12, max(2, len(t) // 2)) + 1):
            n = len(t) // unit
            if n >= 3:
                best = max(best, Counter(t[k * unit : (k + 1) * unit] for k in range(n)).most_common(1)[0][1] / n)
    return best


def chunk_repetition(text: Column) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(chunk_share)

    return run(text)


def repetition_filter(df: DataFrame, most: float = 0.35) -> DataFrame:
    bare = F.regexp_replace("text", f"[{SPACE},，。.!！?？;；:：、]+", "")
    ratio = F.greatest(char_run_share(F.col("text")), triple_repetition(F.col("text")), chunk_repetition(bare))
    return flag(df.withColumn("repetition_ratio", ratio), ("high_repetition", F.col("repetition_ratio") > most))


def info_density(text: Column) -> Column:
    useful = F.regexp_replace(text, f"[^{WORD}]", "")
    return let(useful, lambda u: F.struct((F.length(u) / F.greatest(F.length(text), F.lit(1))).alias("density"), (F.size(F.filter(F.array_distinct(F.split(u, "")), lambda c: c != "")) / F.greatest(F.length(u), F.lit(1))).alias("unique")))


def info_density_filter(df: DataFrame, density: float = 0.28, unique: float = 0.06) -> DataFrame:
    out = df.withColumn("_d", info_density(F.col("text")))
    out = out.withColumn("info_density", F.col("_d.density")).withColumn("unique_char_ratio", F.col("_d.unique")).drop("_d")
    return flag(out, ("low_info_density", (F.col("info_density") < density) | (F.col("unique_char_ratio") < unique)))


def sensitive_detect(df: DataFrame) -> DataFrame:
    """Personal data are masked; masked_types lists the kinds."""
    out = df.withColumn("_m", masked(F.col("text")))
    out = out.withColumn("text", F.coalesce("_m.text", F.lit(""))).withColumn("masked_types", F.col("_m.kinds")).drop("_m")
    return flag(out, ("text_sensitive_masked", F.size("masked_types") > 0))


def risky_words(df: DataFrame, categories: dict[str, tuple[str, ...]] = tables.RISKY) -> DataFrame:
    bare = F.regexp_replace(F.lower(N.nfkc(F.col("text"))), r"[^\p{L}\p{N}]+", "")
    fold = lambda w: "".join(c for c in unicodedata.normalize("NFKC", w).lower() if c.isalnum())
    hits = F.array(*(F.when(functools.reduce(lambda a, b: a | b, (F.col("_bare").contains(fold(w)) for w in words)), F.lit(name)) for name, words in categories.items()))
    out = df.withColumn("_bare", bare).withColumn("sensitive_categories", F.filter(hits, lambda x: x.isNotNull())).drop("_bare")
    return flag(out, ("sensitive_risk", F.size("sensitive_categories") > 0))


def semantic_quality(text: Column) -> Column:
    """struct(coherence, completeness, score), told from garbling, repetition and signs alone."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), F.lit(0))
    repeated = let(toks, lambda t: F.when(F.size(t) < 4, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(t)) / F.size(t)))
    useful = count(text, f"[{WORD}]") / F.greatest(F.length(text), F.lit(1))
    coherence = F.greatest(F.lit(0.0), 1 - F.least(garbled_score(text) * 0.08, F.lit(0.5)) - F.least(repeated * 0.6, F.lit(0.6)) - F.when(useful < 0.45, 0.25).otherwise(0.0))
    complete = F.when((count(text, "[。.!！?？;；]") > 0) | (F.length(text) < 80), 0.9).otherwise(0.72)
    empty = strip(text) == ""
    return let(F.struct(coherence.alias("c"), complete.alias("k")), lambda s: F.struct(
        F.when(empty, 0.0).otherwise(s["c"]).alias("coherence"), F.when(empty, 0.0).otherwise(s["k"]).alias("completeness"),
        F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), F.round(s["c"] * 0.65 + s["k"] * 0.35, 4))).alias("score"),
    ))


def semantic_filter(df: DataFrame, low: float = 0.55, review: float = 0.72) -> DataFrame:
    out = df.withColumn("_s", semantic_quality(F.col("text")))
    out = out.withColumn("semantic_quality_score", F.col("_s.score")).drop("_s")
    return flag(out, ("semantic_low_quality", F.col("semantic_quality_score") < low), ("semantic_needs_review", (F.col("semantic_quality_score") >= low) & (F.col("semantic_quality_score") < review)))


def text_repair(df: DataFrame) -> DataFrame:
    """Doubled marks and spaces between Chinese characters; taken if the text has not grown by more than a quarter or 30 characters."""
    s = F.col("text")
    for pattern, to in (("!{2,}", "!"), (r"\?{2,}", "?"), ("。{2,}", "。"), ("，{2,}", "，"), (f"([{CJK}])[{SPACE}]+(?=[{CJK}])", "$1")):
        s = F.regexp_replace(s, pattern, to)
    fits = F.length(s) <= F.greatest(F.length("text") * 1.25, F.length("text") + 30)
    return _changed(df, F.when(fits, s).otherwise(F.col("text")), "text_repaired")


def text_score(df: DataFrame) -> DataFrame:
    score = 1 - penalty(F.col("issues"), tables.TEXT_PENALTIES, tables.TEXT_PENALTY_OTHER)
    if "semantic_quality_score" in df.columns:
        score = F.least(score, F.col("semantic_quality_score"))
    return df.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))


def pair_score(df: DataFrame) -> DataFrame:
    """Weighted parts of an image-text pair less the penalties of its issues; a missing metric takes its default."""
    known = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    part: dict[str, Column] = {}
    for name, other, _ in tables.PAIR_PARTS:
        part[name] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(known(name), part[other] if isinstance(other, str) else F.lit(other))))
    whole = F.when(F.arrays_overlap("issues", F.array(*map(F.lit, ("pair_missing_image", "pair_missing_text", "image_missing", "decode_failed", "empty_text")))), 0.0).otherwise(1.0)
    score = sum((part[n] * w for n, _, w in tables.PAIR_PARTS), whole * 0.08) - penalty(F.col("issues"), tables.PAIR_PENALTIES, 0)
    return df.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))


def media_score(df: DataFrame, penalties: dict[str, float], cap: str | None = None) -> DataFrame:
    """1 less the penalties of the issues (an issue that is not listed costs nothing), at most the metric ``cap``."""
    score = 1 - penalty(F.col("issues"), penalties, 0)
    if cap and cap in df.columns:
        score = F.least(score, F.coalesce(F.col(cap), F.lit(1.0)))
    return df.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))


def safety_fusion(df: DataFrame, risks: tuple[str, ...], issue: str, score: str) -> DataFrame:
    """score is 0 and the issue is added if any of the risks is among the issues."""
    any_ = F.arrays_overlap("issues", F.array(*map(F.lit, risks)))
    return flag(df.withColumn(score, F.when(any_, 0.0).otherwise(1.0)), (issue, F.col(score) == 0))


def gate(df: DataFrame, keep: float = 0.75, review: float = 0.55, hard: tuple[str, ...] = tables.HARD_FAIL, soft: tuple[str, ...] = ()) -> DataFrame:
    """action: drop on a hard issue, review on a soft one, else by the score."""
    has = lambda names: F.arrays_overlap("issues", F.array(*map(F.lit, names))) if names else F.lit(False)
    score = F.coalesce(F.col("quality_score"), F.lit(0.0))
    return df.withColumn("action", F.when(has(hard), "drop").when(has(soft), "review").when(score >= keep, "keep").when(score >= review, "review").otherwise("drop"))


def leakage_guard(df: DataFrame, json_col: str, forbidden: tuple[str, ...] = tables.LEAKING) -> DataFrame:
    """leakage_hits: paths (at most 20) of forbidden names anywhere in a JSON column; data_leakage_suspected if there are any."""
    import json

    names = frozenset(forbidden)

    def walk(value, path, out):
        if isinstance(value, dict):
            for k, v in value.items():
                if k in names:
                    out.append(f"{path}.{k}")
                walk(v, f"{path}.{k}", out)
        elif isinstance(value, list):
            for k, v in enumerate(value):
                walk(v, f"{path}[{k}]", out)
        return out

    @F.pandas_udf("array<string>")
    def hits(s: pd.Series) -> pd.Series:
        def one(t):
            if not t or not any(n in t for n in names):
                return []
            try:
                return walk(json.loads(t), "$", [])[:20]
            except ValueError:
                return []

        return s.map(one)

    return flag(df.withColumn("leakage_hits", hits(F.col(json_col))), ("data_leakage_suspected", F.size("leakage_hits") > 0))


def schema_leaks(df: DataFrame, forbidden: tuple[str, ...] = tables.LEAKING) -> list[str]:
    """Paths of forbidden names in the schema itself, no row read."""
    out: list[str] = []

    def walk(kind, path):
        if kind.typeName() == "struct":
            for f in kind.fields:
                if f.name in forbidden:
                    out.append(f"{path}.{f.name}")
                walk(f.dataType, f"{path}.{f.name}")
        elif kind.typeName() == "array":
            walk(kind.elementType, f"{path}[]")

    walk(df.schema, "$")
    return out


def route(df: DataFrame, text: str = "text", image: str = "image_path", audio: str = "audio_path", video: str = "video_path", given: str = "modality") -> DataFrame:
    """route: the modality that is given, else told by the fields: video, image_text_pair, image, text, audio, unknown."""
    has = lambda c: (F.length(strip(F.coalesce(F.col(c).cast("string"), F.lit("")))) > 0) if c in df.columns else F.lit(False)
    told = F.when(has(video), "video").when(has(text) & has(image), "image_text_pair").when(has(image), "image").when(has(text), "text").when(has(audio), "audio").otherwise("unknown")
    known = F.lower(strip(F.col(given))) if given in df.columns else F.lit(None).cast("string")
    return df.withColumn("route", F.when(known.isin("text", "image", "image_text_pair", "video", "audio"), known).otherwise(told))


STEPS = {
    "encoding_detect": encoding_detect, "unicode_repair": unicode_repair, "chinese_normalize": chinese_normalize, "whitespace_normalize": whitespace_normalize, "html_clean": html_clean, "markdown_clean": markdown_clean,
    "language_detect": language_detect, "text_length_filter": length_filter, "repetition_filter": repetition_filter, "low_info_density_filter": info_density_filter, "text_sensitive_detect": sensitive_detect,
    "sensitive_content_filter": risky_words, "llm_semantic_quality": semantic_filter, "text_quality_scorer": text_score, "quality_gate": gate,
}


def denoise_text(df: DataFrame, text_col: str = "text", steps: tuple[str, ...] = tuple(STEPS), **params: dict) -> DataFrame:
    """df through the steps; ``params`` by the name of a step."""
    out = start(df, text_col)
    for name in steps:
        out = STEPS[name](out, **params.get(name, {}))
    return out
