"""Synthesis of records and texts with a quality gate.

Records come from a schema by native expressions (one projection, whatever the number of fields); texts from templates, from the first sentence of a source, from a lexicon of
synonyms, or from a client that is passed in. Everything is deterministic. Null sources give null texts and fail the format check.
"""

from __future__ import annotations

import functools
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.chars import squeeze

KINDS = {"integer": "long", "float": "double", "boolean": "boolean", "string": "string"}


def distribution(schema: list[dict]) -> dict[str, dict]:
    """What each field is drawn from: its choices, or start, step and bounds."""
    out = {}
    for f in schema:
        kind = f.get("type", "string")
        if f.get("choices"):
            out[f["name"]] = {"type": "categorical", "choices": list(f["choices"])}
        elif kind in ("integer", "float"):
            out[f["name"]] = {"type": kind, "step": f.get("step", 1 if kind == "integer" else 0.1)} | {k: f.get(k) for k in ("min", "max", "start")}
    return out


def field_value(field: dict, k: int, ident: Column, index: Column) -> Column:
    """Value of the k-th field of the record with this id and running number."""
    at = (index + k).cast("long")
    if field.get("choices"):
        return F.element_at(F.array(*map(F.lit, field["choices"])), (at % len(field["choices"]) + 1).cast("int"))
    kind = field.get("type", "string")
    if kind == "boolean":
        return at % 2 == 0
    if kind not in ("integer", "float"):
        return F.concat_ws("_", F.lit(field.get("prefix", field["name"])), ident.cast("string"), F.lit(str(k)))
    whole = kind == "integer"
    value = at + int(field.get("start", 100)) if whole else at * float(field.get("step", 0.1)) + float(field.get("start", 0.75))
    num = int if whole else float
    if field.get("max") is not None:
        value = F.least(value, F.lit(num(field["max"])))
    if field.get("min") is not None:
        value = F.greatest(value, F.lit(num(field["min"])))
    return value.cast("long") if whole else F.round(value, 3)


def records(df: DataFrame, schema: list[dict], id_col: str = "id", index_col: str = "source_index") -> DataFrame:
    """df with a struct column ``record``."""
    return df.withColumn("record", F.struct(*(field_value(f, k, F.col(id_col), F.col(index_col)).alias(f["name"]) for k, f in enumerate(schema))))


COMPARE = {"<=": lambda a, b: a <= b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "!=": lambda a, b: a != b}


def validate_records(df: DataFrame, schema: list[dict], rules: list[dict] = (), record: str = "record") -> DataFrame:
    """df with issues: missing_field:name, invalid_choice:name, below_min:name, above_max:name, consistency_rule_failed:left op right (an unknown op is ==)."""
    there = df.schema[record].dataType.names
    found: list[tuple[str, Column]] = []
    for f in schema:
        name = f["name"]
        if name not in there:
            found.append((f"missing_field:{name}", F.lit(True)))
            continue
        v = F.col(f"{record}.{name}")
        if f.get("choices"):
            found.append((f"invalid_choice:{name}", ~v.isin(*f["choices"])))
        if f.get("type") in ("integer", "float"):
            for bound, issue, off in (("min", "below_min", lambda v, b: v < b), ("max", "above_max", lambda v, b: v > b)):
                if f.get(bound) is not None:
                    found.append((f"{issue}:{name}", off(v, F.lit(f[bound]))))
    for r in rules:
        if r.get("left") in there and r.get("right") in there:
            ok = COMPARE.get(r.get("op"), lambda a, b: a == b)(F.col(f"{record}.{r['left']}"), F.col(f"{record}.{r['right']}"))
            found.append((f"consistency_rule_failed:{r['left']} {r.get('op')} {r['right']}", ~ok))
    if not found:
        return df.withColumn("issues", F.array().cast("array<string>"))
    return df.withColumn("issues", F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in found)), lambda x: x.isNotNull()))


def fill_template(template: str, **fields: Column) -> Column:
    """``{name}`` and ``{{ name }}`` replaced by the fields; what is not named stays. Null fields read as empty."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}|\{(\w+)\}", template):
        name = m[1] or m[2]
        if name in fields:
            parts += [F.lit(template[at : m.start()]), F.coalesce(fields[name].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


TEMPLATE = "Write a {style} text about {topic} for {audience}. {prompt}"


def template_texts(df: DataFrame, template: str = TEMPLATE, **cols: str) -> DataFrame:
    return df.withColumn("generated_text", fill_template(template, **{k: F.col(c) for k, c in cols.items()}))


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(squeeze(F.coalesce(text, F.lit(""))), r"^[^。！？.!?]*[。！？.!?]?", 0)


def question_pairs(df: DataFrame, id_col: str, text_col: str, n: int = 1) -> DataFrame:
    """(id, pair_index, question, answer): questions about the first sentence of each text; blank texts give none."""
    s = first_sentence(F.col(text_col))
    pairs = df.select(F.col(id_col).alias("id"), s.alias("answer")).where("answer <> ''")
    return pairs.select("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pair_index"), F.concat(F.lit("What is the key point of "), F.col("answer"), F.lit("?")).alias("question"), "answer")


def table_questions(df: DataFrame, id_col: str, table_col: str) -> DataFrame:
    """(id, row, column, question, answer) of every cell of a table whose lines are cells parted by `` | ``, the first one a header."""
    lines = F.transform(F.split(F.col(table_col), "\n"), lambda r: F.split(r, r" \| "))
    rows = df.select(F.col(id_col).alias("id"), lines.alias("t")).select("id", F.col("t")[0].alias("head"), F.posexplode(F.slice("t", 2, F.size("t"))).alias("row", "cells"))
    cells = rows.select("id", "row", "head", "cells", F.posexplode("head").alias("column", "name")).where(F.col("column") < F.size("cells"))
    value = F.element_at("cells", F.col("column") + 1)
    return cells.select("id", "row", "column", F.concat(F.lit("What is the "), F.col("name"), F.lit(" of "), F.col("cells")[0], F.lit("?")).alias("question"), value.alias("answer")).where("column > 0")


def strip_list_prefix(line: Column) -> Column:
    """The line without a leading dash, dot or number."""
    return F.trim(F.regexp_replace(F.trim(line), r"^(?:[-•*]|\(?\d{1,3}[.)、:])\s*", ""))


def parse_questions(text: Column) -> Column:
    """Lines that end in a question mark, without list marks, each once."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "[\r\n]+"), strip_list_prefix)
    return F.array_distinct(F.filter(lines, lambda x: x.rlike("[?？]$")))


def replace_synonyms_in(text: str, lexicon: dict[str, list[str]], ratio: float = 1.0, most: int | None = None) -> tuple[str, list[tuple[str, str, int]]]:
    """Terms replaced by their synonyms in turn, the longest at each place, no two overlapping: the first ceil(ratio n), at most ``most``."""
    terms = sorted((t for t in lexicon if t and lexicon[t]), key=lambda t: (-len(t), t))
    if not text or not terms:
        return text, []
    hits = list(re.finditer("|".join(map(re.escape, terms)), text))
    n = math.ceil(ratio * len(hits))
    hits = hits[: n if most is None else min(n, most)]
    out, done, at, seen = [], [], 0, {}
    for m in hits:
        k = seen.get(m.group(), 0)
        seen[m.group()] = k + 1
        to = lexicon[m.group()][k % len(lexicon[m.group()])]
        out += [text[at : m.start()], to]
        done.append((m.group(), to, m.start()))
        at = m.end()
    return "".join((*out, text[at:])), done


def replace_synonyms(text: Column, lexicon: dict[str, list[str]], ratio: float = 1.0, most: int | None = None) -> Column:
    """struct(text, replacements)."""

    @F.pandas_udf("struct<text:string, replacements:array<struct<term:string, to:string, at:int>>>")
    def run(s: pd.Series) -> pd.DataFrame:
        done = [(None, []) if t is None else replace_synonyms_in(t, lexicon, ratio, most) for t in s]
        return pd.DataFrame({"text": pd.Series([t for t, _ in done], dtype=object), "replacements": [[{"term": a, "to": b, "at": c} for a, b, c in r] for _, r in done]})

    return run(text)


def generate(df: DataFrame, prompt_col: str, client, out: str = "generated_text") -> DataFrame:
    """df with what ``client`` (a function of a prompt, made once a partition by ``client()`` if it is a factory) gives for each prompt, and its error."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        ask = client() if getattr(client, "is_factory", False) else client
        for pdf in batches:
            texts, errors = [], []
            for p in pdf[prompt_col]:
                try:
                    texts.append(ask(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - the error is data
                    texts.append(None)
                    errors.append(str(e))
            yield pdf.assign(**{out: pd.Series(texts, index=pdf.index, dtype=object), f"{out}_error": pd.Series(errors, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, f"{schema}, {out} string, {out}_error string")


def safety_filter(df: DataFrame, text_col: str, banned: tuple[str, ...]) -> DataFrame:
    """df with unsafe_words: those that stand in the text, in any case."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    return df.withColumn("unsafe_words", F.filter(F.array(*(F.when(low.contains(w.lower()), F.lit(w)) for w in banned)) if banned else F.array().cast("array<string>"), lambda x: x.isNotNull()))


def format_check(df: DataFrame, text_col: str, least: int = 30) -> DataFrame:
    return df.withColumn("format_valid", F.length(F.coalesce(F.col(text_col), F.lit(""))) >= least)


def diversity(df: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """df with diversity: 1 for the first row (by order_col) of each text, 0 for its repeats. Counted by an aggregate, so a hot text is no window."""
    sig = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    first = df.groupBy(sig.alias("_sig")).agg(F.min(order_col).alias("_first"))
    return df.withColumn("_sig", sig).join(first, "_sig").withColumn("diversity", F.when(F.col(order_col) == F.col("_first"), 1.0).otherwise(0.0)).drop("_sig", "_first")


def gate(df: DataFrame, complete: Column, diversity_col: str = "diversity", issues: str = "issues", keep: float = 0.7, retries: Column | None = None) -> DataFrame:
    """df with quality (0.6 if complete, 0.4 of diversity, 0.2 off for an issue) and status: accepted, needs_retry or filtered."""
    q = complete.cast("double") * 0.6 + F.col(diversity_col) * 0.4 - F.size(issues) * 0.2
    ok = (F.col("quality") >= keep) & (F.size(issues) == 0)
    again = F.lit(False) if retries is None else retries > 0
    return df.withColumn("quality", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)), 4)).withColumn("status", F.when(ok, "accepted").when(again, "needs_retry").otherwise("filtered"))


def with_retries(df: DataFrame, make, limit: int = 2) -> DataFrame:
    """``make(rows, attempt)`` gives rows with a status; those that need a retry are made again up to ``limit`` times, then filtered."""
    from sparkloom.plans.shared import Scratch

    work, done, open_ = Scratch(df.sparkSession, "retries"), [], df
    for attempt in range(limit + 1):
        made = work.keep(make(open_, attempt))
        done.append(made.where("status <> 'needs_retry'"))
        left = made.where("status = 'needs_retry'")
        if attempt == limit or not left.limit(1).count():
            done.append(left.withColumn("status", F.lit("filtered")))
            break
        open_ = left.select(*df.columns)
    return functools.reduce(lambda a, b: a.unionByName(b), done)


def image_cards(df: DataFrame, title: str, subtitle: str, width: int = 640, height: int = 360) -> DataFrame:
    """df with card_svg: a plain card with both lines, as SVG text, and the negative prompt that goes with it."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    svg = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><rect width="100%" height="100%" fill="#f4f4f4"/><text x="40" y="120" font-size="40">'), safe(title), F.lit('</text><text x="40" y="190" font-size="24">'), safe(subtitle), F.lit("</text></svg>"))
    return df.withColumn("card_svg", svg).withColumn("negative_prompt", F.lit("blurry, distorted text, watermark, low resolution")).withColumn("card_valid", F.length(safe(title)) > 0)
