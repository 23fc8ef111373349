"""Sinks: rows split by action, groups, results with summary and report, and appended stages of a resumable run."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Observation, functions as F

SPLITS = {"dedup": ({"keep": "kept", "remove": "removed", "review": "review"}, "kept"), "denoise": ({"keep": "clean", "drop": "dropped", "review": "review"}, "review"), "parse": ({"parsed": "parsed", "failed": "failed"}, "failed"), "synthesis": ({"accepted": "generated", "filtered": "filtered", "failed": "filtered"}, "filtered")}


def write_split(df: DataFrame, path: str, kind: str, action: str = "action") -> dict[str, int]:
    """Rows as JSON Lines under one folder an action (an action that is not known goes to the default one); one pass, rows counted on the way."""
    names, other = SPLITS[kind]
    split = F.lit(other)
    for a, n in names.items():
        split = F.when(F.col(action) == a, n).otherwise(split)
    seen = Observation()
    folders = sorted({*names.values(), other})
    out = df.withColumn("split", split).observe(seen, F.count(F.lit(1)).alias("total"), *(F.sum((F.col("split") == f).cast("long")).alias(f) for f in folders))
    out.write.mode("overwrite").partitionBy("split").json(path)
    return {k: v or 0 for k, v in seen.get.items()}


def write_groups(groups: DataFrame, path: str) -> None:
    """One JSON line a group; members in the order of their ids as strings. Group rows are gathered by group: for reports on groups of bounded size."""
    groups.groupBy("duplicate_group_id", "duplicate_type", "score").agg(F.sort_array(F.collect_list("id")).alias("member_ids")).write.mode("overwrite").json(path)


def write_metrics(path: str, **values) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, ensure_ascii=False, indent=2, default=str)


def append_stage(df: DataFrame, path: str, key: str = "id") -> int:
    """Rows whose key the stage does not hold yet are appended; so a run that broke off goes on where it stood."""
    from sparkloom.operators.clusters import resume

    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception:  # noqa: BLE001 - there is no stage yet
        done = None
    seen = Observation()
    (df if done is None else resume(df, done, key)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def markdown_report(title: str, facts: dict, tables: dict[str, DataFrame], limit: int = 20) -> str:
    """A report of figures and small tables (the first ``limit`` rows of each; a limit of what is shown, not of what is counted)."""
    out = [f"# {title}", ""]
    out += [f"- {k}: {v}" for k, v in facts.items()]
    for name, df in tables.items():
        cols = df.columns
        out += ["", f"## {name}", "", "| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols)]
        out += ["| " + " | ".join(str(v).replace("|", "\\|") for v in r) + " |" for r in df.limit(limit).collect()]
    return "\n".join(out) + "\n"
