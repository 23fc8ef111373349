"""Workflows: steps in YAML or JSON, ordered by their dependencies, run as one plan, with resumable stages.

    input: {path: ..., type: auto}
    steps: [{id: clean, operator: html_clean, params: {}, depends_on: []}, ...]
    output: {path: ..., split: denoise}

A step takes the result of the step it depends on (the input without one); of several it takes the union of their rows. Paths are held within the
folders that are allowed.
"""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import registry
from sparkloom.sources import readers, writers


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def validate(flow: dict) -> list[str]:
    """What is wrong with a workflow; empty if it can run."""
    wrong = []
    steps = flow.get("steps")
    if not isinstance(flow.get("input"), dict):
        wrong.append("input is missing")
    if not isinstance(steps, list) or not steps:
        return [*wrong, "steps are missing"]
    seen = set()
    for k, s in enumerate(steps):
        name = s.get("id") or s.get("operator")
        if name in seen:
            wrong.append(f"two steps are called {name!r}")
        seen.add(name)
        if s.get("operator") not in registry.names():
            wrong.append(f"step {k}: no operator is called {s.get('operator')!r}")
    for s in steps:
        wrong += [f"{s.get('id')!r} depends on {d!r}, which there is none of" for d in s.get("depends_on", []) if d not in seen]
    if not wrong:
        try:
            levels(steps)
        except ValueError as e:
            wrong.append(str(e))
    return wrong


def levels(steps: list[dict]) -> list[list[dict]]:
    """Steps by level: each level needs only those before it. Without any depends_on the steps follow one another."""
    named = {s.get("id") or s["operator"]: s for s in steps}
    needs = {n: set(s.get("depends_on", [])) for n, s in named.items()}
    if not any(needs.values()):
        order = list(named)
        needs |= {b: {a} for a, b in zip(order, order[1:])}
    if unknown := {d for v in needs.values() for d in v} - set(named):
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    out, done = [], set()
    while len(done) < len(named):
        ready = sorted(n for n, v in needs.items() if n not in done and v <= done)
        if not ready:
            raise ValueError(f"steps depend on each other in a circle: {sorted(set(named) - done)}")
        out.append([named[n] | {"id": n, "depends_on": sorted(needs[n])} for n in ready])
        done |= set(ready)
    return out


def within(path: str, roots: list[str]) -> str:
    """The real path, if it lies below one of the roots; links are followed first."""
    real = os.path.realpath(path)
    if not any(real == os.path.realpath(r) or real.startswith(os.path.realpath(r) + os.sep) for r in roots):
        raise PermissionError(f"{path} lies outside the folders that are allowed")
    return real


def closure(wanted: list[str], needs: dict[str, list[str]]) -> list[str]:
    """The checks that are wanted and all that they need, in the order of ``needs``."""
    out, todo = set(), list(wanted)
    while todo:
        c = todo.pop()
        if c not in out:
            out.add(c)
            todo += needs.get(c, [])
    return [c for c in needs if c in out] + sorted(out - set(needs))


def run(spark: SparkSession, flow: dict, roots: list[str] | None = None) -> DataFrame:
    for path in flow.get("custom_operators", []):
        registry.load(within(path, roots) if roots else path)
    if wrong := validate(flow):
        raise ValueError("; ".join(wrong))
    source = dict(flow["input"])
    path = source.pop("path", "")
    if roots and "://" not in path:
        within(path, roots)
    df = readers.scan(spark, path, source.pop("type", "auto"), **source.pop("options", {}))
    results: dict[str, DataFrame] = {}
    last = df
    for level in levels(flow["steps"]):
        for s in level:
            given = reduce(DataFrame.unionByName, [results[d] for d in s["depends_on"]]) if s["depends_on"] else df
            out = registry.operator(s["operator"])(given, **s.get("params", {}))
            if s.get("checkpoint"):
                writers.append_stage(out, s["checkpoint"], s.get("key", "id"))
                out = spark.read.parquet(s["checkpoint"])
            results[s["id"]] = last = out
    if to := flow.get("output"):
        if to.get("split"):
            counts = writers.write_split(last, to["path"], to["split"], to.get("action", "action"))
            if to.get("metrics"):
                writers.write_metrics(to["metrics"], **counts)
        else:
            last.write.mode("overwrite").format(to.get("format", "json")).save(to["path"])
    return last
