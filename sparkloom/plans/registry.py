"""Operators by name: functions ``(df, **params) -> df``, built in or loaded from a file."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

Operator = Callable[..., DataFrame]
_OPERATORS: dict[str, Operator] = {}
_LOADED: dict[str, list[str]] = {}


def register(name: str, fn: Operator) -> Operator:
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
        raise ValueError(f"an operator's name is in small letters with underscores: {name!r}")
    if not callable(fn):
        raise TypeError(f"{name}: an operator is a function of a DataFrame")
    if name in _OPERATORS and _OPERATORS[name] is not fn:
        raise ValueError(f"two operators are called {name!r}")
    _OPERATORS[name] = fn
    return fn


def operator(name: str) -> Operator:
    _built_in()
    if name not in _OPERATORS:
        raise KeyError(f"no operator is called {name!r}")
    return _OPERATORS[name]


def names() -> list[str]:
    _built_in()
    return sorted(_OPERATORS)


def load(path: str) -> list[str]:
    """Register what a Python file lists in its OPERATORS (name to function); executors need the file too (addPyFile). A file is loaded once."""
    if path in _LOADED:
        return _LOADED[path]
    spec = importlib.util.spec_from_file_location(re.sub(r"\W", "_", path), path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    for name, fn in module.OPERATORS.items():
        register(name, fn)
    _LOADED[path] = sorted(module.OPERATORS)
    return _LOADED[path]


def row_operator(process, schema: str, setup=None, teardown=None) -> Operator:
    """An operator of a function from a row (a dict) to a row: set up once a partition, torn down at its end."""
    import pandas as pd

    def run_rows(df: DataFrame, **params) -> DataFrame:
        def run(batches):
            state = setup(**params) if setup else None
            try:
                for pdf in batches:
                    done = [process(r, state) if setup else process(r) for r in pdf.to_dict("records")]
                    if done:
                        yield pd.DataFrame(done)
            finally:
                if teardown:
                    teardown(state)

        return df.mapInPandas(run, schema)

    return run_rows


TEMPLATE = '''"""{name}: what it does to a DataFrame."""

from pyspark.sql import DataFrame, functions as F


def {name}(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("{name}_value", F.length(column))


OPERATORS = {{"{name}": {name}}}
'''


def template(name: str) -> str:
    """The source of a new operator's file."""
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
        raise ValueError(f"an operator's name is in small letters with underscores: {name!r}")
    return TEMPLATE.format(name=name)


def _built_in() -> None:
    from sparkloom.operators import denoise, evaluate, exact, media, pairs, parse, synthesize

    if "text_denoise" in _OPERATORS:
        return
    own = {
        **denoise.STEPS, "text_denoise": denoise.denoise_text, "llm_text_repair": denoise.text_repair, "data_leakage_guard": denoise.leakage_guard, "modality_router": denoise.route, "pair_quality_scorer": denoise.pair_score,
        "text_dataset_eval": evaluate.evaluate_text, "text_normalize_for_dedup": exact.normalize_for_dedup, "exact_hash_deduplicator": exact.exact_dedup, "simhash_deduplicator": pairs.simhash_pairs, "minhash_lsh_deduplicator": pairs.jaccard_pairs,
        "ann_recall": pairs.cosine_pairs, "html_parse": parse.parse, "markdown_chunk": parse.explode_chunks, "parse_quality_assess": parse.assess, "structured_record_synthesis": synthesize.records, "structured_consistency_validate": synthesize.validate_records,
        "text_template_synthesis": synthesize.template_texts, "text_qa_synthesis": synthesize.question_pairs, "table_qa_synthesis": synthesize.table_questions, "diversity_score": synthesize.diversity, "safety_filter": synthesize.safety_filter,
        "image_dataset_eval": media.evaluate_images, "audio_dataset_eval": media.evaluate_audio, "image_denoise": media.denoise_images,
    }
    for name, fn in own.items():
        register(name, fn)
