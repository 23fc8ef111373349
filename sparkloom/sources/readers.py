"""Sources: JSON Lines, JSON, CSV, text, files, a text itself, a seed list in YAML; all to one envelope.

``scan`` chooses by the given type or the suffix. ``envelope`` brings any of them to (id, modality, payload, meta, source, line_no): fields are taken from the first of
their usual names that has a value, a missing id is made of the source and line, what is left goes to ``extra`` as JSON.
"""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SUFFIXES = {".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".csv": "csv", ".parquet": "parquet", ".yaml": "seed_yaml", ".yml": "seed_yaml", ".txt": "text", ".md": "text", ".html": "text", ".htm": "text"}
MEDIA = {"image": ("png", "jpg", "jpeg", "gif", "bmp", "ppm", "pgm"), "audio": ("wav", "mp3", "flac", "m4a"), "video": ("mp4", "mov", "mkv", "webm")}
# Names under which each field comes.
NAMES = {"id": ("id", "sample_id", "uid", "doc_id", "row_no"), "text": ("text", "content", "body", "caption"), "image_path": ("image_path", "image", "image_file"), "audio_path": ("audio_path", "audio", "wav"), "video_path": ("video_path", "video"), "label": ("label", "category", "tag"), "language": ("language", "lang")}


def jsonl(spark: SparkSession, path: str, bad: str = "fail") -> DataFrame:
    """(record: variant, line, source, line_no). bad: fail, keep (record null, issues invalid_json) or drop. Blank lines are left out.

    Lines are numbered within their file; Spark splits a file only at line ends, so numbers need one window a file.
    """
    lines = spark.read.option("encoding", "UTF-8").text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("_at"))
    numbered = lines.withColumn("line_no", F.row_number().over(Window.partitionBy("source").orderBy("_at"))).drop("_at").where(F.trim("line") != "")
    if bad == "fail":
        return numbered.withColumn("record", F.parse_json("line"))
    out = numbered.withColumn("record", F.try_parse_json("line"))
    if bad == "drop":
        return out.where("record is not null")
    return out.withColumn("issues", F.when(F.col("record").isNull(), F.array(F.lit("invalid_json"))).otherwise(F.array().cast("array<string>")))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON Lines with a schema (none: inferred), bad lines in _corrupt_record."""
    r = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return (r.schema(f"{schema}, _corrupt_record string") if schema else r).json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object or a list of objects a file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns strings, quoted line breaks allowed."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(id: name without suffix, text, source) of every file."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))
    return df.select(stem(F.col("source")).alias("id"), "text", "source")


def stem(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), hidden: bool = False) -> DataFrame:
    """(path, content, length) of the files below a folder; names that begin with a dot are left out unless ``hidden``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content", "length")
    name = F.element_at(F.split("path", "/"), -1)
    if suffixes:
        df = df.where(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*suffixes))
    return df if hidden else df.where(~name.startswith("."))


def raw_text(spark: SparkSession, text: str, ident: str = "raw_text") -> DataFrame:
    return spark.createDataFrame([(ident, text)], "id string, text string")


def from_stdin(spark: SparkSession, data: str) -> DataFrame:
    """What was piped in: JSON (an object or a list), else one text."""
    try:
        got = json.loads(data)
    except ValueError:
        return raw_text(spark, data, "stdin")
    return records(spark, got if isinstance(got, list) else [got])


def records(spark: SparkSession, rows: list) -> DataFrame:
    """Rows given as Python objects: read as JSON, so that nested fields keep their types."""
    return spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in rows], "line string").select(F.parse_json("line").alias("record"), "line", F.lit("inline").alias("source"), (F.monotonically_increasing_id() + 1).alias("line_no"))


def seed_yaml(spark: SparkSession, path: str) -> DataFrame:
    """The ``items`` of a YAML file (a list on the driver: seeds, not data)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f) or {}
    return records(spark, got.get("items", []) if isinstance(got, dict) else got)


def annotated_images(spark: SparkSession, folder: str, annotations: str = "annotations.json") -> DataFrame:
    """Rows of a folder's annotation list, image paths made whole; fields beyond the usual ones in ``extra``."""
    df = read_json(spark, f"{folder}/{annotations}")
    path = F.when(F.col("image_path").startswith("/"), F.col("image_path")).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), F.col("image_path")))
    usual = [c for c in ("id", "image_path", "label", "caption", "bbox") if c in df.columns]
    rest = [c for c in df.columns if c not in usual]
    out = df.withColumn("image_path", path)
    return out.select(*usual, (F.to_json(F.struct(*rest)) if rest else F.lit(None).cast("string")).alias("extra"))


def resolve(path: str, kind: str = "auto") -> str:
    """The type of a source: as given, else directory or by suffix, else one media file."""
    if kind != "auto":
        return kind
    if os.path.isdir(path) and not path.endswith(".parquet"):
        return "directory"
    return SUFFIXES.get(os.path.splitext(path)[1].lower(), "file")


def scan(spark: SparkSession, path: str, kind: str = "auto", **options) -> DataFrame:
    readers = {"jsonl": jsonl, "json": read_json, "csv": read_csv, "parquet": lambda s, p: s.read.parquet(p), "text": read_text, "directory": read_files, "file": read_files, "seed_yaml": seed_yaml, "raw_text": raw_text, "stdin": from_stdin}
    return readers[resolve(path, kind)](spark, path, **options)


def _first(record, names, fields: set[str] | None):
    """The first value among the names: of a variant (fields None) or of columns."""
    if fields is None:
        got = [F.try_variant_get(record, f"$.{prefix}{n}", "string") for n in names for prefix in ("", "payload.")]
    else:
        got = [F.col(n).cast("string") for n in names if n in fields]
    return F.coalesce(*(F.when(F.trim(g) != "", g) for g in got)) if got else F.lit(None).cast("string")


def envelope(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """(id, modality, payload, meta, extra, source, line_no) of a scan. ``mapping`` names a field's column outright."""
    variant = "record" in df.columns
    fields = None if variant else set(df.columns)
    names = {k: ((mapping[k],) if mapping and k in mapping else v) for k, v in NAMES.items()}
    col = {k: _first(F.col("record") if variant else None, n, fields) for k, n in names.items()}
    source = F.col("source") if "source" in df.columns else F.lit("table")
    line = F.col("line_no").cast("long") if "line_no" in df.columns else F.monotonically_increasing_id() + 1
    told = F.when(col["video_path"].isNotNull(), "video").when(col["text"].isNotNull() & col["image_path"].isNotNull(), "image_text_pair").when(col["image_path"].isNotNull(), "image").when(col["audio_path"].isNotNull(), "audio").when(col["text"].isNotNull(), "text").otherwise("unknown")
    given = F.lower(F.trim(_first(F.col("record") if variant else None, ("modality",), fields)))
    used = {n for v in names.values() for n in v} | {"modality", "source", "line_no", "record", "line"}
    extra = F.col("line") if variant else (F.to_json(F.struct(*[c for c in df.columns if c not in used])) if any(c not in used for c in df.columns) else F.lit(None).cast("string"))
    ident = F.coalesce(col["id"], F.concat(stem(source), F.lit("_"), line.cast("string")))
    payload = F.struct(*(col[k].alias(k) for k in ("text", "image_path", "audio_path", "video_path")))
    return df.select(ident.alias("id"), F.coalesce(given, told).alias("modality"), payload.alias("payload"), F.struct(col["label"].alias("label"), col["language"].alias("language")).alias("meta"), extra.alias("extra"), source.alias("source"), line.alias("line_no"))


def manifest(spark: SparkSession, folders: list[str], truncate: int | None = None) -> DataFrame:
    """(id, modality, path, text) of the text and media files below the folders, in the order of modality and path."""
    parts = []
    for f in folders:
        files = read_files(spark, f)
        suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        kind = reduce(lambda c, kv: c.when(suffix.isin(*kv[1]), kv[0]), MEDIA.items(), F.when(suffix.isin("txt", "md"), "text"))
        text = F.when(kind == "text", F.decode(F.col("content"), "UTF-8"))
        parts.append(files.select(stem(F.col("path")).alias("id"), kind.alias("modality"), "path", (F.substring(text, 1, truncate) if truncate else text).alias("text")).where("modality is not null"))
    return reduce(DataFrame.unionByName, parts).orderBy("modality", "path")
