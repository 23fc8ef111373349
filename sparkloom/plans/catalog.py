"""Registered queries over the test tables, and the SQL each is held against. Every query runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.functions.chars import text_or_empty
from sparkloom.functions.fields import key_conflicts, overlap
from sparkloom.functions.normalize import clean_markdown, eval_key
from sparkloom.operators import clusters, denoise, evaluate, exact, media, pairs, parse, synthesize
from sparkloom.plans import oracles
from sparkloom.plans.shared import Scratch

#: Schema and rules of the structured queries.
SCHEMA = [
    {"name": "tier", "type": "string", "choices": ["basic", "plus", "pro"]}, {"name": "low", "type": "integer", "start": 10, "min": 12, "max": 4000}, {"name": "high", "type": "integer", "start": 5, "max": 900},
    {"name": "share", "type": "float", "start": 0.5, "step": 0.25, "max": 300.0}, {"name": "flag", "type": "boolean"}, {"name": "code", "type": "string", "prefix": "rec"},
]
CONSISTENT = [{"left": "low", "op": "<=", "right": "high"}]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(c: str):
    return F.array_join(F.col(c), ",").alias(c)


def dedup_by_text(spark, d):
    docs = read(spark, d, "documents").select("doc_id", eval_key(F.col("text")).alias("k"))
    return exact.hash_groups(docs, "doc_id", F.col("k"), F.length("k")).drop("hash").withColumnRenamed("id", "doc_id")


def edge_fusion(spark, d):
    e = read(spark, d, "dup_edges").where("left_id is not null and right_id is not null").select("left_id", "right_id", F.coalesce("score", F.lit(0.0)).alias("score"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("reason", "duplicate_type", "operator")))
    return clusters.fuse(e).select("left_id", "right_id", "score", joined("reasons"), joined("operators"), "duplicate_type")


def dedup_groups(spark, d):
    e = read(spark, d, "dup_edges").select("left_id", "right_id", F.coalesce("score", F.lit(0.0)).alias("score"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("reason", "duplicate_type", "operator"))).where("left_id is not null and right_id is not null")
    groups = clusters.duplicate_groups(read(spark, d, "media_input").select("id").distinct(), Scratch(spark, "fused").keep(clusters.fuse(e)), 0.0)
    return groups.select("duplicate_group_id", "id", "group_size")


def best_samples(spark, d):
    """Groups of the matches over media records; the sample with the longest path is kept, ties by id."""
    e = read(spark, d, "dup_edges").where("left_id is not null and right_id is not null").select("left_id", "right_id", F.coalesce("score", F.lit(0.0)).alias("score"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("reason", "duplicate_type", "operator")))
    path = F.coalesce("payload.image_path", "payload.audio_path", "payload.video_path", F.lit(""))
    items = read(spark, d, "media_input").groupBy("id").agg(F.max(F.length(path)).alias("size"))
    groups = Scratch(spark, "groups").keep(clusters.duplicate_groups(items, clusters.fuse(e), 0.5))
    return clusters.select_best(groups.select("duplicate_group_id", "id"), items, F.col("size")).groupBy("duplicate_group_id", "keep_id").agg(F.count(F.lit(1)).alias("members"), F.sum((F.col("action") == "remove").cast("long")).alias("removed"))


def simhash(spark, d):
    t = read(spark, d, "dedup_input").select("id", eval_key(F.col("payload.text")).alias("k"))
    return pairs.simhash_pairs(t, "id", "k", distance=3)


def jaccard(spark, d):
    t = read(spark, d, "text_sample").select("id", eval_key(F.col("text")).alias("k"))
    return pairs.jaccard_pairs(t, "id", "k", threshold=0.8, min_length=40)


def reranked(spark, d):
    t = read(spark, d, "text_sample").select("id", eval_key(F.col("text")).alias("k"))
    edges = Scratch(spark, "edges").keep(pairs.jaccard_pairs(t, "id", "k", threshold=0.8, min_length=40))
    return pairs.rerank(edges, t.groupBy("id").agg(F.min("k").alias("k")), "id", "k", 0.85)


def cosine(spark, d):
    return pairs.cosine_pairs(read(spark, d, "embeddings"), "vec_id", "embedding", 0.35).select("left_id", "right_id", F.round("score", 5).alias("score"))


def cosine_top(spark, d):
    return pairs.cosine_pairs(read(spark, d, "embeddings"), "vec_id", "embedding", 0.0, top_k=100).select("left_id", "right_id", F.round("score", 5).alias("score"))


def resume(spark, d):
    items = read(spark, d, "dedup_input").select("id", "modality").distinct()
    done = read(spark, d, "dedup_input").where("meta.source is not null").select("id")
    return clusters.resume(items, done)


def _eval(spark, d, *checks):
    return evaluate.evaluate_text(read(spark, d, "text_dataset"), checks=checks)


#: Checks that SQL without back references or stacks can say.
PLAIN = ("schema", "completeness", "length", "unicode", "duplicates", "consecutive", "special")


def eval_full(spark, d):
    return evaluate.evaluate_text(read(spark, d, "text_dataset")).select("row_no", joined("issues"), "score", "level", "action", F.array_join("suggestions", "\n").alias("suggestions"))


def eval_pairing(spark, d):
    return _eval(spark, d, "pairing").select("row_no", F.col("pairing.unpaired").alias("unpaired"), F.col("pairing.mismatched").alias("mismatched"))


def documents(spark, d):
    return denoise.start(read(spark, d, "documents"))


def denoise_gate(spark, d):
    out = denoise.language_detect(documents(spark, d), allowed=("zh", "mixed", "en"))
    out = denoise.length_filter(out)
    out = denoise.info_density_filter(out)
    out = denoise.semantic_filter(out)
    return denoise.gate(denoise.text_score(out)).select("doc_id", "language", joined("issues"), F.floor(F.col("quality_score") * 100).alias("quality_score"), "action")


def denoise_full(spark, d):
    return denoise.denoise_text(read(spark, d, "documents")).select("doc_id", "text", joined("issues"), joined("masked_types"), "quality_score", "action")


def denoise_repetition(spark, d):
    return documents(spark, d).select("doc_id", F.round(denoise.triple_repetition(F.col("text")), 6).alias("triple_repetition"))


def denoise_repetition_filter(spark, d):
    return denoise.repetition_filter(documents(spark, d)).select("doc_id", F.round("repetition_ratio", 6).alias("repetition_ratio"), joined("issues"))


def denoise_density(spark, d):
    return denoise.info_density_filter(documents(spark, d)).select("doc_id", F.round("info_density", 6).alias("info_density"), F.round("unique_char_ratio", 6).alias("unique_char_ratio"))


def denoise_semantic(spark, d):
    s = denoise.semantic_quality(F.col("text"))
    return documents(spark, d).withColumn("s", s).select("doc_id", F.round("s.coherence", 6).alias("coherence"), "s.completeness", F.round("s.score", 3).alias("score"))


def denoise_pii(spark, d):
    return denoise.sensitive_detect(documents(spark, d)).select("doc_id", joined("masked_types"), F.length("text").alias("length"))


def denoise_encoding(spark, d):
    return denoise.encoding_detect(documents(spark, d)).select("doc_id", "mojibake_score", joined("issues"))


def denoise_normalized(spark, d):
    out = denoise.chinese_normalize(denoise.whitespace_normalize(denoise.unicode_repair(documents(spark, d))))
    return denoise.html_clean(out).select("doc_id", "text", joined("issues"))


def risky(spark, d):
    return denoise.risky_words(documents(spark, d), {"archive": ("archive", "Archiv"), "parser": ("the parser",)}).select("doc_id", joined("sensitive_categories"))


def routes(spark, d):
    m = read(spark, d, "media_input").select("id", "modality", "payload.*")
    return denoise.route(m).select("id", "route").distinct()


def pair_fields(spark, d):
    g = read(spark, d, "generation_item").select("id", "prompt", F.col("generated.output").alias("output")).distinct()
    return g.select("id", F.round(overlap(F.col("prompt"), F.col("output")), 6).alias("overlap"), key_conflicts(F.col("prompt"), F.col("output")).alias("k")).select("id", "overlap", "k.*")


def pair_scores(spark, d):
    g = read(spark, d, "generation_item").groupBy("id").agg(F.max(F.size("issues")).alias("n"))
    m = g.withColumn("text_quality_score", (F.col("n") % 5) / 4).withColumn("clip_similarity_score", (F.col("n") % 3) / 2).withColumn("issues", F.when(F.col("n") > 1, F.array(F.lit("image_text_mismatch"))).otherwise(F.array().cast("array<string>")))
    return denoise.pair_score(m).select("id", "quality_score")


def html_parse(spark, d):
    return parse.parse(read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "heading_count", "paragraph_count", "table_count", "text_length", "action")


def html_markdown(spark, d):
    p = parse.parse(read(spark, d, "documents").select("doc_id", "text"), "text").where("action = 'parsed'")
    return p.select("doc_id", parse.markdown(F.col("artifacts")).alias("markdown"))


def chunks(spark, d):
    return parse.explode_chunks(read(spark, d, "documents"), "doc_id", "text", 1200).withColumnRenamed("id", "doc_id")


def seeds(spark, d):
    return read(spark, d, "text_dataset").select(F.col("row_no").alias("id"), F.col("row_no").alias("source_index"))


def structured(spark, d):
    return synthesize.records(seeds(spark, d), SCHEMA).select("id", "record.*")


def structured_checked(spark, d):
    return synthesize.validate_records(synthesize.records(seeds(spark, d), SCHEMA), SCHEMA, CONSISTENT).select("id", joined("issues"))


def templates(spark, d):
    g = read(spark, d, "generation_item").select("id", "prompt", "payload.topic", "payload.audience", "payload.style").distinct()
    return synthesize.template_texts(g, topic="topic", audience="audience", style="style", prompt="prompt").select("id", "generated_text")


def qa_pairs(spark, d):
    return synthesize.question_pairs(read(spark, d, "documents"), "doc_id", "text", 2).withColumnRenamed("id", "doc_id")


def synthesis_gate(spark, d):
    g = read(spark, d, "generation_item").groupBy("id").agg(F.min(F.coalesce("generated.output", F.lit(""))).alias("text"))
    out = synthesize.diversity(g, "text", "id").withColumn("issues", F.when(F.col("diversity") == 0, F.array(F.lit("duplicate_generation"))).otherwise(F.array().cast("array<string>")))
    return synthesize.gate(out, F.col("text") != "").select("id", "diversity", "quality", "status")


def queries() -> dict:
    flagged = lambda cols, *checks: lambda s, d: _eval(s, d, *checks).select("row_no", *cols())  # noqa: E731 - columns are made when the query runs
    has = lambda i: F.array_contains("issues", i).alias(i)
    return {
        "text_dedup_exact": exact.text_dedup_exact, "dedup_by_text": dedup_by_text, "edge_fusion": edge_fusion, "dedup_groups": dedup_groups, "best_samples": best_samples, "simhash_pairs": simhash, "jaccard_pairs": jaccard, "reranked_pairs": reranked,
        "cosine_pairs": cosine, "cosine_top": cosine_top, "resume_skip": resume,
        "eval_schema": flagged(lambda: ["schema_valid", has("missing_id"), has("missing_text_field")], "schema"),
        "eval_completeness": flagged(lambda: ["completeness", has("empty_text"), has("missing_label")], "completeness"),
        "eval_length": flagged(lambda: ["text_length", has("too_short"), has("too_long")], "length"),
        "eval_unicode": flagged(lambda: [F.round("abnormal_char_ratio", 6).alias("abnormal_char_ratio"), has("abnormal_chars")], "unicode"),
        "eval_top_char": flagged(lambda: [F.round("top_char_share", 6).alias("top_char_share")], "low_quality"),
        "eval_duplicates": flagged(lambda: ["duplicate_size", has("duplicate_text")], "duplicates"),
        "eval_consecutive": flagged(lambda: [F.size("punctuation_runs").alias("runs"), "abnormal_runs"], "consecutive"),
        "eval_special": flagged(lambda: ["control_characters", "invisible_characters", "residues"], "special"),
        "eval_pairing": eval_pairing, "eval_full": eval_full,
        "eval_score": lambda s, d: _eval(s, d, *PLAIN).select("row_no", joined("issues"), "score", "level", "action"),
        "eval_summary": lambda s, d: evaluate.summarize(_eval(s, d, *PLAIN)),
        "eval_issues": lambda s, d: evaluate.issue_counts(_eval(s, d, *PLAIN)),
        "eval_worst": lambda s, d: evaluate.worst(_eval(s, d, *PLAIN), "row_no").select("row_no", "score"),
        "modality_counts": lambda s, d: evaluate.distribution(read(s, d, "media_input"), "modality"),
        "denoise_markdown": lambda s, d: read(s, d, "documents").select("doc_id", clean_markdown(text_or_empty(F.col("text"))).alias("text")),
        "denoise_repetition": denoise_repetition, "denoise_repetition_filter": denoise_repetition_filter, "denoise_density": denoise_density, "denoise_semantic": denoise_semantic, "denoise_gate": denoise_gate, "denoise_text": denoise_full, "denoise_pii": denoise_pii,
        "denoise_encoding": denoise_encoding, "denoise_normalized": denoise_normalized, "denoise_risky": risky, "modality_route": routes, "pair_fields": pair_fields, "pair_scores": pair_scores,
        "html_parse": html_parse, "html_markdown": html_markdown, "markdown_chunks": chunks,
        "structured_records": structured, "structured_checks": structured_checked, "template_texts": templates, "qa_pairs": qa_pairs, "synthesis_gate": synthesis_gate,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
