"""SQL that each registered query is held against (DuckDB)."""

from __future__ import annotations

from sparkloom.functions import tables
from sparkloom.functions.chars import ALNUM, CJK, SPACE, WORD
from sparkloom.functions.normalize import MARKDOWN
from sparkloom.operators import evaluate as E


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def times(c: str, part: str) -> str:
    return f"((length({c}) - length(replace({c}, {q(part)}, ''))) // {len(part)})"


def hits(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def strip(c: str) -> str:
    return sub(c, f"^[{SPACE}]+|[{SPACE}]+$")


def squeeze(c: str) -> str:
    return f"trim({sub(c, f'[{SPACE}]+', ' ')}, ' ')"


def key(c: str) -> str:
    return f"lower({squeeze(f'coalesce({c}, {q('')})')})"


def listed(rules: list[tuple[str, str]]) -> str:
    return "[x FOR x IN [" + ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for n, c in rules) + "] IF x IS NOT NULL]"


def cost(issues: str, table: dict[str, float], other: float) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {float(v)}" for k, v in table.items())
    return f"coalesce(list_sum([CASE x {cases} ELSE {float(other)} END FOR x IN {issues}]), 0.0)"


BASE = f"base AS (SELECT *, coalesce(text, '') AS t, {strip("coalesce(text, '')")} = '' AS blank, id IS NULL OR {strip('id')} = '' AS no_id, label IS NULL OR {strip('label')} = '' AS no_label FROM text_dataset)"
PLAIN = "".join("\\" + c if c in "\\[]^-" else c for c in E.PLAIN_MARKS)
RUNS = "".join(E.RUN_MARKS)
ABNORMAL = f"CASE WHEN length(t) = 0 THEN 0.0 ELSE length({sub('t', f'[{SPACE}{CJK}{ALNUM}{PLAIN}]')})::DOUBLE / length(t) END"
RUN_LIST = f"regexp_extract_all(t, {q(f'[{RUNS}]{{2,}}')})"
RUN_BAD = (
    f"len([r FOR r IN {RUN_LIST} IF NOT list_contains([{', '.join(map(q, E.FINE_RUNS))}], r) AND (len(list_distinct(string_split(r, ''))) > 1"
    " OR length(r) > CASE WHEN r[1] = '…' THEN 6 WHEN r[1] = '.' THEN 3 ELSE 2 END)])"
)
CONTROL = hits("t", r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]")
HIDDEN = hits("t", f"[{E.INVISIBLE}]|\\p{{Cf}}")
RESIDUE = " + ".join(times("t", x) for x in E.RESIDUES)
RULES = [
    ("duplicate_text", "n > 1"), ("missing_id", "no_id"), ("missing_text_field", "text IS NULL"), ("empty_text", "blank"), ("missing_label", "no_label"), ("too_short", "NOT blank AND length(t) < 10"), ("too_long", "NOT blank AND length(t) > 2000"),
    ("abnormal_chars", f"{ABNORMAL} > 0.3"), ("consecutive_punctuation_abnormal", f"{RUN_BAD} > 0"), ("special_characters_abnormal", f"{CONTROL} + {HIDDEN} + {RESIDUE} > 0"),
]
SCORED = f"""WITH {BASE}, k AS (SELECT *, {key('text')} AS kk FROM base), n AS (SELECT *, CASE WHEN kk = '' THEN 0 ELSE count(*) OVER (PARTITION BY kk) END AS n FROM k),
i AS (SELECT *, {listed(RULES)} AS l FROM n), s AS (SELECT *, round(greatest(0.0, 100 - {cost('l', tables.PENALTIES, 10)}), 2) AS score FROM i),
g AS (SELECT *, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Average' ELSE 'Poor' END AS level,
  CASE WHEN list_has_any(l, [{', '.join(map(q, tables.FATAL))}]) OR score < 50 THEN 'drop' WHEN len(l) > 0 OR score < 75 THEN 'review' ELSE 'keep' END AS action FROM s)
"""
DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
GARBLED = " + ".join(times("t", m) for m in tables.GARBLED) + " + " + hits("t", r"[\x{80}-\x{9F}]")
WORDS = f"regexp_extract_all(lower(t), {q(f'[{WORD}]+')})"
USEFUL = f"length({sub('t', f'[^{WORD}]')})"
SEMANTIC = f"""s AS (SELECT *, {GARBLED} AS g, {WORDS} AS w FROM d), r AS (SELECT *, CASE WHEN len(w) < 4 THEN 0.0 ELSE 1 - len(list_distinct(w))::DOUBLE / len(w) END AS rep FROM s),
c AS (SELECT *, {strip('t')} = '' AS blank, greatest(0.0, 1 - least(g * 0.08::DOUBLE, 0.5::DOUBLE) - least(rep * 0.6::DOUBLE, 0.6::DOUBLE) - CASE WHEN {USEFUL}::DOUBLE / greatest(length(t), 1) < 0.45 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) AS c0,
  CASE WHEN {hits('t', '[。.!！?？;；]')} > 0 OR length(t) < 80 THEN 0.9::DOUBLE ELSE 0.72::DOUBLE END AS k0 FROM r),
m AS (SELECT *, CASE WHEN blank THEN 0.0 ELSE c0 END AS coherence, CASE WHEN blank THEN 0.0 ELSE k0 END AS completeness, CASE WHEN blank THEN 0.0 ELSE least(1.0, round(c0 * 0.65::DOUBLE + k0 * 0.35::DOUBLE, 4)) END AS semantic FROM c)"""
DENSITY = f"{USEFUL}::DOUBLE / greatest(length(t), 1)"
UNIQUE = f"len([x FOR x IN list_distinct(string_split({sub('t', f'[^{WORD}]')}, '')) IF x <> ''])::DOUBLE / greatest({USEFUL}, 1)"
MD = "t"
for _pattern, _to in MARKDOWN:
    MD = sub(MD, _pattern.replace("(?md)", "(?m)"), _to.replace("$1", "\\1"))
EDGES = "e AS (SELECT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b, coalesce(score, 0.0) AS score, coalesce(reason, '') AS reason, coalesce(duplicate_type, '') AS kind, coalesce(operator, '') AS op FROM dup_edges WHERE left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id)"
STAGE = "coalesce(list_position(['exact_hash', 'simhash_deduplicator', 'minhash_lsh_deduplicator', 'ann_recall', 'cross_encoder_rerank'], op), 0)"
KEEP_ORDER = "[{0}[k] FOR k IN range(1, len({0}) + 1) IF list_position({0}, {0}[k]) = k]"


def components(where: str) -> str:
    return f"""WITH RECURSIVE {EDGES}, p AS (SELECT a, b, max(least(1.0, score)) AS score FROM e GROUP BY a, b), two AS (SELECT a, b FROM p WHERE {where} UNION SELECT b, a FROM p WHERE {where}),
reach(a, b) AS (SELECT a, b FROM two UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a), root AS (SELECT a AS id, least(a, min(b)) AS root FROM reach GROUP BY a)"""


def group_ids() -> str:
    return """, spot AS (SELECT root, min(m.id) AS first, count(DISTINCT r.id) AS n FROM root r LEFT JOIN (SELECT DISTINCT id FROM media_input) m ON m.id = r.id GROUP BY root),
num AS (SELECT root, n, row_number() OVER (ORDER BY first NULLS FIRST, root) AS k FROM spot)"""


def sql() -> dict[str, str]:
    k = key("text")
    shingle = "CASE WHEN length(b) <= 5 THEN [b] ELSE list_distinct([substring(b, i, 5) FOR i IN range(1, length(b) - 3)]) END"
    rows = "SELECT row_no AS id, row_no AS s FROM text_dataset"
    low, high = "greatest(least(s + 1 + 10, 4000), 12)", "least(s + 2 + 5, 900)"
    first = f"regexp_extract({squeeze("coalesce(text, '')")}, '^[^。！？.!?]*[。！？.!?]?', 0)"
    dims = {n: f"greatest(0.0, 100 - coalesce(sum(len([x FOR x IN l IF list_contains([{', '.join(map(q, i))}], x)])), 0) / greatest(count(*), 1) * 100)" for n, i, _ in E.DIMENSIONS}
    mean = " + ".join(f"{dims[n]} * {w}" for n, _, w in E.DIMENSIONS)
    han, latin = hits("t", f"[{CJK}]"), hits("t", "[A-Za-z]")
    doc_rules = [
        ("language_unknown", "language = 'unknown'"), ("language_mismatch", "language NOT IN ('unknown', 'zh', 'mixed', 'en')"), ("empty_text", "length(t) = 0"), ("too_short", "length(t) > 0 AND length(t) < 12"), ("too_long", "length(t) > 2000"),
        ("low_info_density", f"{DENSITY} < 0.28 OR {UNIQUE} < 0.06"), ("semantic_low_quality", "semantic < 0.55"), ("semantic_needs_review", "semantic >= 0.55 AND semantic < 0.72"),
    ]
    return {
        "dedup_by_text": f"WITH k AS (SELECT doc_id, {k} AS k FROM documents), g AS (SELECT *, count(*) OVER w AS n, first_value(doc_id) OVER (PARTITION BY k ORDER BY doc_id::VARCHAR) AS f FROM k WINDOW w AS (PARTITION BY k)) SELECT doc_id, CASE WHEN k <> '' THEN f END AS keep_id, CASE WHEN k = '' THEN 0 ELSE n END AS group_size, CASE WHEN k = '' THEN 'review' WHEN doc_id = f THEN 'keep' ELSE 'remove' END AS action FROM g",
        "edge_fusion": f"WITH {EDGES}, u AS (SELECT a, b, reason, kind, op, {STAGE} AS o, max(least(1.0, score)) AS score FROM e GROUP BY ALL), l AS (SELECT a, b, round(max(score), 6) AS score, list({{'o': o, 'r': reason, 'p': op, 'k': kind}} ORDER BY o, reason, op, kind) AS l FROM u GROUP BY a, b), x AS (SELECT *, [z.r FOR z IN l] AS rs, [z.p FOR z IN l] AS ps, [z.k FOR z IN l] AS ks FROM l) SELECT a AS left_id, b AS right_id, score, array_to_string({KEEP_ORDER.format('rs')}, ',') AS reasons, array_to_string({KEEP_ORDER.format('ps')}, ',') AS operators, CASE WHEN list_contains(ks, 'exact') THEN 'exact' ELSE ks[1] END AS duplicate_type FROM x",
        "dedup_groups": f"{components('score >= 0')}{group_ids()} SELECT 'dup_group_' || lpad(k::VARCHAR, greatest(6, length(k::VARCHAR))::INTEGER, '0') AS duplicate_group_id, id, n AS group_size FROM root JOIN num USING (root)",
        "best_samples": f"{components('round(score, 6) >= 0.5')}{group_ids()}, z AS (SELECT id, max(length(coalesce(payload.image_path, payload.audio_path, payload.video_path, ''))) AS size FROM media_input GROUP BY id), m AS (SELECT r.root, r.id, coalesce(z.size, 0) AS size FROM root r LEFT JOIN z USING (id)), f AS (SELECT root, first(id ORDER BY size DESC, id) AS keep_id, count(*) AS members FROM m GROUP BY root) SELECT 'dup_group_' || lpad(k::VARCHAR, greatest(6, length(k::VARCHAR))::INTEGER, '0') AS duplicate_group_id, keep_id, members, members - 1 AS removed FROM f JOIN num USING (root)",
        "jaccard_pairs": f"WITH t AS (SELECT DISTINCT id, {k} AS k FROM text_sample), m AS (SELECT k, min(id) AS id FROM t WHERE length(k) >= 40 GROUP BY k), b AS (SELECT id, {sub('k', f'[{SPACE}]')} AS b FROM m), g AS (SELECT id, {shingle} AS g FROM b), p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.g, y.g)) AS i, len(x.g) + len(y.g) AS n FROM g x JOIN g y ON x.id < y.id WHERE least(len(x.g), len(y.g)) >= 0.8 * greatest(len(x.g), len(y.g))) SELECT a AS left_id, b AS right_id, round(i::DOUBLE / (n - i), 6) AS score, 'minhash_jaccard>=0.8' AS reason, 'near' AS duplicate_type, 'minhash_lsh_deduplicator' AS operator FROM p WHERE i::DOUBLE / (n - i) >= 0.8 UNION ALL SELECT m.id, t.id, 1.0, 'minhash_jaccard>=0.8', 'near', 'minhash_lsh_deduplicator' FROM m JOIN t USING (k) WHERE t.id <> m.id",
        "cosine_pairs": "WITH v AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS s FROM v x JOIN v y ON x.id < y.id) SELECT a AS left_id, b AS right_id, round(round(s, 6), 5) AS score FROM p WHERE s >= 0.35",
        "cosine_top": "WITH v AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS s FROM v x JOIN v y ON x.id < y.id) SELECT a AS left_id, b AS right_id, round(s, 5) AS score FROM p WHERE s >= 0 ORDER BY s DESC, a, b LIMIT 100",
        "resume_skip": "SELECT DISTINCT id, modality FROM dedup_input WHERE id NOT IN (SELECT id FROM dedup_input WHERE meta.source IS NOT NULL)",
        "eval_schema": f"WITH {BASE} SELECT row_no, NOT no_id AND text IS NOT NULL AS schema_valid, no_id AS missing_id, text IS NULL AS missing_text_field FROM base",
        "eval_completeness": f"WITH {BASE} SELECT row_no, round(((NOT no_id)::INT + (NOT blank)::INT + (NOT no_label)::INT)::DOUBLE / 3 * 100, 2) AS completeness, blank AS empty_text, no_label AS missing_label FROM base",
        "eval_length": f"WITH {BASE} SELECT row_no, length(t)::INT AS text_length, NOT blank AND length(t) < 10 AS too_short, NOT blank AND length(t) > 2000 AS too_long FROM base",
        "eval_unicode": f"WITH {BASE} SELECT row_no, round({ABNORMAL}, 6) AS abnormal_char_ratio, {ABNORMAL} > 0.3 AS abnormal_chars FROM base",
        "eval_top_char": f"WITH {BASE}, s AS (SELECT row_no, {sub('t', f'[{SPACE}]')} AS s FROM base), c AS (SELECT row_no, s, unnest(string_split(s, '')) AS c FROM s WHERE s <> ''), n AS (SELECT row_no, c, count(*)::DOUBLE / length(any_value(s)) AS p FROM c GROUP BY row_no, c), x AS (SELECT row_no, max(p) AS p FROM n GROUP BY row_no) SELECT row_no, round(coalesce(p, 0.0), 6) AS top_char_share FROM s LEFT JOIN x USING (row_no)",
        "eval_duplicates": f"WITH k AS (SELECT row_no, {k} AS k FROM text_dataset) SELECT row_no, CASE WHEN k = '' THEN 0 ELSE count(*) OVER w END AS duplicate_size, k <> '' AND count(*) OVER w > 1 AS duplicate_text FROM k WINDOW w AS (PARTITION BY k)",
        "eval_consecutive": f"WITH {BASE} SELECT row_no, len({RUN_LIST})::INT AS runs, {RUN_BAD}::INT AS abnormal_runs FROM base",
        "eval_special": f"WITH {BASE} SELECT row_no, {CONTROL}::INT AS control_characters, {HIDDEN}::INT AS invisible_characters, ({RESIDUE})::INT AS residues FROM base",
        "eval_score": f"{SCORED} SELECT row_no, array_to_string(l, ',') AS issues, score, level, action FROM g",
        "eval_summary": f"{SCORED} SELECT count(*) AS rows, round(avg(score), 2) AS average_score, count(*) FILTER (action = 'keep') AS keep, count(*) FILTER (action = 'review') AS review, count(*) FILTER (action = 'drop') AS drop, {', '.join(f'round({c}, 2) AS {n}_score' for n, c in dims.items())}, round(({mean}) / 1.0, 2) AS weighted_score FROM g",
        "eval_issues": f"{SCORED} SELECT issue, count(*) AS n FROM (SELECT unnest(l) AS issue FROM g) GROUP BY issue",
        "eval_worst": f"{SCORED} SELECT row_no, score FROM g WHERE score < 60 ORDER BY score, row_no LIMIT 20",
        "modality_counts": "SELECT modality AS value, count(*) AS n FROM media_input GROUP BY modality",
        "denoise_markdown": f"WITH {DOCS} SELECT doc_id, {squeeze(MD)} AS text FROM d",
        "denoise_repetition": f"WITH {DOCS}, w AS (SELECT doc_id, {WORDS} AS w FROM d) SELECT doc_id, round(CASE WHEN len(w) < 6 THEN 0.0 ELSE 1 - len(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]))::DOUBLE / (len(w) - 2) END, 6) AS triple_repetition FROM w",
        "denoise_density": f"WITH {DOCS} SELECT doc_id, round({DENSITY}, 6) AS info_density, round({UNIQUE}, 6) AS unique_char_ratio FROM d",
        "denoise_semantic": f"WITH {DOCS}, {SEMANTIC} SELECT doc_id, round(coherence, 6) AS coherence, completeness, round(semantic, 3) AS score FROM m",
        "denoise_gate": f"WITH {DOCS}, {SEMANTIC}, h AS (SELECT *, {han} AS han, {latin} AS latin FROM m), y AS (SELECT *, CASE WHEN han + latin < 4 THEN 'unknown' WHEN least(han, latin)::DOUBLE / greatest(han + latin, 1) >= 0.12 THEN 'mixed' WHEN han >= latin THEN 'zh' ELSE 'en' END AS language FROM h), i AS (SELECT *, {listed(doc_rules)} AS l FROM y), z AS (SELECT *, round(greatest(0.0, least(1.0, least(1 - {cost('l', tables.TEXT_PENALTIES, tables.TEXT_PENALTY_OTHER)}, semantic))), 4) AS quality_score FROM i) SELECT doc_id, language, array_to_string(l, ',') AS issues, floor(quality_score * 100)::BIGINT AS quality_score, CASE WHEN list_has_any(l, [{', '.join(map(q, tables.HARD_FAIL))}]) THEN 'drop' WHEN quality_score >= 0.75 THEN 'keep' WHEN quality_score >= 0.55 THEN 'review' ELSE 'drop' END AS action FROM z",
        "modality_route": f"WITH m AS (SELECT id, lower({strip('modality')}) AS k, payload.image_path AS i, payload.audio_path AS a, payload.video_path AS v FROM media_input) SELECT DISTINCT id, CASE WHEN k IN ('text', 'image', 'image_text_pair', 'video', 'audio') THEN k WHEN {strip("coalesce(v, '')")} <> '' THEN 'video' WHEN {strip("coalesce(i, '')")} <> '' THEN 'image' WHEN {strip("coalesce(a, '')")} <> '' THEN 'audio' ELSE 'unknown' END AS route FROM m",
        "pair_scores": "WITH g AS (SELECT id, max(coalesce(len(issues), -1)) AS m FROM generation_item GROUP BY id), h AS (SELECT id, CASE WHEN m < 0 THEN NULL ELSE m END AS n FROM g), s AS (SELECT id, n, coalesce((n % 5)::DOUBLE / 4, 1.0) AS tq, coalesce((n % 3)::DOUBLE / 2, 0.5) AS cl FROM h) SELECT id, round(greatest(0.0, least(1.0, 0.08 + least(1.0, tq) * 0.16 + 0.16 + 0.5 * 0.14 + cl * 0.18 + 0.5 * 0.08 + 0.5 * 0.1 + cl * 0.1 + 0.06 - CASE WHEN n > 1 THEN 0.18 ELSE 0 END)), 4) AS quality_score FROM s",
        "structured_records": f"SELECT id, ['basic', 'plus', 'pro'][(s % 3 + 1)::INT] AS tier, {low} AS low, {high} AS high, round(least((s + 3) * 0.25::DOUBLE + 0.5, 300.0), 3) AS share, (s + 4) % 2 = 0 AS flag, 'rec_' || id || '_5' AS code FROM ({rows})",
        "structured_checks": f"SELECT id, CASE WHEN {low} <= {high} THEN '' ELSE 'consistency_rule_failed:low <= high' END AS issues FROM ({rows})",
        "template_texts": "SELECT DISTINCT id, 'Write a ' || coalesce(payload.style, '') || ' text about ' || coalesce(payload.topic, '') || ' for ' || coalesce(payload.audience, '') || '. ' || coalesce(prompt, '') AS generated_text FROM generation_item",
        "qa_pairs": f"WITH a AS (SELECT doc_id, {first} AS answer FROM documents) SELECT doc_id, i::INT AS pair_index, 'What is the key point of ' || answer || '?' AS question, answer FROM a, range(2) r(i) WHERE answer <> ''",
        "synthesis_gate": "WITH g AS (SELECT id, min(coalesce(generated.output, '')) AS text FROM generation_item GROUP BY id), d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY id) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS diversity FROM g), v AS (SELECT id, diversity, round(greatest(0.0, least(1.0, (text <> '')::INT * 0.6::DOUBLE + diversity * 0.4 - (diversity = 0)::INT * 0.2::DOUBLE)), 4) AS quality FROM d) SELECT id, diversity, quality, CASE WHEN quality >= 0.7 AND diversity = 1 THEN 'accepted' ELSE 'filtered' END AS status FROM v",
    }
