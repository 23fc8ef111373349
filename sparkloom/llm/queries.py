"""The pN_ queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from sparkloom.llm import answers, components, containers, formatting, lookalike, mixing, mojibake, quality, similar


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": components.p1_found, "p2_found": answers.p2_found, "p6_found": formatting.p6_found, "p6_kept": formatting.p6_kept, "p3_found": lookalike.p3_found, "p3_forms": lookalike.p3_forms, "p3_classes": lookalike.p3_classes, "p4_found": similar.p4_found, "p5_found": quality.p5_found, "p5_stats": quality.p5_stats, "p7_packed": containers.p7_packed, "p8_selected": mixing.p8_selected, "p8_shares": mixing.p8_shares, "p9_found": mojibake.p9_found, "p9_restored": mojibake.p9_restored}


P1_FOUND = """
WITH RECURSIVE member AS (
  SELECT row_number() OVER () AS r, group_id AS g, list_distinct([x FOR x IN member_ids IF x IS NOT NULL]) AS m FROM dup_groups
), head AS (SELECT r, g, list_min(m) AS h, m FROM member WHERE len(m) > 0),
link AS (
  SELECT left_id AS a, right_id AS b FROM dup_edges WHERE left_id IS NOT NULL AND right_id IS NOT NULL
  UNION SELECT h, unnest(m) FROM head
  UNION SELECT h, min(h) OVER (PARTITION BY g) FROM head WHERE g IS NOT NULL
), both_ways AS (SELECT a, b FROM link WHERE a <> b UNION SELECT b, a FROM link WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT a AS record_id, least(a, min(b)) AS group_id FROM reach GROUP BY a
"""


P4_FOUND = r"""
WITH r AS (SELECT DISTINCT id, list_distinct(regexp_extract_all(lower(payload.text), '[\p{L}\p{N}]+')) AS w FROM dedup_input WHERE id IS NOT NULL AND payload.text IS NOT NULL),
s AS (SELECT id, w, len(w) AS n FROM r WHERE len(w) > 0)
SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.id < b.id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) WHERE 17 * len(list_intersect(a.w, b.w)) >= 7 * (a.n + b.n)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p4_found": P4_FOUND}
