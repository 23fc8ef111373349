"""Records that are the same but for formatting: white space, case, punctuation, field order and notation.

Method: bring the characters, case, white space, punctuation and field order of a text to one canonical key,
hash the key to 128 bits, and count copies by hash with map-side combining. Every hash carries a third, independent
64-bit hash and the key's length; a group in which these differ is a collision and stops the query
(a run with another ``seed`` then decides it), so two contents can never be merged.

All expressions are Spark's own; only texts with combining marks or conjoining jamo leave the JVM, to be composed.

* Null texts and texts without a letter or digit have no key and are in no group.
* An id that is delivered again counts once. Ties: the least id by bytes is kept.
* A text is a record of named fields if it is a JSON object, or if its parts, at least two, split at line ends, ``|``, ``;``, tabs or commas, all
  have the form ``name: value`` or ``name = value``. The notations are tried in turn; between marks that prose holds too (``;``, tabs, commas) a name is one word. A name that occurs twice keeps both values; objects inside
  a JSON value are brought into the order of their names. A record of one field has the key of the plain text, for there is no order.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.plans.hot import join_groups
from sparkloom.plans.shared import Scratch

#: Full-width letters and digits. Other compatibility forms stay: by NFKC ½ would meet 12.
_WIDE = "".join(chr(k + 0xFEE0) for k in range(0x30, 0x7B) if chr(k).isalnum())
_NARROW = "".join(chr(k) for k in range(0x30, 0x7B) if chr(k).isalnum())
#: Texts that composition can change: with combining marks or conjoining jamo.
_LOOSE = r"[\p{M}\x{1100}-\x{11FF}]"
_NAME, _WORD = r"^\s*[\p{L}_][\p{L}\p{N}_\- ]*$", r"^\s*[\p{L}_][\p{L}\p{N}_\-]*\s*$"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(c: Column) -> Column:
    """Letters (with their marks) and digits in full case folding: upper case first, so that ß meets SS. Variation selectors are no marks."""
    plain = F.translate(c, _WIDE, _NARROW)
    return F.lower(F.upper(F.regexp_replace(plain, r"[^\p{L}\p{N}\p{M}]+|[\x{FE00}-\x{FE0F}]+", "")))


def _named(name: Column, value: Column) -> Column:
    return F.concat(folded(name), F.lit("\u0001"), folded(F.coalesce(value, F.lit(""))))


def _joined(fields: Column) -> Column:
    """The fields in order; one field reads as plain text."""
    return F.when(F.size(fields) == 1, F.replace(fields[0], F.lit("\u0001"), F.lit(""))).otherwise(F.concat(F.lit("\u0002"), F.array_join(F.array_sort(fields), "\u0002")))


def _ordered(value: Column) -> Column:
    """Objects within the value with their names in order (so a variant holds them)."""
    return F.when(value.rlike(r"^[\[{]"), F.coalesce(F.to_json(F.try_parse_json(value)), value)).otherwise(value)


def _from_json(s: Column) -> Column:
    parsed = F.from_json(s, "map<string,string>", {"allowUnescapedControlChars": "true", "mode": "PERMISSIVE"})
    return _let(parsed, lambda m: F.when(F.size(m) > 0, _joined(F.transform(F.map_entries(m), lambda e: _named(e["key"], _ordered(e["value"]))))))


def _from_parts(s: Column, separator: str, name: str = _NAME) -> Column:
    """The fields of the text, if every part has the form name: value."""
    halves = F.transform(F.split(s, separator), lambda p: F.split(p, "[:=]", 2))
    whole = lambda hs: (F.size(hs) >= 2) & F.forall(hs, lambda h: (F.size(h) == 2) & h[0].rlike(name))
    return _let(halves, lambda hs: F.when(whole(hs), _joined(F.transform(hs, lambda h: _named(h[0], h[1])))))


def canonical(text: Column) -> Column:
    """The canonical key; null without a letter or digit."""

    def key(s: Column) -> Column:
        fields = F.coalesce(
            F.when(s.startswith("{") & s.endswith("}"), _from_json(s)),
            F.when(s.contains("|"), _from_parts(s, r"\|")),
            F.when(s.rlike(r"^[^\s=]+\s*="), _from_parts(s, r";\s*(?=[\p{L}_][\p{L}\p{N}_\-]*\s*=)")),
            F.when(s.contains("\n") | s.contains("\r"), _from_parts(s, r"[\r\n]+")),
            F.when(s.contains(";"), _from_parts(s, ";", _WORD)),
            F.when(s.contains("\t"), _from_parts(s, r"\t+", _WORD)),
            F.when(s.contains(","), _from_parts(s, r",\s*(?=[\p{L}_][\p{L}\p{N}_\-]*\s*[:=])", _WORD)),
        )
        return _let(fields, lambda f: F.when(f.isNotNull(), f).otherwise(F.nullif(folded(s), F.lit(""))))

    return _let(F.btrim(text, F.lit(" \t\r\n\ufeff")), key)


def composed(rows: DataFrame) -> DataFrame:
    """rows with ``text`` in composed form (NFC); only texts that it can change leave the JVM."""

    def run(it):
        for pdf in it:
            pdf["text"] = [unicodedata.normalize("NFC", t) for t in pdf["text"]]
            yield pdf

    loose = F.coalesce(F.col("text").rlike(_LOOSE), F.lit(False))
    return rows.where(~loose).unionByName(rows.where(loose).mapInPandas(run, rows.schema))


def keyed(df: DataFrame, id_col: str, text: Column, *extra: Column, seed: int = 0) -> DataFrame:
    """(id, h1, h2, chk, len, extra...) of the rows that have a key. The key is worked out once a row: what it is hashed to
    goes through a generator, past which no filter or projection can move."""
    hashes = lambda k: F.struct(*(F.xxhash64(F.lit(seed + i), k).alias(n) for i, n in enumerate(("h1", "h2", "chk"))), F.length(k).alias("len"))
    df = composed(df.select(F.col(id_col).alias("id"), text.alias("text"), *extra))
    hashed = _let(canonical(F.col("text")), lambda k: F.when(k.isNotNull(), F.array(hashes(k))))
    rows = df.select(*(c for c in df.columns if c != "text"), F.explode(hashed).alias("k")).where("id is not null")
    return rows.select("id", "k.h1", "k.h2", "k.chk", "k.len", *(c for c in rows.columns if c not in ("id", "k")))


def _checked(groups: DataFrame) -> DataFrame:
    same = (F.col("c0") == F.col("c1")) & (F.col("l0") == F.col("l1"))
    return groups.withColumn("n", F.when(same, F.col("n")).otherwise(F.raise_error(F.lit("two contents share a 128-bit hash; run with another seed")).cast("long"))).drop("c0", "c1", "l0", "l1")


def copies(df: DataFrame, id_col: str, text: Column, seed: int = 0) -> DataFrame:
    """(id, keep_id, copies) of every id whose content at least one other id has."""
    work = Scratch(df.sparkSession, "formatting")
    rows = work.keep(keyed(df, id_col, text, seed=seed).distinct())
    groups = rows.groupBy("h1", "h2").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.min("chk").alias("c0"), F.max("chk").alias("c1"), F.min("len").alias("l0"), F.max("len").alias("l1"))
    groups = work.keep(_checked(groups).where("n > 1"))
    return join_groups(rows.select("id", "h1", "h2"), groups, ["h1", "h2"], "n").select("id", "keep_id", F.col("n").alias("copies"))


def collapse(df: DataFrame, id_col: str, text: Column, variant: Column, seed: int = 0) -> DataFrame:
    """(keep_id, copies, variants): one row per content, also those of a single id; variants: the values seen, sorted, nulls left out.

    Ids are counted by content, and variants made distinct by (content, variant), each with map-side combining, before a content is one row.
    """
    work = Scratch(df.sparkSession, "formatting")
    rows = work.keep(keyed(df, id_col, text, variant.alias("variant"), seed=seed).distinct())
    ids = rows.select("id", "h1", "h2", "chk", "len").distinct()
    groups = ids.groupBy("h1", "h2").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.min("chk").alias("c0"), F.max("chk").alias("c1"), F.min("len").alias("l0"), F.max("len").alias("l1"))
    seen = rows.where("variant is not null").select("h1", "h2", "variant").distinct().groupBy("h1", "h2").agg(F.sort_array(F.collect_list("variant")).alias("variants"))
    none = F.array().cast("array<string>")
    return _checked(groups).join(seen, ["h1", "h2"], "left").select("keep_id", F.col("n").alias("copies"), F.coalesce("variants", none).alias("variants"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/dedup_input.parquet").select("id", F.col("payload.text").alias("text"))
    return copies(d, "id", F.col("text")).select("id", "keep_id")


def p6_kept(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/dedup_input.parquet").select("id", F.col("payload.text").alias("text"), F.col("meta.variant").alias("variant"))
    return collapse(d, "id", F.col("text"), F.col("variant")).withColumn("variants", F.array_join("variants", "\n"))
