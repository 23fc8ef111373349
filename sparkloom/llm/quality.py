"""Per-document text statistics, and the documents that are not prose: lists, tables and junk.

Statistics: words, mean word length, symbol ratio, share of lines that end in punctuation, share of common words; repetition: share of characters in
repeated lines and paragraphs, share of characters that the most frequent word pair, triple and quadruple cover.

Kind: every line is taken for a table row, a list item, a part of running text or a heading, by combined rules over its neighbours
(a column needs rows that agree, unmarked items need a run of short lines). The kind that holds more than half of the characters
wins. What is left as running text is junk if it has no language in it: few letters, one endless token, repetition, or words that neither stand in
the lists of common words nor are built and mixed as those of a language are (whatever the language: in speech short words recur
between long ones, and words can be spoken).

One row of work per document in Arrow batches, no shuffle. Null texts: null statistics and no kind; blank texts: zeros and no kind. Ties between kinds: prose.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Common words by language.
COMMON = {
    "en": "the a an of to in and is was for that on with at by from it as so but not be or after before when while once this which has had have are were no if than then there their its into only between near under during until because although will would can may should one all",
    "de": "der die das und den dem des ein eine einen einer eines im in zu mit von aus für auf nach vor ist nicht sich es an bei seit als auch wie wird war aber oder dass während zur zum über unter am sie er wir ich laut gilt später trotz",
    "fr": "le la les l de des du un une et à en dans sur pour par avec que qui est ne pas se ce cette au aux d plus sans selon ou mais dès tandis pendant avant après sous été ont a il elle on nous vous",
    "es": "el la los las un una y de del en que por con al se su sin es no para más como pero mientras según cuando lo cada uno tras durante antes desde entre a o e fue ha",
    "pt": "o a os as um uma e de do da dos das em no na nos nas que por com ao se sem não para mais como mas após antes desde durante à foi são ou",
    "it": "il lo la i gli le un una e di del della dei che in con per non è da al alla si come più ma anche sono era o",
    "ru": "и в на не что с по из для к от это как за но а о после до или бы то же",
}
STOP = frozenset(w for ws in COMMON.values() for w in ws.split())
END_MARKS = ".!?…。！？:;\"'”’»)"

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TABLE = re.compile(r"<table\b.*?(?:</table>|\Z)", re.I | re.S)
_ROW_TAGS = re.compile(r"<t[rdh]\b", re.I)
_ITEM = re.compile(r"<li\b[^>]*>(.*?)(?=</?li\b|</[ou]l\b|\Z)", re.I | re.S)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_MARK = re.compile(r"\s*(?:[-*+•–—→▪◦○●■□✓✗‣⁃»>]\s+|\[[ xX✓]?\]\s*|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.):](?:\s+|$))(.*)")
_INLINE = re.compile(r"(?:^|\s)\(?(\d{1,3})[.)]\s")
_LEADER = re.compile(r"(?:…|\.{3,}|·{2,})\s*\d+\s*$")
_RULE = re.compile(r"[\s|:+\-=─-╿]+$")
_SENTENCE_END = re.compile(r"[.!?。！？][\"”’»)]*(?:\s|$)")
_INSIDE = re.compile(r"[^\W\d_][%<>=|~^@#$&*\\]+[^\W\d_]")


def _weight(s: str) -> int:
    return sum(not c.isspace() for c in s)


def _columns(lines: list[str]) -> list[bool]:
    """Which lines are rows of a table."""
    row = [False] * len(lines)

    def runs(ok: list[int], least: int, agree: bool) -> None:
        k = 0
        while k < len(lines):
            if ok[k] < 1:
                k += 1
                continue
            j = k
            while j < len(lines) and ok[j] >= 1 and (not agree or ok[j] == ok[k]):
                j += 1
            if j - k >= least:
                row[k:j] = [True] * (j - k)
            k = j

    def cells(s: str, d: str) -> int:
        parts = re.sub(r'"[^"]*"', lambda m: m.group().replace(d, " "), s).split(d)
        n = len(parts) - 1
        if not n:
            return 0
        short = all(len(p.split()) <= 8 for p in parts) and not re.search(r"[.!?]\s+\S", s)
        tight = d not in ",;" or sum(p.startswith(" ") for p in parts[1:]) <= n / 3
        return n if short and tight and (n > 1 or (parts[0].strip() and parts[1].strip())) else 0

    runs([s.count("\t") for s in lines], 2, False)
    runs([max(s.count("|"), s.count("│")) if max(s.count("|"), s.count("│")) > 1 or _RULE.match(s) else 0 for s in lines], 2, False)
    for d in ";,":
        runs([cells(s, d) for s in lines], 3, True)
    gaps = [len(re.findall(r"\S {2,}(?=\S)", s)) for s in lines]
    short = [g if not re.search(r"[.!?] {1,3}\S", s) else 0 for g, s in zip(gaps, lines)]
    runs(short, 3, False)
    for k, s in enumerate(lines):  # rules, and rows whose last cells are empty
        near = (k and row[k - 1]) or (k + 1 < len(lines) and row[k + 1])
        if not row[k] and near and (_RULE.match(s) or (k and row[k - 1] and k + 1 < len(lines) and row[k + 1])):
            row[k] = True
    return row


def _inline(s: str) -> bool:
    """Numbered items within a line: at least three in order."""
    seen = [int(m.group(1)) for m in _INLINE.finditer(s)]
    best = run = 1
    for a, b in zip(seen, seen[1:]):
        run = run + 1 if b == a + 1 else 1
        best = max(best, run)
    return best >= 3


def _item(s: str) -> bool:
    """A marked item; a whole sentence behind a mark is running text (speech is marked so)."""
    m = _MARK.match(s)
    return bool(m) and not (_SENTENCE_END.search(m.group(1)) and len(m.group(1).split()) >= 5)


def _split(text: str) -> tuple[dict[str, int], str]:
    """Characters by kind, and the running text."""
    w = {"list": 0, "table": 0}
    for m in _TABLE.finditer(text):
        w["table"] += _weight(_TAG.sub("", m.group()))
    text = _TABLE.sub("\n", text)
    if len(_ROW_TAGS.findall(text)) >= 3:
        w["table"] += _weight(_TAG.sub("", text))
        text = ""
    for m in _ITEM.finditer(text):
        w["list"] += _weight(_TAG.sub("", m.group(1)))
    text = _TAG.sub(" ", _ITEM.sub("\n", text))
    lines = [s for s in re.split(r"\r\n|\r|\n|\x85| ", text) if s.strip()]
    row = _columns(lines)
    prose: list[str] = []
    k = 0
    while k < len(lines):
        s = lines[k]
        if row[k]:
            w["table"] += _weight(s)
            k += 1
            continue
        if _inline(s):
            w["list"] += _weight(s)
        elif _LEADER.search(s):
            w["list"] += _weight(s)
        elif _item(s):
            w["list"] += _weight(s)
        elif re.match(r"\s*#{1,6}\s", s):
            pass  # headings count for no side
        elif s.rstrip().endswith((":", "：")) and len(s.split()) <= 6:
            pass
        else:
            j = k + 1
            while j < len(lines) and not row[j] and not _item(lines[j]) and not _LEADER.search(lines[j]) and not _inline(lines[j]):
                j += 1
            run = lines[k:j]
            words = [len(x.split()) for x in run]
            inner = sum(bool(re.search(r"[.!?。！？]\S? +\S", x)) for x in run)
            if len(run) >= 3 and sum(words) / len(run) <= 5 and max(words) <= 9 and inner < 0.2 * len(run):
                w["list"] += sum(map(_weight, run))
                prose.append("")
                k = j
                continue
            prose += run
            k = j
            continue
        k += 1
    return w, "\n".join(prose)


def _coverage(words: list[str], n: int) -> float:
    """Share of the characters that occurrences of the most frequent n-gram hold; 0 unless it occurs twice."""
    if len(words) < 2 * n:
        return 0.0
    gram, times = Counter(zip(*(words[i:] for i in range(n)))).most_common(1)[0]
    return min(1.0, times * sum(map(len, gram)) / max(1, sum(map(len, words)))) if times > 1 else 0.0


def _repeated(parts: list[str]) -> float:
    c = Counter(parts)
    return sum(len(p) * (n - 1) for p, n in c.items()) / max(1, sum(len(p) * n for p, n in c.items()))


#: Least share of words of at most three letters, and largest share of words that cannot be spoken, in the text of a language.
SHORT, UNSPOKEN = 0.12, 0.1
# Vowels of the Latin, Greek and Cyrillic alphabets, after the accents are taken off.
VOWELS = frozenset("aeiouyæøœıαεηιουωаеиоуыэюяієё")


def _spoken(word: str) -> bool:
    """It has a vowel, and no five consonants stand in a row."""
    run = most = vowels = 0
    for c in unicodedata.normalize("NFD", word):
        if unicodedata.combining(c):
            continue
        run = 0 if c in VOWELS else run + 1
        vowels += c in VOWELS
        most = max(most, run)
    return len(word) < 2 or (vowels > 0 and most < 5)


def _is_speech(words: list[str]) -> bool:
    words = [x for x in words if not any(map(str.isdigit, x))]
    if len(words) < 5:
        return False
    return sum(len(x) <= 3 for x in words) >= SHORT * len(words) and sum(not _spoken(x) for x in words) <= UNSPOKEN * len(words)


def _is_junk(text: str) -> bool:
    body = _weight(text)
    words = [x.lower() for x in _WORD.findall(text)]
    if body < 20:
        return False
    letters = sum(c.isalpha() for c in text)
    if letters < 0.55 * body:
        return True
    tokens = text.split()
    if sum(len(t) for t in tokens if len(t) > 30 and not t.startswith("http") and t.isascii()) > 0.5 * body:
        return True
    if len(words) < 5:
        return False
    wide = sum(ord(c) > 0x2FF for c in text)
    if len(words) >= 10 and len(set(words)) < 0.3 * len(words) and (len(set(words)) <= 12 or _coverage(words, 2) > 0.2):
        return True
    if len(_INSIDE.findall(text)) >= max(3, 0.1 * len(words)):
        return True
    if wide > 0.3 * letters:
        return False
    common = sum(x in STOP for x in words) / len(words)
    return common < 0.07 and not _is_speech(words)


def stats(text: str | None) -> tuple:
    """words, mean_word_length, symbol_ratio, punct_line_share, common_share, dup_line_share, dup_para_share, top2, top3, top4, kind."""
    if text is None:
        return (None,) * 11
    words = _WORD.findall(text)
    low = [w.lower() for w in words]
    lines = [s.strip() for s in text.splitlines() if s.strip()]
    paras = [p.strip() for p in re.split(r"(?:\r?\n){2,}", text) if p.strip()]
    body = _weight(text)
    symbols = sum(not c.isalnum() and not c.isspace() for c in text)
    kind = None
    if body:
        w, prose = _split(text)
        rest = _weight(prose)
        if rest >= max(w["list"], w["table"]) and rest >= w["list"] + w["table"]:
            kind = "junk" if _is_junk(prose) else None
        else:
            kind = max(("table", "list"), key=lambda k: w[k])
            if kind == "list" and sum(c.isalpha() for c in text) < 0.3 * body:
                kind = "junk"
    return (
        len(words), round(sum(map(len, words)) / len(words), 4) if words else 0.0, round(symbols / body, 4) if body else 0.0,
        round(sum(s[-1] in END_MARKS for s in lines) / len(lines), 4) if lines else 0.0, round(sum(x in STOP for x in low) / len(low), 4) if low else 0.0,
        round(_repeated(lines), 4) if lines else 0.0, round(_repeated(paras), 4) if paras else 0.0, *(round(_coverage(low, n), 4) for n in (2, 3, 4)), kind,
    )


NAMES = ("words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share", "dup_line_share", "dup_para_share", "top2_coverage", "top3_coverage", "top4_coverage", "kind")


def text_stats(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, statistics, kind) of every row."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([stats(t) for t in pdf["text"]], columns=list(NAMES), index=pdf.index)
            out["words"] = out["words"].astype("Int32")
            for c in NAMES[1:-1]:
                out[c] = out[c].astype("Float64")
            out.insert(0, "id", pdf["id"])
            yield out

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, words int, " + ", ".join(f"{c} double" for c in NAMES[1:-1]) + ", kind string")


def p5_found(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/text_dataset.parquet")
    return text_stats(d, "row_no").where("kind is not null").select(F.col("id").alias("row_no"), "kind").distinct()


def p5_stats(spark, sf_dir: str) -> DataFrame:
    return text_stats(spark.read.parquet(f"{sf_dir}/text_dataset.parquet"), "row_no").withColumnRenamed("id", "row_no")
