"""Generated items whose output is no usable answer to the prompt: empty, copied, refusal, wrong_language, truncated.

Method: prompt and output are aligned by the containment of their word triples in each other and by their longest common subsequence (copied);
every sentence of the output is held against refusal templates in five languages; the language is told by script and common words. An output without an
end mark is truncated if something stays open in it (quote, bracket, JSON, code fence), or if its last word hardly ever ends a clause
elsewhere in the table: so a finished answer that only lacks its mark is none.

The first type in the order above wins. An id that is delivered again counts once.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.quality import COMMON
from sparkloom.plans.shared import Scratch

#: The languages that have a word among their common ones.
SPOKEN: dict[str, tuple[str, ...]] = {}
for _k, _ws in COMMON.items():
    for _w in set(_ws.split()):
        SPOKEN[_w] = (*SPOKEN.get(_w, ()), _k)
#: Of the clauses a word stands in, the share it must end at least.
ENDS = 0.08

_CJK = re.compile(r"[㐀-鿿]")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+(?:['’][^\W_]+)*")
_PLACEHOLDER = frozenset("null none nil na nan n/a undefined todo tbd empty void placeholder 无 空 暂无 ohne keine leer vide aucun aucune ninguno vacío".split()) | {"no output", "no answer", "no response", "no content", "lorem ipsum", "to do", "not available", "your answer here", "insert answer here", "answer here", "output", "answer", "response", "k a", "n a", "s o", "待补充", "无内容", "string", "text"}
_NAMED = {
    "en": r"\benglish\b|englisch|anglais|ingl[eé]s|英[语文]", "de": r"\bgerman\b|deutsch|allemand|alem[aá]n|德[语文]", "fr": r"\bfrench\b|französisch|français|franc[eé]s|法[语文]",
    "es": r"\bspanish\b|spanisch|espagnol|español|castellano|西班牙", "zh": r"\bchinese\b|chinesisch|chinois|chino\b|[中汉][文语]",
}
_REPEAT = re.compile(r"\b(?:repeat|copy out|wiederhol\w*|répète\w*|répéter|repite|repita|copia)\b|重复|复述|照抄|原样", re.I)
_REFUSAL = re.compile(
    r"\bI(?:['’]m| am)? (?:can(?:no|['’])t|am not able|not able|unable|won['’]t|will not|must decline|decline|have to decline|do not answer|refuse|am not allowed|not allowed|hold no view|may not)\b|\bI can not\b|\bmy rules keep me\b"
    r"|\bnot (?:be )?(?:right|possible|appropriate) for me to\b|\bnothing I can (?:offer|say|add)\b|\bI don['’]t feel comfortable\b|\bI (?:have to|must) pass on\b|\bI(?:['’]d| would) (?:rather|prefer) not\b|\bno (?:answer|reply|response) can be given\b"
    r"|\bmöchte ich mich (?:\w+ ){0,4}?nicht\b|\bich muss [^.]{0,80}?ablehnen\b|\bhabe ich [^.]{0,80}?keine Meinung\b|\bkeine Antwort (?:gegeben|möglich)\b"
    r"|\bje préfère ne pas\b|\baucune réponse ne peut\b|\bsort de ce que je peux\b|\bprefiero no\b|\bno (?:se )?puede (?:dar|dars)\w* (?:una )?respuesta\b|\bqueda fuera de lo que\b"
    r"|\blanguage model should not\b|\bals Sprachmodell\b|\bmodelo de lenguaje no\b|\bmodèle de langue\b|\bcette demande sur\b|语言模型"
    r"|\bas an? (?:AI|assistant|language model)\b|\boutside what I may\b|\bsomething I (?:do not|don['’]t|can(?:no|['’])t|won['’]t)\b"
    r"|\bkann ich (?:\w+ ){0,6}?(?:nicht|keine|nichts)\b|\bich (?:kann|darf|werde|möchte) (?:[\w«»„“\"]+ ){0,8}?(?:nicht|keine|nichts)\b|\bist mir (?:hier )?nicht (?:erlaubt|möglich|gestattet)\b|\bdarf ich (?:\w+ ){0,6}?(?:nicht|keine|nichts)\b|\bmuss ich (?:\w+ ){0,6}?ablehnen\b|\bich muss (?:\w+ ){0,6}?ablehnen\b|\bals (?:KI|Assistent)\w*\b"
    r"|\bje (?:ne|n['’])\s?(?:peux|puis|suis|dois|saurais|veux|réponds|souhaite|donne|traite|ai)\b|\bil (?:ne )?m['’]est (?:pas |impossible)|\bje (?:dois|préfère|refuse) (?:\w+ )*?(?:refuser|décliner|de)\b|\ben tant qu['’](?:assistant|IA)\b"
    r"|\bno (?:puedo|me es posible|me está permitido|estoy en condiciones|debo|voy a|respondo|tengo permitido|se me permite)\b|\bme resulta imposible\b|\bdebo (?:rechazar|declinar)\b|\bcomo (?:asistente|IA)\b"
    r"|我(?:也|们)?(?:不能|无法|不会|不可以|不便|没法|帮不了|拒绝|不该|没有办法)|恕我|无法(?:回答|提供|帮助|协助)|不在我|作为(?:一个)?(?:助手|人工智能|AI)",
    re.I,
)
_POINTER = re.compile(
    r"^(?:thank you|thanks|i['’]?m? ?(?:am )?(?:sorry|apologi[sz]e)|sorry|unfortunately|regrettably|i['’]?m afraid|please|let me know|there may be rules|danke|vielen dank|es tut mir leid|tut mir leid|leider|bitte|gern\w* |bei einem anderen|merci|désolé\w*|je regrette|je reste|verzeihung|entschuldig\w*|perdón|perdone|disculpe|pardon|je suis désolé\w*|malheureusement|veuillez|je peux|n['’]hésitez|gracias|lo siento|por desgracia|lamentablemente|consulte|puedo ayudar|por favor|i can help|i could help|feel free|ich helfe|ich kann|il existe|il se peut|es kann|puede que|es posible|感谢|谢谢|抱歉|对不起|很遗憾|请|如有|如果|我可以|可以|可能)",
    re.I,
)
_OPEN = re.compile(r"[,;:，；：、–—\-(\[{“„«/&+=]\s*$")
_DONE = re.compile(r"[.!?。！？…][\"”’»)\]*_`】」』]*\s*$")
_CLAUSE = re.compile(r"[.!?。！？,;:，；：\n)]")
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)


def tokens(s: str) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(s)]


def _is_empty(out: str | None) -> bool:
    if out is None:
        return True
    bare = re.sub(r"</?\w+[^<>]*>|&nbsp;", " ", out)
    words = re.findall(r"[^\W_]+", bare.lower())
    return not words or " ".join(words) in _PLACEHOLDER or "/".join(words) in _PLACEHOLDER


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one number."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for x in a:
        if m := at.get(x):
            row = (row + (row & m) | row - (row & m)) & full
    return len(b) - row.bit_count()


def _is_copied(prompt: str, out: str) -> bool:
    p, o = tokens(prompt), tokens(out)
    if len(p) < 3 or len(o) < 0.6 * len(p):
        return False
    if _REPEAT.search(prompt):
        head = tokens(re.split(r"[:：]", prompt, maxsplit=1)[0])
        if _common(head, o) < 0.7 * len(head):
            return False
    triples = lambda t: [tuple(t[i : i + 3]) for i in range(len(t) - 2)]
    tp, to = triples(p), triples(o)
    sp, so = set(tp), set(to)
    rounds = max(1, round(len(o) / len(p)))
    inside = sum(x in sp for x in to) + 2 * (rounds - 1)  # where one copy meets the next
    if sum(x in so for x in tp) >= 0.75 * len(tp) and inside >= 0.75 * len(to):
        return True
    return len(o) <= 1.3 * len(p) and (c := _common(p, o)) >= 0.8 * len(p) and c >= 0.8 * len(o)


def _sentences(s: str) -> list[str]:
    return [x.strip() for x in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|;\s+|\n+", s) if x.strip()]


def _is_refusal(out: str) -> bool:
    parts = _sentences(out)
    return bool(parts) and len(parts) <= 6 and any(_REFUSAL.search(x) for x in parts) and all(_REFUSAL.search(x) or _POINTER.search(x) for x in parts)


def language(s: str) -> tuple[str | None, dict[str, int]]:
    """The language, if it can be told, and the words that speak for each."""
    words = tokens(s)
    score = dict.fromkeys(COMMON, 0)
    for w in words:
        spoken = {k for x in (w, *re.split("['’]", w)) for k in SPOKEN.get(x, ())} if "'" in w or "’" in w else SPOKEN.get(w, ())
        for k in spoken:
            score[k] += 1
    score["zh"] = sum(bool(_CJK.match(w)) for w in words) // 2
    best = sorted(score, key=lambda k: -score[k])
    return (best[0] if score[best[0]] > score[best[1]] else None), score


def _is_foreign(prompt: str, out: str) -> bool:
    said, score = language(_FENCED.sub(" ", out))
    if not said or score[said] < 2:
        return False  # too little to tell
    head = re.split(r"[:：]", prompt, maxsplit=1)[0]
    asked = {language(prompt)[0], language(head)[0], *(k for k, r in _NAMED.items() if re.search(r, prompt, re.I))} - {None}
    most = max((score[k] for k in asked), default=0)
    return bool(asked) and said not in asked and (not most or score[said] >= max(3, 1.5 * most))


def last_word(s: str) -> str:
    t = tokens(s)
    if not t:
        return ""
    if _CJK.match(t[-1]):
        return "".join(t[-2:])
    return "0" if t[-1].isdigit() else t[-1]


def _is_open(out: str) -> bool | None:
    """Whether something stays open; None: it ends without a mark, and the last word must tell."""
    s = out.strip()
    if s.startswith(("{", "[")) and not re.match(r"\[[ xX]?\]|\[\w+\]", s):
        try:
            json.loads(s)
            return False
        except ValueError:
            return True
    if s.count("```") % 2:
        return True
    if s.endswith("```") or _DONE.search(s):
        return False
    if _OPEN.search(s) or any(s.count(a) > s.count(b) for a, b in ("()", "[]", "{}", "«»")) or s.count("“") + s.count("„") > s.count("”") + s.count("“") * ("„" in s) or s.count('"') % 2:
        return True
    if re.fullmatch(r"[\d\s.,%]+", s) or s.endswith((">", "|", "”", '"', "»", "}", "]")):
        return False
    return None


def defect(prompt: str | None, out: str | None) -> str | None:
    """The type, or "?word" if it turns on the last word."""
    if _is_empty(out):
        return "empty"
    prompt = prompt or ""
    if _is_copied(prompt, out):
        return "copied"
    if _is_refusal(out):
        return "refusal"
    if _is_foreign(prompt, out):
        return "wrong_language"
    cut = _is_open(out)
    return "truncated" if cut else None if cut is False else "?" + last_word(out)


def word_ends(out: str | None) -> Counter:
    """How often each word stands inside, and at the end of, a clause; the unmarked end of the output does not count."""
    n: Counter = Counter()
    for m in re.finditer(r"([^.!?。！？,;:，；：\n)]+)([.!?。！？,;:，；：\n)]|\Z)", out or ""):
        t = ["0" if x.isdigit() else x for x in tokens(m.group(1))]
        if not t:
            continue
        words = [a + b if _CJK.match(b) and _CJK.match(a) else b for a, b in zip(["", *t], t)]
        for w in words[:-1]:
            n[w, False] += 1
        if m.group(2):
            n[words[-1], True] += 1
    return n


def defects(df: DataFrame, id_col: str, prompt_col: str, out_col: str) -> DataFrame:
    """(id, defect_type) of the defective items."""
    work = Scratch(df.sparkSession, "answers")
    rows = work.keep(df.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("p"), F.col(out_col).alias("o")).where("id is not null").dropDuplicates(["id"]))

    def judge(it):
        for pdf in it:
            yield pd.DataFrame({"id": pdf["id"], "d": [defect(p, o) for p, o in zip(pdf["p"], pdf["o"])]})

    def count(it):
        for pdf in it:
            n: Counter = Counter()
            for o in pdf["o"]:
                n.update(word_ends(o))
            if n:
                yield pd.DataFrame([(w, e, c) for (w, e), c in n.items()], columns=["w", "e", "c"])

    said = work.keep(rows.mapInPandas(judge, "id string, d string").where("d is not null"))
    ends = rows.select("o").mapInPandas(count, "w string, e boolean, c long").groupBy("w").agg(F.sum(F.when(F.col("e"), F.col("c")).otherwise(0)).alias("n_end"), F.sum("c").alias("n"))
    open_ = said.where("d like '?%'").select("id", F.expr("substring(d, 2)").alias("w"))
    cut = open_.join(ends, "w", "left").where(F.coalesce(F.col("n_end"), F.lit(0)) <= ENDS * F.coalesce(F.col("n"), F.lit(0))).select("id", F.lit("truncated").alias("d"))
    return said.where("d not like '?%'").unionByName(cut).select("id", F.col("d").alias("defect_type"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/generation_item.parquet")
    return defects(d.select("id", "prompt", F.col("generated.output").alias("output")), "id", "prompt", "output").distinct()
