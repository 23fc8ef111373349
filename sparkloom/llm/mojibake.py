"""Text that was decoded with the wrong character encoding: found, and restored where the bytes survive.

Method: map the characters back to the bytes of a legacy encoding, run a byte-structure automaton over these bytes to find the maximal
well-formed multibyte spans, and decode those spans only; the rest of the text is not touched. The automaton is the table of well-formed
UTF-8 sequences (and, for GBK read as Latin-1, of GBK pairs). What a span decodes to must be characters that prose can hold; garbled
spans are decoded again until nothing more decodes. A replacement character stands for lost bytes: its document is reported as not restorable.

Single-byte text read with another single-byte table has no multibyte structure. There the corpus decides: in how many places each
character triple with a character beyond ASCII stands is counted over all documents. A word is suspected if it holds a triple that hardly ever occurs, and read
again with another table only if every triple it then holds is well attested. The pair of tables that explains most of a document is taken, and
only if the odds it gains are above ``GAIN``. So a Greek letter in a formula or an Icelandic name is left alone: no other reading of it is attested.

A span that stands alone, in quotes or code marks or after a word that speaks of signs and markers, is quoted as an example and is no case.

Two passes over the documents in Arrow batches; only the counts of triples are shuffled. Null and blank texts are no case. Restored text is the
text itself where nothing could be restored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Legacy tables through which UTF-8 is read by mistake.
CODECS = ("cp1252", "latin-1", "iso8859-15", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "mac_roman", "iso8859-2", "cp1254", "cp1257", "cp852")
#: Tables in which ordinary Russian words can look like UTF-8: a whole run of at least three characters has to decode.
CYRILLIC_CODECS = ("koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
#: What directly precedes a sign that is spoken of (fixed values).
MENTION = re.compile(r"(?:\b(?:lists?|shows?|displays?|contains?|search(?:es)? for|looks? for|finds?|markers?|sequences?|characters?|symbols?|such as|zeichen|zeichenfolge|caract[eè]res?|s[eé]quences?|secuencias?)|символы?|знаки?|字符)\s*[`'\"“”‘’«»]?$", re.I)
QUOTES = "`'\"“”‘’«»„‚‹›[]()"

_UTF8 = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
_UTF8_WIDE = re.compile("(?:[\xe1-\xec\xee\xef][\x80-\xbf]{2})+")
_GBK = re.compile("(?:[\x81-\xfe][\x40-\x7e\x80-\xfe])+")
_PROSE = re.compile("[\xa0-ſ‐-⁄€™№℃′″←-⇿─-╿一-鿿　-〿＀-￯А-яЁё]+")
_AGAIN = re.compile("[\x80-\x9fˆ˜ƒ†‡‰Š-žŒœ]")
_CJK = re.compile("[一-鿿　-〿！-｠ -⁄]+")
_LATIN_WORD = re.compile("[A-Za-zÀ-ɏ]")
_BOX = re.compile("[─-╿▀-▟]+")
_SCAN = re.compile("[^\x00-\x7f]{2,}|[Ͱ-ӿ一-鿿�\x80-\x9f√¬]")
_WIDE = re.compile("[⺀-鿿豈-﫿＀-￯‐-⁄]+")
_HIGH = re.compile("[\xa1-\xff]{4,}")


@cache
def _to_byte(codec: str) -> dict[int, str]:
    """Character to byte, the byte written as a Latin-1 character; bytes without a character stand for themselves."""
    t: dict[int, str] = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        t.setdefault(ord(c), chr(b))
    return t


class _Bytes(dict):
    def __missing__(self, cp: int) -> str:
        return "\x00"


@cache
def _map(codec: str) -> _Bytes:
    return _Bytes(_to_byte(codec))


def _decoded(raw: str, codec: str = "utf-8") -> str | None:
    try:
        return raw.encode("latin-1").decode(codec)
    except UnicodeDecodeError:
        return None


def _sound(text: str) -> bool:
    """All of it is what prose can hold, or is garbled once more."""
    return bool(_PROSE.fullmatch(text)) or bool(_AGAIN.search(text) and _PROSE.fullmatch(_AGAIN.sub("é", text)))


@lru_cache(maxsize=200_000)
def _spans(run: str, lone: bool = False) -> tuple[tuple[int, int, str], ...]:
    """The UTF-8 spans of a run under the table that explains most of it: (start, end, text)."""
    best: tuple[tuple[int, int], tuple] = ((0, 0), ())
    for codec in CODECS:
        raw = run.translate(_map(codec))
        found = []
        for m in _UTF8.finditer(raw):
            text = _decoded(m.group())
            if text is not None and _sound(text) and (lone or not (len(text) == 1 and "А" <= text <= "я")):
                found.append((m.start(), m.end(), text))
        # ties: the table that gives fewer capitals, for most letters are small
        covered = (sum(b - a for a, b, _ in found), -sum(c.isupper() for _, _, t in found for c in t))
        if found and covered > best[0]:
            best = (covered, tuple(found))
    if not best[1] and len(run) >= 6:
        for codec in CYRILLIC_CODECS:
            m = _UTF8.fullmatch(run.translate(_map(codec)))
            text = m and _decoded(m.group())
            if text and len(text) >= 3 and _PROSE.fullmatch(text):
                return ((0, len(run), text),)
    return best[1]


@lru_cache(maxsize=50_000)
def _gbk_spans(run: str) -> tuple[tuple[int, int, str], ...]:
    """UTF-8 read as GBK: spans of the run whose GBK bytes are wide UTF-8 characters."""
    try:
        raw = run.encode("gb18030").decode("latin-1")
    except UnicodeEncodeError:
        return ()
    out = []
    for m in _UTF8_WIDE.finditer(raw):
        text = _decoded(m.group())
        if text and _CJK.fullmatch(text) and (len(text) >= 2 or "‐" <= text <= "⁄"):
            out.append((m.start(), m.end(), text))
    return tuple(out)


@lru_cache(maxsize=50_000)
def _gbk_whole(piece: str) -> tuple[tuple[int, int, str], ...]:
    """One span of the piece, in characters, from the first to the last garbled one."""
    spans = _gbk_spans(piece)
    if not spans:
        return ()
    ends, pos = [], 0
    for c in piece:
        pos += len(c.encode("gb18030", "replace"))
        ends.append(pos)
    ka = next(k for k, e in enumerate(ends) if e > spans[0][0])
    kb = next(k for k, e in enumerate(ends) if e >= spans[-1][1]) + 1
    return ((ka, kb, piece[ka:kb].encode("gb18030", "replace").decode("utf-8", "replace")),)


@cache
def _letters(src: str, dst: str) -> dict[int, str]:
    return {cp: d for cp, b in _to_byte(src).items() if (d := _decoded(b, dst)) and d.isprintable()}


def _example(text: str, a: int, b: int) -> bool:
    """The span stands alone and is quoted or spoken of."""
    if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    if a and b < len(text) and text[a - 1] in QUOTES and text[b] in QUOTES:
        return True
    return bool(MENTION.search(text[text.rfind("\n", 0, a) + 1 : a]))


def _once(text: str, lone: bool = False) -> tuple[list[tuple[int, int, str]], bool]:
    """Spans to replace, and whether bytes are lost; examples are left out. lone: one Cyrillic letter counts too, as it does in a text that is garbled elsewhere."""
    out: list[tuple[int, int, str]] = []
    lost = False
    end = -1
    for m in _SCAN.finditer(text):
        a, b, run = m.start(), m.end(), m.group()
        if a < end:
            continue
        if "�" in run and not _example(text, a, b):
            lost = True
        found: list[tuple[int, int, str]] = []
        first = run[0]
        wide = "一" <= first <= "鿿"
        if len(run) > 1 and not (wide and _WIDE.fullmatch(run)):
            found = [(a + s, a + e, t) for s, e, t in _spans(run, lone)]
            if found and sum(e - s for s, e, _ in found) < 0.6 * len(run) and len(run) >= 4 and _HIGH.fullmatch(run):
                found = []
            if found and _BOX.fullmatch(text, found[0][0], found[-1][1]):
                near = text[a - 1 : a] + text[b : b + 1]
                found = found if any(c.isalpha() for c in near) and b - a == 2 * len(found[0][2]) else []
        if not found and any("一" <= c <= "鿿" for c in run):
            for piece in re.finditer("[^�]+", run):
                found += [(a + piece.start() + s, a + piece.start() + e, t) for s, e, t in _gbk_whole(piece.group())]
            if found:
                lost = lost or "�" in run
            elif len(run) == 1 and (_LATIN_WORD.match(text[a - 1 : a]) or _LATIN_WORD.match(text[b : b + 1])):
                t = None
                try:
                    t = run.encode("gbk").decode("utf-8")
                except UnicodeError:
                    pass
                if t and "À" <= t <= "ſ":
                    found = [(a, b, t)]
        if not found and len(run) >= 4:
            for h in _HIGH.finditer(run):
                raw = h.group()
                t = _decoded(raw, "gbk") if _GBK.fullmatch(raw) else None
                # the first level of GB 2312 leads with B0 to D7; small Cyrillic letters lie above
                if not (t and _CJK.fullmatch(t) and 2 * sum("\xa1" <= c <= "\xd7" for c in raw[::2]) >= len(raw) * 0.7):
                    continue
                found.append((a + h.start(), a + h.end(), t))
        if not found and len(run) == 1 and "\x80" <= run <= "\x9f":
            t = run.encode("latin-1").decode("cp1252", "ignore")
            found = [(a, b, t or run)]
            lost = lost or not t
        if found and not (len(found) == 1 and _example(text, found[0][0], found[0][1])):
            out += found
            end = found[-1][1]
    return out, lost


#: Tables that single-byte text is written in, and those it may have been read with instead (fixed values).
WRITTEN = ("cp1252", "cp1251", "koi8-r", "cp1250")
READ = ("cp1252", "latin-1", "cp1250", "iso8859-2", "iso8859-15", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac_cyrillic", "cp1253", "cp437", "cp850", "mac_roman", "cp1254", "cp1257")
#: Places a document up to which a triple is hardly ever seen, and from which it is well attested; least odds (natural logarithm) for a document.
RARE, ATTESTED, GAIN = 0.0005, 0.0008, 6.0
_NOT_ASCII = "[^\\x00-\\x7f]"
#: Words that a task counts before it hands on their triples.
WORDS = 200_000

_MARKED = re.compile(r"[!-~]*[^\s\x00-\x7f]\S*")
#: Alphabets written in single bytes, their punctuation and the signs of their tables.
_ALPHABETIC = re.compile("[\x21-ԯ‐-›€™•∀-⋿⌐-⌡─-◿ﬁﬂ]+")


def triples(word: str) -> list[str]:
    """Triples of a word between spaces that hold a character beyond ASCII."""
    out = []
    for part in _ALPHABETIC.findall(word):
        p = f" {part} "
        out += [g for k in range(len(p) - 2) if not (g := p[k : k + 3]).isascii()]
    return out


def _lettered(g: str) -> bool:
    return any(c.isalpha() for c in g)


class Attested:
    """How often triples stand in the corpus: only those seen more often than RARE, so at most (triples a document) / RARE of them."""

    def __init__(self, seen: dict[str, int], documents: int):
        self.seen = seen
        self.rare, self.least = max(1.5, RARE * documents), max(3.0, ATTESTED * documents)
        self.pairs = [(r, w, {cp: c for cp, c in _letters(r, w).items() if c != chr(cp)}) for w in WRITTEN for r in READ if r != w]
        self.columns: dict[str, str] = {}
        self.known: dict[str, list[tuple[int, str, float]]] = {}
        self.fine: set[str] = set()

    def readings(self, word: str) -> list[tuple[int, str, float]]:
        """(pair of tables, word read again, odds gained) of a word that needs it."""
        if word not in self.known:
            if len(self.known) + len(self.fine) > WORDS:
                self.known.clear()
                self.fine.clear()
            self.known[word] = self._readings(word)
            if not self.known[word]:
                self.fine.add(word)
        return self.known[word]

    def _readings(self, word: str) -> list[tuple[int, str, float]]:
        if not _ALPHABETIC.fullmatch(word) or all(self.seen.get(g, 0) > self.rare for g in triples(word) if _lettered(g)):
            return []
        chars = sorted({c for c in word if not c.isascii()})
        for c in chars:
            if c not in self.columns:
                self.columns[c] = "".join(table.get(ord(c), c) for _, _, table in self.pairs)
        gains: dict[tuple, tuple[str, float]] = {}  # many pairs of tables read a word alike
        out = []
        for k, read in enumerate(zip(*(self.columns[c] for c in chars))):
            if read not in gains:
                again = word.translate(dict(zip(map(ord, chars), read)))
                gains[read] = again, self._gain(word, again) if again != word else 0.0
            again, gain = gains[read]
            if gain > 0:
                out.append((k, again, gain))
        return out

    def _gain(self, word: str, again: str) -> float:
        a, b, gain = f" {word} ", f" {again} ", 0.0
        lettered = any(x != y and y.isalpha() for x, y in zip(a, b))  # a letter that turns into a sign tells nothing
        for k in range(len(a) - 2):
            p, q = a[k : k + 3], b[k : k + 3]
            if p != q and _lettered(q):
                n = self.seen.get(q, 0)
                if q.isascii():
                    n = self.least
                elif n < self.least:
                    return 0.0
                gain += math.log((n + 0.5) / (self.seen.get(p, 0) + 0.5))
        return gain if lettered else 0.0

    def restore(self, text: str) -> tuple[int, str]:
        """Words read again, and the text with them."""
        odds: dict[int, float] = {}
        for word in set(_MARKED.findall(text)) - self.fine:
            for k, _, g in self.readings(word):
                odds[k] = odds.get(k, 0.0) + g
        if not odds or max(odds.values()) < GAIN:
            return 0, text
        best = max(odds, key=lambda k: (odds[k], -k))
        n = 0

        def again(m):
            nonlocal n
            for k, w, _ in self.readings(m.group()):
                if k == best and not _example(text, m.start(), m.end()):
                    n += 1
                    return w
            return m.group()

        now = _MARKED.sub(again, text)
        return n, now


def repair(text: str | None, attested: Attested | None = None) -> tuple[bool, str | None, int, bool]:
    """(found, text with every span decoded, spans, whether bytes are lost)."""
    if not text or text.isascii():
        return False, text, 0, False
    spans, lost = _once(text)
    n, now = len(spans), text
    while spans:  # garbled twice or more: every round leaves fewer characters or none to decode
        parts, at = [], 0
        for a, b, t in spans:
            parts += (now[at:a], t)
            at = b
        done = "".join((*parts, now[at:]))
        if len(done) >= len(now) and n > len(spans):
            break
        now = done
        spans, _ = _once(now, lone=True)
        n += len(spans)
    if attested is not None:
        k, now = attested.restore(now)
        n += k
    return bool(n or lost), now, n, lost


def triple_counts(rows: DataFrame) -> Attested:
    """Places of every triple over all documents (a word counts once a document)."""

    def run(batches):
        words: Counter = Counter()

        def hand_on():
            n: Counter = Counter()
            for w, k in words.items():
                for g in triples(w):
                    n[g] += k
            words.clear()
            if n:
                yield pd.DataFrame({"g": list(n), "n": list(n.values())})

        for pdf in batches:
            for t in pdf["text"]:
                words.update(set(_MARKED.findall(t)))
            if len(words) > WORDS:
                yield from hand_on()
        yield from hand_on()

    documents = rows.count()
    counts = rows.select("text").where(F.col("text").rlike(_NOT_ASCII)).mapInPandas(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return Attested({r["g"]: r["n"] for r in counts.where(F.col("n") > F.lit(max(1.5, RARE * documents))).collect()}, documents)




def restore(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """(id, restored, spans, lost) of the documents that hold a wrongly decoded passage; with ``full`` false only the id."""
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    attested = triple_counts(rows)

    def run(batches):
        for pdf in batches:
            done = [repair(t, attested) for t in pdf["text"]]
            keep = [d[0] for d in done]
            out = pdf.loc[keep, ["id"]]
            if full:
                hits = [d for d in done if d[0]]
                out = out.assign(restored=[d[1] for d in hits], spans=pd.array([d[2] for d in hits], dtype="int32"), lost=pd.array([d[3] for d in hits], dtype="bool"))
            if len(out):
                yield out

    schema = f"id {kind}" + ", restored string, spans int, lost boolean" * full
    return rows.where(F.col("text").rlike(_NOT_ASCII)).mapInPandas(run, schema)


def p9_found(spark, sf_dir: str) -> DataFrame:
    return restore(spark.read.parquet(f"{sf_dir}/documents.parquet"), full=False).select(F.col("id").alias("doc_id")).distinct()


def p9_restored(spark, sf_dir: str) -> DataFrame:
    return restore(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
