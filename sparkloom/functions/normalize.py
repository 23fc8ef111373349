"""Text forms: the key of exact deduplication, the key of evaluation, and the cleaning steps.

What Spark has no function for (NFKC, HTML entities) is done per Arrow batch; everything else is native.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

from sparkloom.functions.chars import CJK, SPACE, squeeze, strip


def _batch(one):
    """A function of a Column that applies ``one`` to the strings of a batch; made when it is called, for that needs a session."""

    def of(c: Column) -> Column:
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else one(t))

        return run(c)

    return of


nfkc = _batch(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t))
unescaped = _batch(lambda t: html.unescape(t) if "&" in t else t)
unescaped_nfkc = _batch(lambda t: unicodedata.normalize("NFKC", html.unescape(t)))


# The punctuation that the deduplication key leaves out.
DEDUP_MARKS = r"[，。！？；：“”‘’、,.!?;:\"'`~\-_=+*/\\|()\[\]{}<>\x{3000}]"


def dedup_key(text: Column) -> Column:
    s = unescaped_nfkc(F.coalesce(text, F.lit("")))
    s = F.regexp_replace(s, "<[^>]+>", " ")
    s = F.lower(F.regexp_replace(s, f"https?://[^{SPACE}]+", " "))
    return squeeze(F.regexp_replace(s, DEDUP_MARKS, " "))


def eval_key(text: Column) -> Column:
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def repair_unicode(text: Column) -> Column:
    """Without U+FFFD and control, format, private and unassigned characters; line feed and tab stay."""
    return F.regexp_replace(text, r"\x{FFFD}|[\p{C}&&[^\n\t]]", "")


def normalize_space(text: Column) -> Column:
    s = F.regexp_replace(nfkc(text), r"[ \t\r\f\x{0B}]+", " ")
    return strip(F.regexp_replace(s, "\n{3,}", "\n\n"))


def normalize_chinese(text: Column, join: bool = True) -> Column:
    s = F.regexp_replace(nfkc(text), r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", "")
    s = F.regexp_replace(s, "\r\n?", "\n")
    s = F.regexp_replace(s, r"[ \t\f\x{0B}]+", " ")
    s = F.regexp_replace(s, f"[{SPACE}]*([,，。.!！?？;；:：])[{SPACE}]*", "$1")
    s = strip(F.regexp_replace(s, "\n{3,}", "\n\n"))
    return F.regexp_replace(s, f"([{CJK}])[{SPACE}]+([{CJK}])", "$1$2") if join else s


def clean_html(text: Column) -> Column:
    s = unescaped(text)
    for pattern in (r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", "<[^>]+>", f"https?://[^{SPACE}]+|www\\.[^{SPACE}]+"):
        s = F.regexp_replace(s, pattern, " ")
    return squeeze(s)


# The steps of Markdown cleaning, in order.
MARKDOWN = (
    (r"```[a-zA-Z0-9_-]*\n?", ""),
    ("```", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (f"\\[([^\\]]+)\\]\\([{SPACE}]*", "$1"),
    (r"`([^`]+)`", "$1"),
    (f"(?md)^[{SPACE}]{{0,3}}#{{1,6}}[{SPACE}]*", ""),
    (f"(?md)^[{SPACE}]*[-*_]{{3,}}[{SPACE}]*$", " "),
    (f"(?md)^[{SPACE}]*>+[{SPACE}]?", ""),
    (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"),
)


def clean_markdown(text: Column) -> Column:
    s = text
    for pattern, to in MARKDOWN:
        s = F.regexp_replace(s, pattern, to)
    return squeeze(s)
