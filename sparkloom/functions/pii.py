"""Personal data in text: ten kinds, found and masked one after another.

Patterns run per Arrow batch, for half of them turn on a check (Luhn, the id-card digit, address ranges) that a replacement cannot make. A text without any
character that could start a candidate leaves the function at once.
"""

from __future__ import annotations

import datetime
import ipaddress
import re

import pandas as pd
from pyspark.sql import Column, functions as F

# Pattern of the candidates of each kind, in the order of masking.
PATTERNS = {
    "url": re.compile(r"(?i)\bhttps?://[^\s<>'\"]+"),
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\w.+-])"),
    "phone": re.compile(r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)"),
    "landline": re.compile(r"(?<![\d:：])(?:\+?86[- ]?)?(?:0\d{2,3}[- ]?)?\d{7,8}(?!\d)"),
    "mac_address": re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}([:-]))(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![0-9A-Fa-f])"),
    "ip": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])"),
    "qq": re.compile(r"(?:QQ|qq|qq_id)\s*[:：]?\s*[1-9]\d{4,11}"),
    "wechat": re.compile(r"(?:wechat|wx|we_chat)\s*[:：]?\s*[A-Za-z][-_A-Za-z0-9]{5,19}", re.I),
    "id_card": re.compile(r"(?<!\d)(?:\d{15}|\d{17}[\dXx])(?!\d)"),
    "bank_card": re.compile(r"(?<!\d)(?:\d[ -]?){16,19}(?!\d)"),
}
TRAILING = ".,;，。；"
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_DIGITS = "10X98765432"
#: First two digits of the provinces' codes.
PROVINCES = frozenset("11 12 13 14 15 21 22 23 31 32 33 34 35 36 37 41 42 43 44 45 46 50 51 52 53 54 61 62 63 64 65 71 81 82 83".split())
#: A text without one of these holds no candidate.
_ANY = re.compile(r"\d{5}|@|://|[:.\-]|qq|wx|we_?chat", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_id_card(s: str) -> bool:
    if s[:2] not in PROVINCES:
        return False
    born = s[6:14] if len(s) == 18 else "19" + s[6:12]
    try:
        day = datetime.date(int(born[:4]), int(born[4:6]), int(born[6:]))
    except ValueError:
        return False
    if not datetime.date(1800, 1, 1) <= day <= datetime.date.today():
        return False
    return len(s) == 15 or ID_DIGITS[sum(int(c) * w for c, w in zip(s, ID_WEIGHTS)) % 11] == s[17].upper()


def _is_host(host: str) -> bool:
    labels = host.rstrip(".").split(".")
    return len(host) <= 253 and all(re.fullmatch(r"[^\W_](?:[\w-]{0,61}[^\W_])?", x) for x in labels)


def _valid(kind: str, s: str) -> bool:
    if kind == "url":
        m = re.match(r"(?i)https?://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:]+)(?::\d{1,5})?(?:[/?#]|$)", s)
        return bool(m) and (m[1].startswith("[") or m[1] == "localhost" or (_is_host(m[1]) and "." in m[1] and (not re.fullmatch(r"[\d.]+", m[1]) or _valid("ip", m[1]))))
    if kind == "email":
        local, _, host = s.rpartition("@")
        return len(local) <= 64 and not local.startswith(".") and not local.endswith(".") and ".." not in local and _is_host(host)
    if kind == "phone":
        return not re.sub(r"\D", "", s)[-11:].startswith(("140", "142", "143", "154", "161", "163", "164", "168"))
    if kind == "landline":
        bare = re.sub(r"\D", "", re.sub(r"^\+?86[- ]?(?=0|\d{7,8}$)", "", s))
        return bare.startswith("0") and 10 <= len(bare) <= 12 and bare[1] != "0"
    if kind == "ip":
        try:
            ipaddress.ip_address(s)
            return True
        except ValueError:
            return False
    if kind == "id_card":
        return is_id_card(s)
    if kind == "bank_card":
        bare = re.sub(r"[ -]", "", s)
        shaped = len(bare) in (15, 18) and not is_id_card(bare)
        return 16 <= len(bare) <= 19 and not shaped and luhn(bare)
    return True


def mask(text: str | None, kinds: tuple[str, ...] = tuple(PATTERNS)) -> tuple[str | None, list[str]]:
    """The text with every valid candidate replaced by the name of its kind, and the kinds that were found, in order."""
    if not text or not _ANY.search(text):
        return text, []
    found = []
    for kind in kinds:
        hits = dict.fromkeys(c for m in PATTERNS[kind].finditer(text) if (c := m.group().rstrip(TRAILING)) and _valid(kind, c))
        for c in hits:
            text = text.replace(c, f"[{kind.upper()}]")
        if hits:
            found.append(kind)
    return text, found


def masked(text: Column, kinds: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """struct(text, kinds)."""

    @F.pandas_udf("struct<text:string, kinds:array<string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        done = [mask(t, kinds) for t in s]
        return pd.DataFrame({"text": pd.Series([t for t, _ in done], dtype=object), "kinds": [k for _, k in done]})

    return run(text)
