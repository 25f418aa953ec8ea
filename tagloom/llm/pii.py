"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digits after a boundary, URL schemes and
cue words. At each anchor a small parser that only looks around it finds the boundaries of an email, IP
address, card, phone, URL or account number and validates it. Each kind keeps the end of its last match,
so matches are leftmost and do not overlap, and no anchor is parsed twice.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm.common import batch, map_arrow, texts

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "account")
KINDS = BASE_KINDS + ADDED_KINDS

# Anchors that start an added kind.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("account", "acct", "iban", "passport", "ssn", "customer id", "tax id")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+")
# Possessive parts: what they take is never given back, which could not help a later part, so a scan is linear.
_NUMBER = re.compile(r"\s*+(?:number|no|nr|id)?+\.?+\s*+[:#=]?+\s*+([A-Za-z]{0,4}[0-9][A-Za-z0-9-]{4,33})")
_DIGITS = "0123456789"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, what in [("@", "@"), ("+", "+"), *((d, "0") for d in _DIGITS), *((s, "url") for s in SCHEMES), *((c, "cue") for c in CUES)]:
        found.add_word(word, (what, len(word)))
    found.make_automaton()
    return found


def _email(text: str, at: int, floor: int):
    """Left over the local part, right over the domain."""
    start = at
    while start > floor and text[start - 1] in _LOCAL_CHARS:
        start -= 1
    if start == at or not (m := _DOMAIN.match(text, at)):
        return None
    return start, m.end(), True


def _ip(text: str, at: int, floor: int):
    m = _IP.match(text, at)
    return m and (at, m.end(), all(_small(p) for p in m.groups()))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _card(text: str, at: int, floor: int):
    m = _CARD.match(text, at)
    if not m:
        return None
    digits = m.group().replace(" ", "").replace("-", "")
    return at, m.end(), 12 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, floor: int):
    m = _PHONE.match(text, at)
    return m and (at, m.end(), 9 <= sum(c in _DIGITS for c in m.group()) <= 15)


def _url(text: str, at: int, floor: int):
    m = _URL.match(text, at)
    end = m.end()
    while end > at and text[end - 1] in ".,;:!?)'":
        end -= 1
    return at, end, end - at > 10


def _account(text: str, cue_end: int, floor: int):
    m = _NUMBER.match(text, cue_end)
    return m and (m.start(1), m.end(1), sum(c in _DIGITS for c in m.group(1)) >= 5)


def find_spans(text: str, automaton) -> list[tuple[int, int, int]]:
    """All valid spans as (start, number of the kind, end), in that order."""
    spans, free, low = [], [0] * len(KINDS), _ascii_lower(text)

    def take(kind: int, parse, at: int) -> None:
        # A kind's next match starts at or after the end of its last one, valid or not.
        if at >= free[kind] and (found := parse(text, at, free[kind])):
            start, end, valid = found
            free[kind] = end
            if valid:
                spans.append((start, kind, end))

    for last, (what, length) in automaton.iter(low):
        at = last - length + 1
        if what == "0":
            before = text[at - 1] if at else ""
            if before not in _DIGITS or not before or at == free[1]:
                take(1, _ip, at)
            if at >= free[2]:
                take(2, _card, at)
        elif what == "@":
            take(0, _email, at)
        elif what == "+":
            take(3, _phone, at)
        elif what == "url":
            take(4, _url, at)
        else:
            take(5, _account, last + 1)
    return sorted(spans)


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _ascii_lower(text: str) -> str:
    """A-Z lower-cased, so that positions stay."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_url long, n_account long, "
    "base_sha256 string, spans string"
)


def _scanner():
    automaton = _automaton()
    schema = pa.schema(
        [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]
    )

    def run(batches):
        for b in batches:
            found = [find_spans(t, automaton) for t in b.column(1).to_pylist()]
            base = [[x for x in spans if x[1] < len(BASE_KINDS)] for spans in found]
            yield batch(
                schema,
                doc_id=b.column(0),
                base_sha256=[hashlib.sha256(_written(x).encode()).hexdigest() for x in base],
                spans=[_written(x) for x in found],
                **{f"n_{kind}": [sum(x[1] == k for x in spans) for spans in found] for k, kind in enumerate(KINDS)},
            )

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: counts by kind, the hash of the base spans, and all spans.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then by the order of
    ``KINDS``. The base kinds are email, ip, card and phone; url and account are added.
    Null or empty texts have no spans; repeated rows each give a row; an empty table gives
    none; other columns are not read. Nothing is shuffled.
    """
    return map_arrow(texts(docs, id_col, text_col), _scanner, SCHEMA)


def redact(text: str, spans: str) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans fall together."""
    out, last = [], 0
    for part in filter(None, spans.split(",")):
        kind, start, end = part.split(":")
        if int(start) >= last:
            out += [text[last : int(start)], f"[{kind}]"]
        last = max(last, int(end))
    return "".join([*out, text[last:]])
