"""Personal data: expressions propose spans, checksums confirm them, context words move their scores."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and limits of the four base kinds, and IBAN lengths by country (ISO 13616).
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "imei")
KINDS = BASE_KINDS + ADDED_KINDS
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("address", "host", "server", "ip"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security"),
    "imei": ("imei", "device", "handset"),
}
#: What a span's kind alone is worth, and the least score of an added span; base spans stay at any score.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "imei": 0.3}
BOOST, LEAST, AROUND = 0.3, 0.5, 40

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
# A run of digits is tried once, from its start: from inside it the rest of the match would be the same.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NOT_DIGIT = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _octet(digits: str) -> bool:
    """Whether digits are a number of at most 255, however many zeros lead it."""
    rest = digits.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` found from each @, in time linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL_END.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, start)
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds, leftmost and non-overlapping within each; matches that fail a check are dropped, not retried."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DOTTED.search(text):
        for m in _IP.finditer(text):
            if all(_octet(p) for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].translate(_NOT_DIGIT)
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(m[0].translate(_NOT_DIGIT)) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _added(text: str) -> list[tuple[str, int, int]]:
    out = []
    if _IBAN_HEAD.search(text):
        for m in _IBAN.finditer(text):
            need, kept, end = IBAN_LENGTHS.get(m[0][:2], 0), [], m.start()
            for end in range(m.start(), m.end()):
                if text[end] != " ":
                    kept.append(text[end])
                if len(kept) == need:
                    break
            follows = text[end + 1 : end + 2]
            if need and len(kept) == need and not (follows.isascii() and follows.isalnum()) and mod97("".join(kept)):
                out.append(("iban", m.start(), end + 1))
    for m in _SSN.finditer(text) if "-" in text else ():
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            out.append(("ssn", m.start(), m.end()))
    for m in _DIGITS.finditer(text):
        if 15 <= m.end() - m.start() <= 29 and len(digits := m[0].translate(_NOT_DIGIT)) == 15 and luhn(digits):
            out.append(("imei", m.start(), m.end()))
    return out


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - AROUND) : start]} {text[end : end + AROUND]}".lower()
    return round(min(1.0, PRIOR[kind] + BOOST * any(w in near for w in CONTEXT[kind])), 3)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one whole text, by kind as in KINDS, then start; code points, end exclusive.

    Added spans (IBANs that pass mod 97, US social security numbers, device numbers that pass Luhn) need a score of LEAST,
    which the latter two reach only beside a context word, and must not overlap a base span. A null text is empty.
    """
    if not text:
        return []
    base = [(k, a, b, _score(k, text, a, b)) for k, a, b in base_spans(text)]
    starts, ends = _covered((a, b) for _, a, b, _ in base)
    for k, a, b in _added(text):
        before = bisect_left(starts, b)  # of the stretches that start before the span ends the last one ends last
        if (s := _score(k, text, a, b)) >= LEAST and not (before and ends[before - 1] > a):
            base.append((k, a, b, s))
    return sorted(base, key=lambda s: (KINDS.index(s[0]), s[1]))


def _covered(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, apart and in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def pii_spans(text: Column) -> Column:
    """The spans of a text column as an array of structs (kind, start, end, score)."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find_spans(t)] for t in texts], dtype=object)

    return F.pandas_udf(run, _SPANS)(text)


def span_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of ``docs`` (doc_id, text).

    Null and empty texts have no spans; null or repeated ids are passed on as they are; other columns are ignored.
    """
    found = docs.select(F.col("doc_id"), pii_spans(F.col("text")).alias("s"))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE_KINDS]
    base = F.filter("s", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("s")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, where there is one, is counted anew.

    Overlapping spans are replaced once, by the kind that starts first. Null texts stay null; all columns and rows stay.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else redacted(t) for t in texts], dtype=object)

    out = docs.withColumn("text", F.pandas_udf(run, "string")(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def redacted(text: str) -> str:
    spans = sorted((a, b, k) for k, a, b, _ in find_spans(text))
    if not spans:
        return text
    parts, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        parts += [text[at:start], f"[{kind.upper()}]"]
        at, k = end, k + 1
    return "".join(parts) + text[at:]
