"""Personal data in texts: patterns propose, checks confirm, context scores.

Each kind has a pattern that proposes spans, a validator that may drop them
(number range, Luhn, mod 97, digit count) and a base score. Words near a span
raise or lower its score. The four base kinds are reported whenever pattern and
validator agree; for the further kinds the score decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: words looked at lie within so many code points before or after a span
CONTEXT = 40
THRESHOLD = 0.5

BASE_KINDS = ("email", "ip", "card", "phone")


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an international account number passes its mod-97 check."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _is_address(span: str) -> bool:
    # compared as text, as a part may have more digits than a number can hold
    return all(len(p := part.lstrip("0")) < 3 or len(p) == 3 and p <= "255"
               for part in span.split("."))


def _is_card(span: str) -> bool:
    digits = _digits(span)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_phone(span: str) -> bool:
    return 10 <= len(_digits(span)) <= 15


def _is_account(span: str) -> bool:
    plain = span.replace(" ", "")
    return 15 <= len(plain) <= 34 and mod97(plain)


def _is_local_phone(span: str) -> bool:
    return 7 <= len(_digits(span)) <= 15


def _is_social(span: str) -> bool:
    area, group, serial = span.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


_MAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ in linear time."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _MAIL_LOCAL:
            start -= 1
        if start < at and (m := _MAIL_DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def _matches(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    found = re.compile(pattern)

    def spans(text: str) -> Iterator[tuple[int, int]]:
        return (m.span() for m in found.finditer(text))
    return spans


@dataclass(frozen=True)
class Kind:
    """How one kind of personal data is proposed, checked and scored."""

    name: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    valid: Callable[[str], bool]
    score: float
    near: tuple[str, ...] = ()
    unlike: tuple[str, ...] = ("version", "isbn", "order", "invoice", "serial")


# A match that starts inside a run of digits would be a later part of the match
# from the run's start, so the look-behinds change no result; they keep long
# runs of digits from being scanned again from each digit.
KINDS = (
    Kind("email", _emails, lambda s: True, 0.9, ("mail", "contact", "write")),
    Kind("ip", _matches(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}"), _is_address, 0.6,
         ("ip", "host", "server", "address")),
    Kind("card", _matches(r"[0-9](?:[\x20-]?[0-9])+"), _is_card, 0.7,
         ("card", "visa", "credit", "payment", "tarjeta", "carte", "karte")),
    Kind("phone", _matches(r"\+[0-9][\x20().0-9-]+[0-9]"), _is_phone, 0.7,
         ("phone", "tel", "call", "mobile", "fax", "telefon")),
    Kind("iban", _matches(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
         _is_account, 0.9, ("iban", "account", "bank", "konto", "cuenta", "compte")),
    Kind("local_phone", _matches(
        r"(?<![+0-9A-Za-z.-])(?:\([0-9]{2,5}\)[\x20-]?|[0-9]{2,5}[\x20/-])[0-9]{2,5}[\x20-]?[0-9]{2,5}"
        r"(?![0-9A-Za-z-]|\.[0-9])"), _is_local_phone, 0.2,
         ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono")),
    Kind("social_number", _matches(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
         _is_social, 0.4, ("ssn", "social", "security", "taxpayer")),
)

_WORD = re.compile(r"[^\W\d_]+")
_NEAR, _UNLIKE = 0.35, -0.3


def context_score(kind: Kind, text: str, start: int, end: int) -> float:
    """Base score, raised by a word that belongs to the kind, lowered by a foreign one."""
    around = text[max(0, start - CONTEXT):start] + " " + text[end:end + CONTEXT]
    words = {w.lower() for w in _WORD.findall(around)}
    score = kind.score
    score += _NEAR * any(w in words for w in kind.near)
    score += _UNLIKE * any(w in words for w in kind.unlike)
    return round(min(1.0, max(0.0, score)), 2)


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """Spans of one text as (kind, start, end, score), by start, then by kind.

    Base kinds stand as proposed and confirmed. A span of a further kind stays
    if its score reaches the threshold and no base span and no span of a better
    score overlaps it.
    """
    found = [(start, n, end, context_score(kind, text, start, end))
             for n, kind in enumerate(KINDS)
             for start, end in kind.propose(text) if kind.valid(text[start:end])]
    kept = [f for f in found if f[1] < len(BASE_KINDS)]
    for more in sorted((f for f in found if f[1] >= len(BASE_KINDS) and f[3] >= THRESHOLD),
                       key=lambda f: (-f[3], f[0], f[1])):
        if all(more[2] <= s or e <= more[0] for s, _, e, _ in kept):
            kept.append(more)
    return [(KINDS[n].name, s, e, score) for s, n, e, score in sorted(kept)]


_SPANS = "array<struct<kind: string, start: long, end: long, value: string, score: double>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text of ``docs``.

    Needs doc_id and text; other columns are ignored. Returns doc_id and spans,
    an array of (kind, start, end, value, score) in code points, end exclusive,
    ordered by start and then as the kinds are listed. A null or empty text has
    an empty array; every row, repeated or with a null doc_id, gives one row.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                   ("end", pa.int64()), ("value", pa.string()),
                                   ("score", pa.float64())]))
        for part in parts:
            rows = []
            for value in part.column(1):
                text = value.as_py() or ""
                rows.append([{"kind": k, "start": s, "end": e, "value": text[s:e], "score": x}
                             for k, s, e, x in spans_of(text)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(batches, f"doc_id long, spans {_SPANS}")


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets.

    Of overlapping spans the first stays as a bracket and covers the others.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = []
            for value in part.column(1):
                text = value.as_py()
                texts.append(text and _without(text))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(batches, "doc_id long, text string")


def _without(text: str) -> str:
    out, done = [], 0
    for kind, start, end, _ in spans_of(text):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])
