"""Personal data in texts, found by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes and
cues such as "iban" or "account".  From each anchor a small deterministic parser
expands to the borders of an email, address or account and validates what it found.

Base kinds (each leftmost and non-overlapping within its kind): ``email``, ``ip``,
``card``, ``phone``.  Added kinds: ``userinfo`` and ``ipv6`` behind a scheme, ``iban``
(check digits), ``ssn`` and ``account`` behind a cue.

A null or empty text has no spans.  Positions are code points, the end exclusive.
One row comes back per row given; other columns are not read by ``detect`` and are
left as they are by ``redact``.  Texts are read whole, one at a time, in linear time.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waybill.llm.common import documents, table
from waybill.llm.words import slices

Span = tuple[str, int, int]

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "userinfo", "ipv6", "iban", "ssn", "account")
CUES = {"iban": "iban", "ssn": "ssn", "account": "account", "acct": "account", "konto": "account"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*").match
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_AUTHORITY = re.compile(r"[^\s/?#\"'<>]*").match
_GAP = re.compile(r"[ \t]{0,2}(?:(?:number|no|nr)\b\.?)?[ \t:#=.]{0,4}", re.IGNORECASE).match
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}").match
_SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])").match
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])").match
_NOT_DIGIT = re.compile(r"[^0-9]+")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in ("@", "+", "://", *"0123456789"):
        found.add_word(sign, ("0" if sign.isdigit() else sign, len(sign)))
    for cue, kind in CUES.items():
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the digits pass the check of card numbers."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    compact = text.replace(" ", "")
    moved = compact[4:] + compact[:4]
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban_at(text: str, start: int) -> int:
    """End of the longest valid number from ``start``, or 0."""
    if not (m := _IBAN(text, start)):
        return 0
    for end in range(m.end(), start + 14, -1):
        if text[end - 1] != " " and not text[end : end + 1].isalnum() and _iban_ok(text[start:end]):
            return end
    return 0


def find_spans(text: str | None) -> list[Span]:
    """All spans, by kind in the order of ``KINDS``, then by start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    after_email = after_dotted = after_digits = 0
    for last, (sign, width) in _anchors().iter(text):
        if sign == "0":
            if last >= after_dotted:
                m = _DOTTED(text, last)
                after_dotted = m.end()
                parts, at = m.group().split("."), last
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = at + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                        found["ip"].append((at, end))
                    at = end + 1
            if last >= after_digits:
                m = _DIGITS(text, last)
                after_digits = m.end() if m else last + 1
                if m and 13 <= m.end() - m.start() <= 37:
                    digits = _NOT_DIGIT.sub("", m.group())
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif sign == "@":
            start = last
            while start > after_email and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN(text, last + 1)):
                found["email"].append((start, m.end()))
                after_email = m.end()
        elif sign == "+":
            if m := _PHONE(text, last):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found["phone"].append(m.span())
        elif sign == "://":
            m = _AUTHORITY(text, last + 1)
            user, at, host = m.group().rpartition("@")
            if at and user:
                found["userinfo"].append((m.start(), m.start() + len(user)))
            if host.startswith("[") and "]" in host:
                begin = m.end() - len(host) + 1
                end = begin + host.index("]") - 1
                try:
                    ipaddress.IPv6Address(text[begin:end])
                except ValueError:
                    continue
                found["ipv6"].append((begin, end))
        else:
            before = last - width
            if before >= 0 and text[before].isalnum() or text[last + 1 : last + 2].isalpha():
                continue  # inside a longer word
            start = _GAP(text, last + 1).end()
            if sign == "iban":
                if end := _iban_at(text, start):
                    found["iban"].append((start, end))
            elif sign == "ssn":
                m = _SSN(text, start)
                if m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                    found["ssn"].append(m.span())
            elif m := _ACCOUNT(text, start):
                found["account"].append(m.span())
    return [(kind, start, end) for kind in KINDS for start, end in found[kind]]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    out, done = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, -end)
    return "".join(out) + text[done:]


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, their digest and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: dict[str, list[int]] = {kind: [] for kind in BASE_KINDS}
            digests, listed = [], []
            for text in batch.column("text").to_pylist():
                spans = find_spans(text)
                base = [s for s in spans if s[0] in counts]
                for kind in BASE_KINDS:
                    counts[kind].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                listed.append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS),
                 pa.array(digests, pa.string()), pa.array(listed, pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    numbers = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return documents(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id long, {numbers}, base_sha256 string, spans string"
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced; all columns and their order stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            clean = [t if not (s := find_spans(t)) else redacted(t, s) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
