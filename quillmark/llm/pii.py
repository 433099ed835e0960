"""Personal data: regular expressions propose spans, checksums confirm, nearby words adjust a score.

Offsets count code points, ends are exclusive. A null text counts as empty in
``spans`` and stays null in ``redacted``; long texts are read whole, in linear
time; rows are independent, so repeated ones repeat their result and an empty
table gives an empty one; other columns stay as they are in ``redacted``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds to the base ones, in the order of their spans.
ADDED_KINDS = ("iban", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

# Possessive quantifiers give the matches of the plain ones here (no item that
# follows can start with a character of the run before it) in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32})(?![0-9A-Za-z])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

#: Characters of an IBAN by country.
_LENGTHS = """NO15 BE16 DK18 FI18 FK18 FO18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 MN20 XK20 CH21 HR21 LI21 LV21
BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24
TN24 VG24 LY25 PT25 ST25 IS26 TR26 DJ27 FR27 GR27 IT27 MC27 MR27 SM27 AL28 AZ28 BY28 CY28 DO28 GT28 HU28 LB28 NI28 PL28 SV28 BR29
EG29 PS29 QA29 UA29 JO30 KW30 MU30 YE30 MT31 SC31 LC32 RU33"""
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in _LENGTHS.split()}
#: Words near a span that make its kind likelier, by kind.
CONTEXT = {
    "email": ("email", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "secret": ("token", "secret", "key", "password", "api"),
}
#: Score of a span by its pattern and checksum alone.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "secret": 0.4}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
#: An added kind's span below this score is no span; base spans always stay.
LEAST_SCORE = 0.6


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start the stretch of 15 to 34 characters that ends with a word and passes mod-97.

    Of several the one of the country's length, else the longest; a start
    without any is passed over by itself.
    """
    m = _IBAN.search(text)
    while m:
        ends = [e for e in range(m.end(), m.start() + 14, -1) if text[e - 1] != " " and not (text[e : e + 1].isascii() and text[e : e + 1].isalnum())]
        stretches = [(e, text[m.start() : e].replace(" ", "")) for e in ends]
        stretches.sort(key=lambda x: len(x[1]) != IBAN_LENGTH.get(x[1][:2]))
        end = next((e for e, s in stretches if len(s) >= 15 and mod97(s)), None)
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or m.start() + 1)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches per base kind; a match that fails its check is dropped, not retried."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def _context(kind: str, text: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS // 2]}".lower()
    words = set(_WORD.findall(near))
    return min(1.0, PRIOR[kind] + CONTEXT_BONUS * any(w in words for w in CONTEXT[kind]))


def find_spans(text: str) -> list[Span]:
    """All spans, base ones first, each kind by its start."""
    found = base_spans(text)
    for kind in ADDED_KINDS:
        found[kind] = []
    if _DIGIT.search(text):
        found["iban"] = list(_ibans(text))
        found["secret"] = [m.span() for m in _SECRET.finditer(text)]
    out = []
    for kind in KINDS:
        for a, b in found[kind]:
            score = _context(kind, text, a, b)
            if kind in BASE_KINDS or score >= LEAST_SCORE:
                out.append(Span(kind, a, b, score))
    return out


def redact(text: str) -> str:
    """``text`` with each stretch of personal data replaced by <KIND> of its first span."""
    out, done = [], 0
    for s in sorted(find_spans(text), key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join(out) + text[done:] if out else text



_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _find(batches):
    for b in batches:
        found = [[s._asdict() for s in find_spans(x.decode("utf-8", "replace"))] for x in texts_of(b, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPANS)], names=["doc_id", "found"])


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end, score>>) per document, also those without a span."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary").alias("_qm_b")).mapInArrow(
        _find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:int,end:int,score:double>>"
    )


def _redact(batches):
    for b in batches:
        i = b.schema.get_field_index("text")
        new = [None if x is None else redact(x) for x in b.column(i).to_pylist()]
        yield b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced, and n_chars, if there, counted anew; null texts stay null."""
    small_batches(docs.sparkSession)
    out = docs.mapInArrow(_redact, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return out


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """n_* count the base spans; base_sha256 digests them; spans lists base and added ones, span_scores their scores."""
    found = spans(table(spark, sf_dir, "documents"))
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE_KINDS]
    scores = F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), scores.alias("span_scores"))
