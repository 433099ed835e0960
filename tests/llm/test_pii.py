from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d: str) -> bool:
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+- ()Z_9%é04", max_size=60))
def test_base_spans_are_those_of_the_plain_expressions(text):
    assert pii.base_spans(text) == plain(text)


def test_query_agrees_with_the_plain_expressions(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.op9_pii(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        found = plain(docs[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in found[k]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(found[k]) for k in pii.BASE_KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) or not listed
    assert sum(r.n_email for r in got) > 0


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("iban DE89 3704 0044 0532 0130 00 here", ["iban"]),
        ("DE89 3704 0044 0532 0130 01", []),
        ("card 4111 1111 1111 1111", ["card"]),
        ("4111 1111 1111 1112", []),
        ("api key 0123456789abcdef0123456789abcdef", ["secret"]),
        ("see 0123456789abcdef0123456789abcdef", []),
        ("", []),
    ],
)
def test_checksums_and_context(text, kinds):
    assert [s.kind for s in pii.find_spans(text)] == kinds


@pytest.mark.parametrize(
    ("text", "ibans"),
    [
        ("IBAN DE89370400440532013000 BIC COBADEFF", ["DE89370400440532013000"]),
        ("GB82 WEST 1234 5698 7654 32 2024", ["GB82 WEST 1234 5698 7654 32"]),
        ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]),
        ("AB12 DE89 3704 0044 0532 0130 00 OK", ["DE89 3704 0044 0532 0130 00"]),
        ("DE893704004405320130001", []),
        ("DE89370400440532013000x", []),
    ],
)
def test_ibans_among_other_words(text, ibans):
    assert [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "iban"] == ibans
    assert not any(i in pii.redact(text) for i in ibans)


def test_many_starts_of_ibans_take_linear_time():
    pii.find_spans("AB12 " * 60_000)


def test_context_raises_the_score():
    near, far = pii.find_spans("phone: +49 30 1234567")[0], pii.find_spans("thing: +49 30 1234567")[0]
    assert near.score > far.score


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a.b" * 100_000 + "@", "+1 " * 100_000, "@" * 300_000):
        pii.find_spans(text)


def test_redaction_and_odd_rows(odd, nothing):
    out = pii.redacted(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert len(rows) == odd.count()
    assert [r.text for r in rows if r.doc_id is None] == ["a text without an id, mail <EMAIL>"]
    assert [r.text for r in rows if r.doc_id == 40] == [None] and [r.n_chars for r in rows if r.doc_id == 40] == [None]
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert pii.redacted(nothing).count() == 0
    found = pii.spans(odd).collect()
    assert len(found) == len(rows) and pii.spans(nothing).count() == 0
