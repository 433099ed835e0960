from __future__ import annotations

import random

import pytest

WORDS = {
    "en": "the of and to in that was his with for as had on at by which from they were".split(),
    "de": "der die und das nicht ein von mit sich auf dem eine auch werden über für schön".split(),
}

#: Names that operators use inside, as extra columns of the input.
EXTRA = ["size", "target", "score", "row", "fp", "word", "key", "media", "seed", "draws", "root", "n_words", "held_out", "lang_pred", "spans", "_qm_k1", "_qm_k2", "_qm_b"]


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en", "a"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    rows = [(i, prose(rng, "en" if i % 2 else "de", 20 + 7 * i % 60), "en" if i % 2 else "de", f"s{i % 3}") for i in range(40)]
    rows += [(40, None, "en", "s1"), (41, "", "de", None), (42, " \n\t ", None, "s0"), (None, "a text without an id, mail a.b@c.example", "en", "s1")]
    rows += [rows[3], rows[3], (43, rows[5][1], "en", "s2"), (44, prose(rng, "en", 40_000), "en", "s2"), (45, "12345 67890 !!! ???", None, None)]
    return rows + [(46, "Zoë’s café — 東京 \U0001f600 naïve", "en", "")]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty, long and repeated texts, and columns whose names operators use."""
    rows = [(*r, len(r[1]) if r[1] is not None else None, *[f"x{i}" for i in range(len(EXTRA))]) for r in odd_rows()]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame(rows, kinds)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(30)] + [(None, 1, 0), (3, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
