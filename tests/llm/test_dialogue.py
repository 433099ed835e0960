"""Repair of conversations against a search over every sequence of edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quillmark.llm import dialogue, queries
from quillmark.llm.common import table
from tests.compare import assert_same, connection

LEGAL = re.compile("(s?(ua)+)?")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults(turns: list[tuple[str, str]]) -> list[str | None]:
    seen, out = set(), []
    for turn in turns:
        body = turn[1].rstrip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if turn in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add(turn)
    return out


def cheapest(turns: list[tuple[str, str]]) -> tuple[int, str, str]:
    """(cost, audit, repaired text): by costs from the least, every edit sequence of that cost that ends in a legal order."""
    marks = faults(turns)

    def after(state: str, role: str) -> str | None:
        now = state + role
        return now if re.fullmatch("(s?(ua)*u?)?", now) else None

    # (place, initials up to the pair that matters) -> least (cost, audit, text)
    states = {"": (0, "", ())}
    for k in range(len(turns) + 1):
        # inserts before turn k
        for _ in range(2):
            for state, (cost, audit, text) in list(states.items()):
                for role in ("user", "assistant"):
                    now = after(state, role[0])
                    if now is not None:
                        put(states, now, (cost + 2, audit + "I", (*text, f"{role}:")))
        if k == len(turns):
            break
        role, text_k = turns[k]
        new: dict = {}
        for state, (cost, audit, text) in states.items():
            put(new, state, (cost + 3, audit + "D", text))
            if marks[k] in ("blank", "duplicate"):
                continue
            more = int(marks[k] == "truncated")
            now = after(state, role[:1]) if role[:1] in ("s", "u", "a") else None
            if now is not None:
                put(new, now, (cost + more, audit + "K", (*text, f"{role}:{text_k}")))
            for other in ("user", "assistant"):
                now = after(state, other[0])
                if now is not None:
                    put(new, now, (cost + 2 + more, audit + "R", (*text, f"{other}:{text_k}")))
        # Only what may come next matters of the initials.
        states = {}
        for state, best in new.items():
            short = state if len(state) < 3 else state[:1] * (state[0] == "s") + ("uau" if state[-1] == "u" else "ua")
            put(states, short, best)
    cost, audit, text = min(v for s, v in states.items() if LEGAL.fullmatch(s))
    return cost, audit, "\n".join(text)


def put(states: dict, key: str, value: tuple) -> None:
    if key not in states or value < states[key]:
        states[key] = value


def slow(rows: list[tuple], ids: list) -> list[tuple]:
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv in {*ids, *by}:
        mine = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        numbers = [r[0] for r in mine if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        turns = [r[1:] for r in mine]
        marks = faults(turns)
        initials = [r[0][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, text = cheapest(turns)
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, sha(text)))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def odd_turns() -> list[tuple]:
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "ux", "o"]
    texts = ["A.", "B?", "cut", "", " \n", None, "Ünd!  ", "Same."]
    rows = [(conv, rng.choice([None, *range(6)]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randrange(99)}.") for conv in range(60) for _ in range(rng.randrange(1, 9))]
    return rows + [(None, 1, "user", "No id."), (None, 2, "assistant", "None."), (99, 0, None, None)]


@pytest.fixture(scope="module")
def conversations(spark):
    rows = [(*r, *[f"x{i}" for i in range(4)]) for r in odd_turns()]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, code string, place string, codes string, audit string")


def test_odd_turns_agree_with_search(conversations):
    assert found(dialogue.repairs(conversations)) == slow(odd_turns(), [])


def test_damaged_rows_and_conversations_that_lose_all(conversations):
    rows = odd_turns()
    assert found(dialogue.repairs(dialogue.damaged(conversations), conversations)) == slow(damage(rows), [r[0] for r in rows])


def test_query_agrees_with_search(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.QUERIES["op13_dialogue"](spark, sf)) == slow(damage(rows), [r[0] for r in rows])


@pytest.mark.parametrize(("segment", "repeats"), [(2, 200_000), (3, 0)])
def test_long_conversations_are_put_together_from_segments(spark, monkeypatch, segment, repeats):
    monkeypatch.setattr(dialogue, "SEGMENT", segment)
    monkeypatch.setattr(dialogue, "REPEATS", repeats)
    rng = random.Random(9)
    rows = [(7, i, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Yes.", "No", "", f"T{i}."])) for i in range(90)]
    rows += [(8, i, "user" if i % 2 == 0 else "assistant", f"T{i}.") for i in range(13)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(dialogue.repairs(df)) == slow(rows, [])


def test_repaired_turns_are_legal_and_hash_as_stated(conversations):
    turns = defaultdict(list)
    for r in sorted(dialogue.repaired(conversations).collect(), key=lambda r: (str(r[0]), r[1])):
        turns[r["conv_id"]].append((r["place"], r["role"], r["text"], r["edit"]))
    for r in dialogue.repairs(conversations).collect():
        mine = turns[r["conv_id"]]
        assert [t[0] for t in mine] == list(range(1, len(mine) + 1))
        assert LEGAL.fullmatch("".join(t[1][0] for t in mine))
        assert "".join(t[3] for t in mine) == r["audit"].replace("D", "")
        assert sha("\n".join(f"{t[1]}:{t[2]}" for t in mine)) == r["repaired_sha256"]


def test_ids_of_any_type_and_empty_table(spark):
    df = spark.createDataFrame([("b", 1, "user", "Hi."), ("a", 1, "assistant", "Hi.")], "conv_id string, turn int, role string, text string")
    assert [(r[0], r[6], r[7]) for r in found(dialogue.repairs(df))] == [("a", 2, "IK"), ("b", 2, "KI")]
    assert dialogue.repairs(df.limit(0)).count() == 0
    assert dialogue.repaired(df.limit(0)).count() == 0


def test_query_agrees_with_sql(spark, sf):
    assert assert_same(queries.QUERIES["op13_dialogue"](spark, sf), connection(sf), queries.ORACLE_SQL["op13_dialogue"]) > 0
