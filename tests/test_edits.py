"""Logs of edits against a plain replay, edit by edit; versions of stored state."""

from __future__ import annotations

import random

import pytest

from quillmark.operators import edits, merging
from quillmark.sources.versions import Versions

SHEETS = "sheet_id string, sheet_ord long, name string, page_index int"
LOG = "seq long, kind string, target string, item_no int, value string"
RESPONSES = "sheet_id string, item_no int, response string"


def plain(sheets: list[tuple], responses: list[tuple], log: list[tuple]) -> tuple[dict, dict]:
    """({id: (name, page)}, {(id, item): response}) of sheets that stand for themselves."""
    who = {s[0]: [s[2], s[3]] for s in sheets}
    cells = {(s, i): r for s, i, r in responses}
    for _, kind, target, item, value in sorted(log, key=lambda e: e[0]):
        if kind == "clear_all":
            who, cells = {}, {}
        elif target is None:
            continue
        elif kind == "append":
            who[target] = [value, 0]
            cells = {k: v for k, v in cells.items() if k[0] != target}
        elif target not in who:
            continue
        elif kind == "remove":
            del who[target]
            cells = {k: v for k, v in cells.items() if k[0] != target}
        elif kind == "rename" and value and value.strip():
            who[target][0] = value.strip().upper()
        elif kind == "page" and value and value.lstrip("-").isdigit():
            who[target][1] = int(value)
        elif kind in ("set", "toggle", "clear") and item is not None:
            value = value or None
            now = cells.get((target, item))
            cells[target, item] = None if kind == "clear" or (kind == "toggle" and now == value) else value
    return {k: tuple(v) for k, v in who.items()}, cells


def state(sheets, responses) -> tuple[dict, dict]:
    rows = [tuple(r) for r in responses.select("sheet_id", "item_no", "response").collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return {r["sheet_id"]: (r["name"], r["page_index"]) for r in sheets.collect()}, {r[:2]: r[2] for r in rows}


def made(rng: random.Random, n: int) -> list[tuple]:
    out = []
    for seq in rng.sample(range(1, 10 * n), n):
        kind = rng.choices(["set", "toggle", "clear", "rename", "page", "remove", "append", "clear_all", None, "other"], [4, 12, 2, 2, 2, 1, 2, 0.05, 0.3, 0.3])[0]
        value = {"rename": rng.choice([" ana ", "", None, "Budi"]), "page": rng.choice(["2", "x", None]), "append": rng.choice(["NEW", None])}.get(kind, rng.choice(["A", "B", "C", None]))
        out.append((seq, kind, rng.choice(["s1", "s2", "s3", "s9", None]), rng.choice([1, 2, 3, None]), value))
    return out


@pytest.fixture(scope="module")
def base(spark):
    sheets = [(f"s{i}", i, f"n{i}", i % 2) for i in range(1, 5)]
    responses = [(f"s{i}", k, "ABC"[(i + k) % 3] if (i + k) % 4 else None) for i in range(1, 5) for k in (1, 2, 4)]
    return sheets, responses, spark.createDataFrame(sheets, SHEETS), spark.createDataFrame(responses, RESPONSES)


@pytest.mark.parametrize(("seed", "n", "fold"), [(1, 60, 4096), (2, 300, 2), (3, 300, 3)])
def test_log_agrees_with_edit_by_edit_and_with_any_snapshot(spark, base, monkeypatch, tmp_path, seed, n, fold):
    monkeypatch.setattr(edits, "FOLD", fold)
    sheets, responses, s, r = base
    log = made(random.Random(seed), n)
    df = spark.createDataFrame(log, LOG)
    want = plain(sheets, responses, log)
    assert state(*edits.replayed(s, r, df)) == want
    cut = sorted(e[0] for e in log)[n // 3]
    stored = Versions(spark, str(tmp_path / "state"))
    stored.write(dict(zip(("sheets", "responses"), edits.replayed(s, r, df.where(f"seq <= {cut}")), strict=True)))
    stored.write(dict(zip(("sheets", "responses"), edits.replayed(stored.read("sheets"), stored.read("responses"), df.where(f"seq > {cut}")), strict=True)))
    assert state(stored.read("sheets"), stored.read("responses")) == want


def test_one_cell_of_very_many_edits_folds_by_ranges(spark, base):
    _, _, s, r = base
    log = spark.range(20_000).selectExpr("id as seq", "case when id % 5000 = 7 then 'set' else 'toggle' end as kind", "'s1' as target", "1 as item_no", "substr('ABC', int(id * id % 3) + 1, 1) as value")
    rows = [tuple(x) for x in log.collect()]
    sheets, responses, *_ = base
    assert state(*edits.replayed(s, r, log)) == plain(sheets, responses, rows)


def test_merged_participants_hold_the_answer_on_their_own_sheet(spark):
    s = spark.createDataFrame([("a", 1, "X", 0), ("b", 2, " x ", 1), ("c", 3, "Y", 0)], SHEETS)
    r = spark.createDataFrame([("a", 1, None), ("b", 1, "B"), ("b", 2, "C"), ("c", 1, "A")], RESPONSES)
    log = spark.createDataFrame([(1, "toggle", "a", 1, "B"), (2, "set", "b", 2, "E"), (3, "set", "a", 2, "D"), (4, "rename", "a", None, "z"), (5, "remove", "c", None, None)], LOG)
    sheets, responses = edits.replayed(s, r, log, merge=True)
    assert state(sheets, responses) == ({"a": ("Z", 0), "b": ("Z", 1)}, {("a", 1): None, ("b", 1): None, ("a", 2): "D", ("b", 2): None})
    one = merging.edited(r, merging.memberships(s), "a", 2, "D").where("sheet_id = 'b' and item_no = 2").first()
    assert one.response is None


def test_empty_log_and_empty_state(spark, base):
    sheets, responses, s, r = base
    none = spark.createDataFrame([], LOG)
    assert state(*edits.replayed(s, r, none)) == plain(sheets, responses, [])
    log = spark.createDataFrame([(1, "append", "n", None, "N"), (2, "toggle", "n", 1, "A")], LOG)
    assert state(*edits.replayed(s.limit(0), r.limit(0), log)) == ({"n": ("N", 0)}, {("n", 1): "A"})


def test_versions_outlive_a_failed_write_and_refuse_a_stale_one(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.current() == 0
    assert v.write({"t": spark.range(3), "u": spark.range(2)}) == 1
    # The table is read, changed and written back.
    assert v.write({"t": v.read("t").selectExpr("id + 10 as id")}) == 2
    assert sorted(r[0] for r in v.read("t").collect()) == [10, 11, 12] and v.read("u").count() == 2
    with pytest.raises(Exception, match="boom"):
        v.write({"t": v.read("t").selectExpr("cast(raise_error('boom') as bigint) as id")})
    assert v.current() == 2 and v.read("t").count() == 3
    with pytest.raises(RuntimeError, match="valid"):
        v.write({"t": spark.range(1)}, expected=1)
    assert v.read("t", 1).count() == 3
    v.remove_before(5)
    assert v.read("t").count() == 3 and not (tmp_path / "v" / "v00000001").exists()


def test_what_a_replay_reads_several_times_may_be_stored(spark, base, tmp_path):
    sheets, responses, s, r = base
    log = made(random.Random(5), 80)
    kept = []

    def keep(df, name):
        kept.append(name)
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    assert state(*edits.replayed(s, r, spark.createDataFrame(log, LOG), keep=keep)) == plain(sheets, responses, log)
    assert kept == ["members", "alive", "edits", "new"]
