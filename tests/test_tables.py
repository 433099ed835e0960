"""Joint counts and their deltas, exact places, the threshold sweep and the name index, each against plain code."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillmark.config import OmrOptions, ScoringConfig
from quillmark.operators import decisions, items, ranking, reports, scoring, search
from quillmark.plans.assessment import assess, reassess
from quillmark.plans.queries import sliders


def sheets_of(spark, rng: random.Random, ids: range, n: int = 6):
    rows = [(str(i), i, None, [rng.choice(["A", "B", "C", "E", None]) for _ in range(n)], "done") for i in ids]
    return spark.createDataFrame(rows, "sheet_id string, sheet_ord long, name string, answers array<string>, status string")


@pytest.mark.parametrize("penalty", [False, True])
def test_deltas_give_what_a_full_recompute_gives(spark, tmp_path, penalty):
    rng = random.Random(3)
    c = ScoringConfig(num_questions=6, option_set="ABCD", penalty=penalty)
    key = scoring.key_table(spark, ["A", "B", None, "C", "E", "A"])
    base = sheets_of(spark, rng, range(60))
    last = assess(base, key, c, str(tmp_path / "a"))
    fresh = sheets_of(spark, rng, range(40, 75))
    changes = fresh.drop("status").withColumn("removed", F.col("sheet_ord") % 5 == 0)
    got = reassess(last, key, changes, str(tmp_path / "b"))
    now = base.join(changes.select("sheet_id"), "sheet_id", "left_anti").unionByName(fresh.where("sheet_ord % 5 <> 0"))
    want = assess(now, key, c, str(tmp_path / "c"))
    cell = lambda df: sorted(map(str, df.select(*items.CELL, "n").collect()))
    assert cell(got.counts) == cell(want.counts)
    rows = lambda df: sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())
    assert rows(got.item_stats) == rows(want.item_stats) and rows(got.reliability) == rows(want.reliability)
    assert rows(got.normed.select("sheet_id", "correct", "z_score")) == rows(want.normed.select("sheet_id", "correct", "z_score"))


def test_counts_of_a_change_read_the_change_only(spark, tmp_path):
    c = ScoringConfig(num_questions=6, option_set="ABCD")
    key = scoring.key_table(spark, list("ABCDAB"))
    last = assess(sheets_of(spark, random.Random(1), range(30)), key, c, str(tmp_path / "all"))
    few = last.scored.where("sheet_ord < 3")
    few.write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    plan = items.changed_counts(last.counts, few, few.limit(0), c)._jdf.queryExecution().optimizedPlan().toString()
    files = {f for df in (last.counts, few) for f in df.inputFiles()}
    assert set(items.changed_counts(last.counts, few, few.limit(0), c).inputFiles()) <= files, plan


def test_item_statistics_read_stored_tables_only(spark, tmp_path):
    c = ScoringConfig(num_questions=6)
    got = assess(sheets_of(spark, random.Random(2), range(30)), scoring.key_table(spark, list("ABCDEA")), c, str(tmp_path / "w"))
    assert all("/w/scored/" in f or "/w/counts/" in f for f in got.item_stats.inputFiles())


@pytest.mark.parametrize("n", [1, 2, 7, 200])
def test_extreme_groups_of_counts_agree_with_a_sort(spark, n):
    rng = random.Random(n)
    rows = [(i * 5000 % 99991, rng.choice([1.0, 2.0, 2.0, 3.5])) for i in range(n)]
    graded = spark.createDataFrame([(o, s, int(s)) for o, s in rows], "sheet_ord long, raw_score double, correct long")
    counts = items.response_counts(spark.createDataFrame([], "sheet_ord long, item_no int, response string"), graded, scoring.key_table(graded.sparkSession, ["A"]), ScoringConfig(num_questions=1))
    one = items.borders(counts)
    got = one.first()
    size = max(1, int(n * 0.27 + 0.5))
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert (got.n, got.group_size) == (n, size)
    tied = {(r.side, r.sheet_ord) for r in items.tied(graded, one).select("side", "sheet_ord").collect()}
    upper = {o for o, s in rows if s > got.upper_at} | {o for side, o in tied if side == "upper"}
    lower = {o for o, s in rows if s < got.lower_at} | {o for side, o in tied if side == "lower"}
    assert upper == {o for o, _ in order[:size]} and lower == {o for o, _ in order[-size:]}


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_places_of_any_key(spark, ranges):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("Ñ "), F.hex(F.xxhash64("id")))).alias("name"), (F.hash("id") % 40 / 7).alias("v"))
    df = df.withColumn("c", F.collate("name", "id")).withColumn("b", F.col("name").cast("binary"))
    for keys in ([("c", False), ("id", False)], [("v", True), ("id", True)], [("b", True), ("v", False), ("id", False)]):
        order = [F.col(c).desc_nulls_last() if falls else F.col(c).asc_nulls_first() for c, falls in keys]
        want = [r[0] for r in df.orderBy(*order).select("id").collect()]
        got = ranking.placed(df, keys, ranges=ranges).select("place", "id").collect()
        assert [r[1] for r in sorted(got)] == want and sorted(r[0] for r in got) == list(range(1, 3001))


def test_places_of_equal_rows_and_of_none(spark):
    df = spark.createDataFrame([(1,)] * 40 + [(None,)] * 3, "v int")
    assert sorted(r.place for r in ranking.placed(df, [("v", True)], ranges=4).collect()) == list(range(1, 44))
    assert ranking.placed(df.limit(0), [("v", True)]).columns == ["v", "place"] and ranking.placed(df.limit(0), [("v", True)]).count() == 0


def test_no_window_without_partition_holds_all_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "sheet_ord").withColumn("scaled_score", F.col("sheet_ord") * 1.0)
    page = reports.roster_at(df.withColumn("name", F.lit("x")), 2, 3)
    assert sorted((r.row_no, r.sheet_ord) for r in page.collect()) == [(4, 6), (5, 5), (6, 4)]
    with pytest.raises(ValueError, match="sort key"):
        reports.numbered_roster(df, key="other")


def test_sweep_agrees_with_decisions_at_every_pair(spark):
    rng = random.Random(4)
    rows = [(s, no, o, "ABCD"[o], rng.choice([0.0, 0.05, 0.1, 0.2, 0.3, 0.42, 0.6]) + rng.random() * 0.01) for s in range(20) for no in range(1, 6) for o in range(4)]
    net = spark.createDataFrame(rows, "sheet_ord long, no int, option_index int, option string, net double")
    key = spark.createDataFrame([(i, "ABCDA"[i - 1]) for i in range(1, 5)], "no int, key string")
    best = decisions.decisions(net, OmrOptions(), keep_option=True).join(key, "no", "left")
    fills, margins = sliders(5)
    got = {(r.fill_threshold, r.margin_threshold): (r.answered, r.ganda, r.kosong, r.right) for r in decisions.sweep(best, fills, margins).collect()}
    assert len(got) == 25
    for f in fills:
        for m in margins:
            d = decisions.decisions(net, replace(OmrOptions(), fill_threshold=f, margin_threshold=m)).join(key, "no", "left")
            one = d.agg(F.count("response"), F.count_if(F.col("flag") == "ganda"), F.count_if(F.col("flag") == "kosong"), F.count_if(F.coalesce(F.col("response") == F.col("key"), F.lit(False)))).first()
            assert got[f, m] == tuple(one), (f, m)
    assert {tuple(r)[2:] for r in decisions.sweep(best.limit(0), fills, margins).collect()} == {(0, 0, 0, 0)}


def test_index_finds_what_contains_finds(spark):
    names = ["Ana", "ana maria", "Banana", None, "", "Żółć", "a", "AB", "xyz abc", "ÀB%_"]
    queries = ["an", "ANA", " ana ", "", None, "z", "ółć", "abc", "%_", "nanan", "a b", "banana", "zz"]
    people = spark.createDataFrame(list(enumerate(names)), "sheet_ord long, name string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    got = sorted((r.query_id, r.sheet_ord) for r in search.found(search.index(people, "sheet_ord"), asked).collect())
    want = sorted((q.query_id, p.sheet_ord) for q in asked.collect() if q.query is not None for p in reports.searched(people, q.query).collect())
    assert got == want and len(want) > 20
    assert search.found(search.index(people.limit(0), "sheet_ord"), asked).count() == 0


def test_equal_searches_are_looked_up_once_and_meet_names_as_lists(spark, monkeypatch):
    monkeypatch.setattr(search, "LIST", 3)
    people = spark.createDataFrame([(i, f"Ani {i}") for i in range(40)], "sheet_ord long, name string")
    asked = spark.createDataFrame([(i, ("ni 1", " NI 1 ", "7", "", "zz")[i % 5]) for i in range(50)] + [(None, "7"), (60, None)], "query_id long, query string")
    found = search.found(search.index(people, "sheet_ord"), asked)
    got = sorted((-1 if r.query_id is None else r.query_id, r.sheet_ord, r.name) for r in found.collect())
    low = lambda q: q.strip().lower()
    want = sorted((-1 if q is None else q, p, n) for q, t in asked.collect() if t is not None for p, n in people.collect() if low(t) in n.lower())
    assert got == want


def test_searches_send_no_table_to_the_driver(spark):
    """Texts and lists used to be dealt over 64 parts and then broadcast, as the planner counted them once."""
    people = spark.createDataFrame([(i, f"Ani {i}") for i in range(300)], "sheet_ord long, name string")
    asked = spark.createDataFrame([(i, str(i % 70)) for i in range(900)], "query_id long, query string")
    found = search.found(search.index(people, "sheet_ord"), asked)
    assert found.count() == sum(str(i % 70) in str(p) for i in range(900) for p in range(300))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("part#" in x or "_qm_q#" in x)]
