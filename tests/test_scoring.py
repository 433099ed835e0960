"""Hand-computed cases of scoring, norms and item analysis."""

from __future__ import annotations

import math

import pytest

from quillmark.config import ScoringConfig
from quillmark.operators import items, norms, reports, scoring
from quillmark.operators.ranking import extreme_groups, numbered


def long(spark, answers: dict[int, str]):
    """Sheets as strings, a hyphen for a blank."""
    rows = [(o, i + 1, None if c == "-" else c) for o, text in answers.items() for i, c in enumerate(text)]
    return spark.createDataFrame(rows, "sheet_ord long, item_no int, response string")


def wide(spark, answers: dict[int, str]):
    rows = [(str(o), o, f"N{o}", "done", [None if c == "-" else c for c in text]) for o, text in answers.items()]
    return spark.createDataFrame(rows, "sheet_id string, sheet_ord long, name string, status string, answers array<string>")


def config(n: int, **more) -> ScoringConfig:
    return ScoringConfig(num_questions=n, **more)


@pytest.mark.parametrize(
    ("sheet", "key", "options", "raw", "scaled"),
    [("A" + "B" * 8 + "-", "A" * 10, "ABCDE", -1.0, 0.0), ("AAAABBB---", "A" * 10, "ABCD", 3.0, 30.0), ("AAAAAAAAAA", "A" * 10, "ABCDE", 10.0, 100.0)],
)
def test_correction_for_guessing(spark, sheet, key, options, raw, scaled):
    c = config(10, penalty=True, option_set=options)
    for row in (
        scoring.score_responses(long(spark, {1: sheet}), scoring.key_table(spark, list(key)), c).first(),
        scoring.score_sheets(wide(spark, {1: sheet}), scoring.key_table(spark, list(key)), c).first(),
    ):
        assert (row.raw_score, row.scaled_score) == (raw, pytest.approx(scaled))


def test_both_shapes_agree_and_statuses(spark):
    key = scoring.key_table(spark, ["A", "", "C", "D"])
    answers = {5: "ABC-", 6: "-BCD", 7: "EEEE"}
    a = {r.sheet_ord: r for r in scoring.score_responses(long(spark, answers), key, config(4)).collect()}
    b = {r.sheet_ord: r for r in scoring.score_sheets(wide(spark, answers), key, config(4)).collect()}
    for o in answers:
        assert (a[o].correct, a[o].wrong, a[o].blank, a[o].scored_items) == (b[o].correct, b[o].wrong, b[o].blank, b[o].scored_items)
    assert [i.status for i in b[5].items] == ["correct", "nokey", "correct", "blank"]
    assert [i.status for i in b[7].items] == ["wrong", "nokey", "wrong", "wrong"]


def test_no_key_and_sheets_that_are_not_done(spark):
    s = wide(spark, {1: "AB", 2: "AB"})
    none = scoring.score_sheets(s, scoring.key_table(spark, ["", ""]), config(2)).first()
    assert (none.scored_items, none.scaled_score, {i.status for i in none["items"]}) == (0, 0.0, {"nokey"})
    from pyspark.sql import functions as F

    waiting = s.withColumn("status", F.when(F.col("sheet_ord") == 1, "pending").otherwise("done"))
    assert [r.sheet_ord for r in scoring.score_sheets(waiting, scoring.key_table(spark, ["A", "B"]), config(2)).collect()] == [2]


def test_sparse_responses_and_items_outside_the_test(spark):
    df = spark.createDataFrame([(1, 1, "A"), (1, 9, "A")], "sheet_ord long, item_no int, response string")
    row = scoring.score_responses(df, scoring.key_table(spark, list("ABC") + [""] * 5 + ["A"]), config(3)).first()
    assert (row.correct, row.wrong, row.blank) == (1, 0, 2)
    assert {(r.item_no, r.response) for r in scoring.dense(df, 3).collect()} == {(1, "A"), (2, None), (3, None)}


def test_repeated_and_contradicting_responses(spark):
    from quillmark.sources import sheets

    df = spark.createDataFrame([(1, 1, "C"), (1, 1, "B"), (1, 1, "B"), (1, 2, None), (1, 2, "A"), (2, 1, None)], "sheet_ord long, item_no int, response string")
    assert {r.sheet_ord: r.answers for r in sheets.from_responses(df, 3).collect()} == {1: ["B", "A", None], 2: [None, None, None]}
    assert scoring.dense(df, 3).where("response is not null").count() == 2 and scoring.dense(df, 3).count() == 6


def test_empty_table(spark):
    empty = scoring.score_responses(long(spark, {1: "A"}).limit(0), scoring.key_table(spark, ["A"]), config(1))
    assert empty.count() == 0
    stats = norms.descriptive_stats(empty, "raw_score").first()
    assert stats.n == 0 and stats.mean is None and stats.sd is None and stats["median"] is None
    assert norms.with_norms(empty, config(1)).count() == 0
    assert items.item_statistics(long(spark, {1: "A"}).limit(0), empty, scoring.key_table(spark, ["A"]), config(1)).count() == 0


def test_one_sheet(spark):
    key = scoring.key_table(spark, list("AAA"))
    r = long(spark, {1: "AB-"})
    graded = scoring.score_responses(r, key, config(3))
    assert norms.descriptive_stats(graded, "raw_score").first().sd == 0.0
    row = norms.with_norms(graded, config(3)).first()
    assert (row.z_score, row.t_score, row.deviation_iq, row.percentile, row.classification) == (None,) * 5
    stats = items.item_statistics(r, graded, key, config(3)).collect()
    assert {(s.discrimination, s.verdict, s.group_size) for s in stats} == {(0.0, "Revisi", 1)}
    k = items.kr20(items.item_statistics(r, graded, key, config(3))).first()
    assert (k.kr20, k.interpretation) == (None, "belum dapat diestimasi")


def test_equal_sheets_have_no_norms_and_no_correlation(spark):
    key = scoring.key_table(spark, list("AB"))
    r = long(spark, {i: "AA" for i in (1, 2, 3)})
    graded = scoring.score_responses(r, key, config(2))
    assert {x.z_score for x in norms.with_norms(graded, config(2)).collect()} == {None}
    assert {x.point_biserial for x in items.item_statistics(r, graded, key, config(2)).collect()} == {None}


def test_manual_norms(spark):
    graded = scoring.score_responses(long(spark, {1: "AAAA"}), scoring.key_table(spark, list("AAAA")), config(4))
    row = norms.with_norms(graded, config(4, norm_mode="manual", norm_mean=2, norm_sd=1)).first()
    assert (row.z_score, row.deviation_iq, row.t_score, row.classification) == (2.0, 130.0, 70.0, "Sangat Superior")
    assert norms.with_norms(graded, config(4, norm_mode="manual", norm_sd=0)).first().z_score is None


@pytest.mark.parametrize(("deviation", "label"), [(129.6, "Superior"), (130.0, "Sangat Superior"), (90.0, "Rata-rata"), (89.999, "Di Bawah Rata-rata"), (69.9, "Sangat Rendah"), (None, None)])
def test_class_edges(spark, deviation, label):
    from quillmark.functions.scalars import classify
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(deviation,)], "d double").select(classify(F.col("d"))).first()[0] == label


def test_percentile_clamp_and_centre(spark):
    from pyspark.sql import functions as F

    from quillmark.functions.scalars import clamp, normal_cdf

    df = spark.createDataFrame([(0.0,), (5.0,), (-5.0,), (1.0,), (None,)], "z double")
    got = [r[0] for r in df.select(clamp(normal_cdf(F.col("z")) * 100, 0.1, 99.9)).collect()]
    assert got[1:3] == [99.9, 0.1] and got[4] is None
    assert got[0] == pytest.approx(50.00000005, abs=1e-9) and got[3] == pytest.approx(100 * 0.5 * (1 + math.erf(1 / math.sqrt(2))), abs=1e-4)


def test_ties_across_the_boundary_follow_input_order(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(1, 9)], "sheet_ord long, raw_score double")
    g = extreme_groups(df).first()
    assert (g.n, g.group_size, g.upper_at, g.upper_cut, g.lower_at, g.lower_cut) == (8, 2, 5.0, 2, 5.0, 7)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_and_ranks_agree_with_sorting(spark, monkeypatch, seed):
    import random

    from quillmark.operators import ranking

    monkeypatch.setattr(ranking, "BUCKET", 3)
    rng = random.Random(seed)
    n = rng.choice([1, 2, 3, 7, 50, 150])
    rows = [(o, float(rng.randrange(4))) for o in rng.sample(range(1, 1000), n)]
    df = spark.createDataFrame(rows, "sheet_ord long, raw_score double")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    size = max(1, math.floor(n * 0.27 + 0.5))
    groups = extreme_groups(df)
    assert groups.count() == 1 and groups.first().group_size == size
    both = df.crossJoin(groups)
    assert {r.sheet_ord for r in both.where(ranking.in_upper()).collect()} == {o for o, _ in order[:size]}
    assert {r.sheet_ord for r in both.where(ranking.in_lower()).collect()} == {o for o, _ in order[-size:]}
    assert {r.sheet_ord: r.rk for r in numbered(df, "raw_score").collect()} == {o: i + 1 for i, (o, _) in enumerate(order)}
    assert {r.sheet_ord: r.rk for r in numbered(df).collect()} == {o: i + 1 for i, (o, _) in enumerate(sorted(rows))}


def test_ranks_put_missing_levels_last_or_first(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, 4.0)], "sheet_ord long, raw_score double")
    assert {r.sheet_ord: r.rk for r in numbered(df, "raw_score").collect()} == {3: 1, 2: 2, 1: 3}
    assert {r.sheet_ord: r.rk for r in numbered(df, "raw_score", descending=False).collect()} == {1: 1, 2: 2, 3: 3}


def test_golden_numbers(spark, sf):
    from quillmark.plans import queries as q

    k = q.QUERIES["kr20"](spark, "/root/testdata/sf0.01").first()
    assert k.kr20 == pytest.approx(0.701434, abs=1e-6) and k.interpretation == "memadai untuk keputusan kelompok"
    bins = [r["count"] for r in q.QUERIES["score_histogram"](spark, "/root/testdata/sf0.01").orderBy("bin").collect()]
    assert bins == [1, 9, 25, 27, 22, 14, 2, 0]
    stats = {r.item_no: r for r in q.statistics(spark, "/root/testdata/sf0.01").collect()}
    assert (stats[1].p, stats[7].discrimination) == (pytest.approx(0.33), pytest.approx(-0.370370, abs=1e-6))
    assert stats[29].point_biserial == pytest.approx(0.456457, abs=1e-6) and stats[30].verdict == "Tanpa kunci"


def test_distribution_sums_to_the_number_of_sheets_even_with_foreign_letters(spark):
    key = scoring.key_table(spark, list("AE"))
    r = long(spark, {1: "AE", 2: "EE", 3: "--", 4: "BA"})
    graded = scoring.score_responses(r, key, config(2, option_set="ABCD"))
    stats = items.item_statistics(r, graded, key, config(2, option_set="ABCD"))
    for row in items.distribution(stats, config(2, option_set="ABCD")).collect():
        assert sum(row.distribution.values()) == 4
    assert {row.item_no: row.n_other for row in stats.collect()} == {1: 1, 2: 2}
    assert graded.where("sheet_ord = 1").first().correct == 2


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(100.0,), (99.9,), (12.5,), (0.0,), (None,)], "scaled_score double")
    got = {r.bin: r["count"] for r in reports.score_histogram(df, config(4)).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 2}


def test_sample_norms_have_mean_zero_and_classes_follow_scores(spark, sf):
    from quillmark.plans.queries import normed

    rows = normed(spark, sf).collect()
    assert abs(sum(r.z_score for r in rows)) < 1e-9
    order = [label for _, label in __import__("quillmark.functions.scalars", fromlist=["CLASSES"]).CLASSES]
    ranks = [order.index(r.classification) for r in sorted(rows, key=lambda r: -r.z_score)]
    assert ranks == sorted(ranks)
