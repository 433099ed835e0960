"""From sheets to the whole report."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quillmark.config import ScoringConfig
from quillmark.operators import scoring
from quillmark.plans.assessment import assess
from quillmark.sources import sheets, sinks


def test_pages_of_one_name_are_one_participant(spark, tmp_path):
    typed = [("a1", 1, "ani", "AB--"), ("b1", 2, "budi", "AAAA"), ("a2", 3, " ANI ", "-CCD"), ("c1", 4, "cici", "DDDD")]
    s = sheets.from_typed(spark.createDataFrame(typed, "sheet_id string, sheet_ord long, name string, text string"), 4, "ABCD")
    waiting = sheets.from_files(spark.createDataFrame([("w", 9, "w.png")], "sheet_id string, sheet_ord long, file_name string"), 4)
    s = s.unionByName(waiting)
    key = scoring.key_table(spark, list("ABCD"))
    c = ScoringConfig(num_questions=4, option_set="ABCD", merge_by_name=True)
    got = assess(s, key, c, str(tmp_path / "merged"))
    rows = {r.sheet_id: r for r in got.normed.collect()}
    assert set(rows) == {"a1", "b1", "c1"}
    assert (rows["a1"].correct, rows["a1"].conflict_count, [i.response for i in rows["a1"]["items"]]) == (4, 1, list("ABCD"))
    assert {r.sheet_id for r in got.members.where("participant_id = 'a1'").collect()} == {"a1", "a2"}
    apart = assess(s, key, replace(c, merge_by_name=False), str(tmp_path / "apart"))
    assert {r.sheet_id: r.correct for r in apart.scored.collect()} == {"a1": 2, "a2": 2, "b1": 1, "c1": 1}
    tables = got.report()
    assert tables["descriptive"].first().n == 3 and tables["passed"].first().passed == 1
    assert [r.sheet_id for r in tables["roster"].orderBy("row_no").collect()] == ["a1", "b1", "c1"]
    text = sinks.csv_text(got.normed, c)
    assert text.count("\r\n") == 3 and '"ABCD"' in text


def test_an_assessment_of_no_sheets(spark, tmp_path):
    s = sheets.from_typed(spark.createDataFrame([], "sheet_id string, sheet_ord long, name string, text string"), 2, "ABCD")
    for merge in (False, True):
        got = assess(s, scoring.key_table(spark, list("AB")), ScoringConfig(num_questions=2, option_set="ABCD", merge_by_name=merge), str(tmp_path / str(merge)))
        tables = got.report()
        assert got.normed.count() == 0 and tables["items"].count() == 0 and tables["classes"].count() == 0 and tables["descriptive"].first().n == 0
        assert got.reliability.first().kr20 is None and tables["method"].first().reliability_sentence.startswith("Koefisien")


def test_whole_flow_agrees_with_the_long_one(spark, sf, tmp_path):
    from quillmark.plans.fixtures import ITEMS, key_of, r_matrix
    from quillmark.plans.queries import graded

    c = ScoringConfig(num_questions=ITEMS)
    got = assess(sheets.from_responses(r_matrix(spark, sf), ITEMS), key_of(spark), c, str(tmp_path))
    cols = ["sheet_ord", "correct", "wrong", "blank", "raw_score"]
    assert sorted(map(tuple, got.scored.select(*cols).collect())) == sorted(map(tuple, graded(spark, sf).select(*cols).collect()))
    assert got.item_stats.where(F.col("n") > 0).count() == ITEMS
