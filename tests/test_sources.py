"""Typed answers, names, files, settings, CSV and merging."""

from __future__ import annotations

import json
import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quillmark.config import Layout, OmrOptions, ScoringConfig, to_number
from quillmark.functions import scalars as S
from quillmark.functions.formatting import fixed, fmt
from quillmark.operators import geometry, merging, norms, reports, scoring
from quillmark.sources import sheets, sinks
from tests.test_scoring import wide


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("text", "n", "options", "expected"),
    [
        ("ab1-x?c", 6, "ABCDE", ["A", "B", None, None, "C", None]), ("", 2, "ABCDE", [None, None]), (None, 2, "ABCDE", [None, None]), ("a b,c", 2, "ABCDE", ["A", "B"]),
        ("e", 1, "ABCD", [None]), ("-----", 3, "ABCDE", [None] * 3),
    ],
)
def test_typed_answers(spark, text, n, options, expected):
    assert one(spark, text, lambda c: S.parse_answers(c, n, options)) == expected


#: Names and what they become.
FILE_NAMES = (
    ("laporan-tes-inteligensi-kolektif-2026-09-10.pdf", "laporan-tes-inteligensi-kolektif-2026-09-10.pdf"),
    ("rekap-tes-2026-09-10.csv", "rekap-tes-2026-09-10.csv"),
    ("template-ljk-tes_potensi.pdf", "template-ljk-tes_potensi.pdf"),
    ("laporan-x-../../../../sdcard/jahat.pdf", "jahat.pdf"),
    ("..\\..\\windows\\system32\\evil.pdf", "evil.pdf"),
    ("/etc/passwd", "passwd"),
    ("../../rahasia.csv", "rahasia.csv"),
    ("..", "berkas"),
    (".", "berkas"),
    ("", "berkas"),
    (None, "berkas"),
    ('laporan tes "psikologi" <2026>.pdf', "laporan-tes-psikologi-2026-.pdf"),
    ("rekap null.csv", "rekap-null.csv"),
    ("a" * 400 + ".pdf", "a" * 120),
)


@pytest.mark.parametrize(("name", "expected"), FILE_NAMES)
def test_file_names(spark, name, expected):
    assert one(spark, name, S.sanitize_filename) == expected


def test_any_file_name_is_one_safe_segment(spark):
    rng = random.Random(5)
    names = ["".join(rng.choices('abcXYZ019 ../\\:*?"<>|._- e', k=rng.randrange(0, 60))) for _ in range(400)]
    for r in spark.createDataFrame([(n,) for n in names], "v string").select(S.sanitize_filename(F.col("v")).alias("s")).collect():
        assert not set(r.s) & set("/\\") and r.s not in (".", "..") and 1 <= len(r.s) <= 120


def test_names_dates_and_slugs(spark):
    assert one(spark, "foto.kelas.A.jpg", S.sheet_name) == "FOTO.KELAS.A"
    assert one(spark, "  Tes IQ (2026)!  ", S.slugify) == "tes-iq-2026" and one(spark, None, S.slugify) == one(spark, "", S.slugify) == "laporan" and one(spark, "é", S.slugify) == ""
    assert one(spark, "2026-09-10", S.long_date) == "10 September 2026" and one(spark, "2026-01-02", S.long_date) == "2 Januari 2026"
    assert one(spark, "soon", S.long_date) == "soon" and one(spark, None, S.long_date) == "—"
    assert one(spark, " \t ", S.normalised_name) is None
    assert one(spark, "data:image/png;base64,QUJD", S.base64_of_data_url) == "QUJD" and one(spark, "x", S.base64_of_data_url) == ""


@pytest.mark.parametrize(("x", "digits", "text"), [(1.005, 2, "1.00"), (1.45, 1, "1.4"), (2.5, 0, "3"), (-2.5, 0, "-3"), (None, 2, "—"), (float("nan"), 2, "—"), (float("inf"), 1, "—"), (0.125, 2, "0.13"), (129.6, 0, "130")])
def test_fixed_numbers(x, digits, text):
    assert fixed(x, digits) == text


def test_fixed_numbers_as_a_column(spark):
    df = spark.createDataFrame([(1.005,), (None,), (2.5,)], "v double").select(fmt(F.col("v"), 1))
    assert [r[0] for r in df.collect()] == ["1.0", "—", "2.5"]


def test_fixed_numbers_with_halves_to_even(spark, tmp_path):
    from quillmark.plans.oracles import ORACLES
    from quillmark.plans.queries import QUERIES
    from tests.compare import assert_same, connection

    assert [fixed(x, 0, half_even=True) for x in (760.5, 761.5, -2.5, 2.500001)] == ["760", "762", "-2", "3"]
    rows = [(1, 5323.5), (2, 5330.5), (3, -17.5), (5, 0.875), (13, 5323.5), (6, 2.625)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    assert assert_same(QUERIES["fmt_numbers"](spark, str(tmp_path)), connection(str(tmp_path)), ORACLES["fmt_numbers"]) == len(rows)


def test_layout_checks():
    assert Layout.of({"columns": "2.5", "rows_per_column": None, "num_questions": "", "option_set": "XYZ", "bubble_diameter_mm": "x", "margin_mm": 99}) == Layout(
        columns=3, rows_per_column=4, num_questions=1, margin_mm=25
    )
    assert to_number(" ") == 0 and to_number("x") is None and to_number(float("inf")) is None
    assert ScoringConfig(scale_max=5000, passing_score=2000).validated() == ScoringConfig(scale_max=1000, passing_score=1000)
    assert OmrOptions().calibrated(fill_threshold=0.9, margin_threshold=0.0).fill_threshold == 0.6


def test_layouts_of_columns_agree_with_the_dataclass(spark):
    raw = [{"columns": "2.5", "num_questions": "", "bubble_gap_mm": "abc"}, {"columns": None, "num_questions": "250", "bubble_gap_mm": "1e9"}, {"columns": "NaN", "num_questions": "12.5", "bubble_gap_mm": "-1"}]
    df = spark.createDataFrame([(str(i), r["columns"], r["num_questions"], r["bubble_gap_mm"]) for i, r in enumerate(raw)], "layout_id string, columns string, num_questions string, bubble_gap_mm string")
    got = {r.layout_id: r for r in geometry.normalised(df).collect()}
    for i, r in enumerate(raw):
        want = Layout.of(r)
        assert all(getattr(got[str(i)], f) == getattr(want, f) for f in geometry.FIELDS)


def test_template_has_every_bubble(spark):
    table = geometry.layout_table(spark, {"a": Layout.of(), "b": Layout.of({"num_questions": 130})})
    svg = {(r.layout_id, r.page_index): r.svg for r in geometry.template_svg(table).collect()}
    assert set(svg) == {("a", 0), ("b", 0), ("b", 1), ("b", 2)}
    assert svg["a", 0].count("<circle") == 150 and svg["a", 0].count("<rect") == 4 and svg["b", 2].count("<circle") == 50
    assert "NAMA INSTITUSI" in svg["a", 0] and "Halaman 3 dari 3" in svg["b", 2] and "Butir 121–130 — Opsi: A/B/C/D/E" in svg["b", 2]
    assert "PETUNJUK PENGISIAN" in svg["b", 0] and "PETUNJUK PENGISIAN" not in svg["b", 1] and svg["b", 1].count("Tanggal") == 1
    for page in svg.values():
        ElementTree.fromstring(page)


def test_head_stays_above_the_items(spark):
    table = geometry.layout_table(spark, {str(top): Layout.of({"grid_top_mm": top, "margin_mm": 25}) for top in (30, 60, 160)})
    for r in geometry.template_svg(table).collect():
        heads = [float(x.get("y")) for x in ElementTree.fromstring(r.svg).iter() if x.get("class") == "l"][:-1]
        assert len(heads) == 13 and max(heads) < float(r.layout_id) - 4


def test_csv_is_exact(spark, tmp_path):
    s = wide(spark, {2: "AB", 1: "-A"}).withColumn("name", F.when(F.col("sheet_ord") == 2, 'A "B"').otherwise("=1+1"))
    c = ScoringConfig(num_questions=2)
    rows = norms.with_norms(scoring.score_sheets(s, scoring.key_table(spark, ["A", "B"]), c), c)
    text = sinks.csv_text(rows, c)
    lines = text.split("\r\n")
    assert text.startswith('﻿"No","Nama","Benar"') and '"Nilai (0-100)"' in lines[0] and len(lines) == 3 and not text.endswith("\n")
    assert lines[1] == '"1","=1+1","0","1","1","0.00","0.0","-0.71","42.9","89","24.0","Di Bawah Rata-rata","-A"'
    assert lines[2].startswith('"2","A ""B""","2","0","0","2.00","100.0","0.71"') and lines[2].endswith('"AB"')
    assert '"\'=1+1"' in sinks.csv_text(rows, c, safe=True)
    sinks.write_csv(rows, c, str(tmp_path / "out"))
    parts = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert parts.decode() == text + "\r\n"
    with pytest.raises(ValueError):
        sinks.write_csv(rows.limit(0), c, str(tmp_path / "none"))


def test_export_names(spark):
    df = spark.createDataFrame([("Tes IQ / 2026", "2026-09-10")], "t string, d string")
    assert sinks.export_name(df, "rekap", "t", "d", "csv").first().file_name == "rekap-tes-iq-2026-2026-09-10.csv"


def test_sheets_from_files_and_typing(spark):
    files = spark.createDataFrame([("x", 1, "budi.jpg")], "sheet_id string, sheet_ord long, file_name string")
    row = sheets.from_files(files, 3).first()
    assert (row.name, row.status, row.source, row.answers) == ("BUDI", "pending", "omr", [None] * 3)
    typed = spark.createDataFrame([("a", 1, " ani ", "ab"), ("b", 2, "  ", "ab"), ("c", 3, "x", "-?-")], "sheet_id string, sheet_ord long, name string, text string")
    assert [(r.name, r.answers, r.status) for r in sheets.from_typed(typed, 3, "ABCDE").collect()] == [("ANI", ["A", "B", None], "done")]
    assert sheets.resized(sheets.from_typed(typed, 3, "ABCDE"), 5).first().answers == ["A", "B", None, None, None]


def test_positions_follow_file_names(spark):
    files = spark.createDataFrame([(str(i), f"f{(i * 37) % 100:03}.png") for i in range(100)], "sheet_id string, file_name string").repartition(5)
    rows = sorted(sheets.in_file_order(files).collect(), key=lambda r: r.sheet_ord)
    assert [r.file_name for r in rows] == [f"f{i:03}.png" for i in range(100)] and len({r.sheet_ord for r in rows}) == 100


def test_state_round_trip_and_broken_state(spark, tmp_path):
    good = {"config": {"testName": "T"}, "layout": {"columns": "2"}, "omr_options": {"fill_threshold": 0.2}, "answer_key": ["A", "", "C"]}
    (tmp_path / "s.json").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"answer_key": None}) + "\n")
    rows = sheets.read_state(spark, str(tmp_path / "s.json"), 4).collect()
    assert rows[0].answer_key == ["A", None, "C", None] and rows[0].config == {"testName": "T"}
    assert all(r.answer_key == [None] * 4 and r.config == {} for r in rows[1:])
    sinks.write_state(sheets.read_state(spark, str(tmp_path / "s.json"), 4), str(tmp_path / "out"))
    again = sheets.read_state(spark, str(tmp_path / "out"), 4).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    stored = sheets.from_responses(spark.createDataFrame([(1, 1, "A")], "sheet_ord long, item_no int, response string"), 2)
    sinks.write_sheets(stored.withColumn("image", F.lit("x")), str(tmp_path / "sheets"))
    assert sheets.read_sheets(spark, str(tmp_path / "sheets")).collect() == stored.collect()


@pytest.fixture(scope="module")
def named(spark):
    rows = [("s1", 1, " ani "), ("s2", 2, "ANI"), ("s3", 3, ""), ("s4", 4, None), ("s5", 5, " ani\t")]
    s = spark.createDataFrame(rows, "sheet_id string, sheet_ord long, name string")
    r = [("s1", 1, None), ("s1", 2, "A"), ("s1", 3, "B"), ("s2", 1, "D"), ("s2", 2, None), ("s2", 3, "C"), ("s3", 1, "E"), ("s4", 1, None), ("s5", 3, "B")]
    return s, spark.createDataFrame(r, "sheet_id string, item_no int, response string")


def test_merging_by_name(named):
    s, r = named
    m = merging.memberships(s)
    assert {(x.sheet_id, x.participant_id) for x in m.collect()} == {("s1", "s1"), ("s2", "s1"), ("s5", "s1"), ("s3", "s3"), ("s4", "s4")}
    got = {(x.participant_id, x.item_no): (x.response, x.conflict) for x in merging.merged_responses(r, m).collect()}
    assert got == {("s1", 1): ("D", False), ("s1", 2): ("A", False), ("s1", 3): ("B", True), ("s3", 1): ("E", False), ("s4", 1): (None, False)}
    assert {x.participant_id: x.n_sheets for x in merging.merged_participants(s).collect()} == {"s1": 3, "s3": 1, "s4": 1}
    assert merging.memberships(s, merge=False).where("participant_id <> sheet_id").count() == 0


def test_edits(named):
    s, r = named
    m = merging.memberships(s)
    assert {x.sheet_id for x in merging.renamed(s, m, "s1", " budi ").where("name = 'BUDI'").collect()} == {"s1", "s2", "s5"}
    assert {x.name for x in merging.renamed(s, m, "s3", "  ").where("sheet_id = 's3'").collect()} == {""}
    assert {x.sheet_id for x in merging.removed(s, m, "s1").collect()} == {"s3", "s4"}
    set_ = {(x.sheet_id, x.item_no): x.response for x in merging.edited(r, m, "s1", 1, "A").collect()}
    assert set_["s1", 1] == "A" and set_["s2", 1] is None and set_["s3", 1] == "E"
    cleared = {(x.sheet_id, x.item_no): x.response for x in merging.edited(r, m, "s1", 1, "D").collect()}
    assert cleared["s1", 1] is None and cleared["s2", 1] is None
    assert merging.cleared(s).count() == 0 and merging.cleared(s).columns == s.columns


def test_updates_and_queue(spark):
    s = sheets.from_files(spark.createDataFrame([(c, i, f"{c}.png") for i, c in enumerate("abcd")], "sheet_id string, sheet_ord long, file_name string"), 1)
    new = merging.updated(s, spark.createDataFrame([("a", "done"), ("b", "error"), ("c", "processing")], "sheet_id string, status string"))
    assert {r.sheet_id: r.status for r in new.collect()} == {"a": "done", "b": "error", "c": "processing", "d": "pending"}
    assert {r.sheet_id for r in merging.pending(new).collect()} == {"b", "d"} and {r.sheet_id for r in merging.pending(new, F.lit(True)).collect()} == {"b", "c", "d"}
    unnamed = spark.createDataFrame([("a", None)], "sheet_id string, name string")
    assert merging.updated(s, unnamed).where("sheet_id = 'a'").first().name == "A" and merging.updated(s, unnamed, nulls=True).where("sheet_id = 'a'").first().name is None
    assert merging.updated(s, unnamed, nulls=True).where("name is null").count() == 1
    assert {r.sheet_id: r.page_index for r in merging.with_page_index(s, "b", 2).collect()}["b"] == 2
    assert {r.status: r["count"] for r in reports.outcome_counts(new).collect()} == {"done": 1, "error": 1, "processing": 1, "pending": 1}


def test_roster_sorts_missing_values_to_the_end(spark):
    rows = spark.createDataFrame([(1, "ani", None, None), (2, "Budi", 50.0, 100.0), (3, "CICI", 70.0, 115.0), (4, "budi", 70.0, 60.0)], "sheet_ord long, name string, scaled_score double, deviation_iq double")
    ids = lambda **k: [r.sheet_ord for r in reports.roster(rows, **k).collect()]
    assert ids() == [3, 4, 2, 1] and ids(ascending=True) == [1, 2, 3, 4] and ids(query=" BUDI ") == [4, 2] and ids(key="name")[0] == 1 and ids(key="classification") == [3, 2, 4, 1]
    assert [(r.row_no, r.sheet_ord) for r in reports.roster_page(rows, 2).collect()] == [(1, 3), (2, 4)]
    with pytest.raises(ValueError):
        reports.roster(rows, key="nope")


def test_report_tables(spark):
    c = ScoringConfig(num_questions=2)
    key = scoring.key_table(spark, ["A", "B"])
    s = wide(spark, {1: "AB", 2: "A-", 3: "BA"})
    from quillmark.operators import items

    scored = scoring.score_sheets(s, key, c)
    stats = items.item_statistics_of_sheets(scored, key, c)
    tables = reports.report(spark, norms.with_norms(scored, c), stats, items.kr20(stats), norms.norm_basis(scored, c), c)
    sentence = tables["method"].first()
    assert sentence.reliability_sentence.startswith("Estimasi konsistensi internal melalui KR-20 sebesar ") and "M = 1.00; SD = 1.00" in sentence.norm_sentence and "not standardised" in sentence.note
    assert tables["passed"].first().passed == 1 and [r.row_no for r in tables["roster"].orderBy("row_no").collect()] == [1, 2, 3]
    assert reports.appendix(scored).count() == tables["appendix"].count() == 6
    assert "appendix" not in reports.report(spark, norms.with_norms(scored.drop("items"), c), stats, items.kr20(stats), norms.norm_basis(scored, c), c)
