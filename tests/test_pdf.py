"""PDF files against a small parser that follows their tables of places."""

from __future__ import annotations

import re

import pytest

from quillmark.config import Heading, Layout, ScoringConfig
from quillmark.operators import geometry, items, norms, pdf, reports, scoring
from quillmark.sources import sinks


def parsed(data: bytes) -> dict[int, bytes]:
    """Bodies of the objects by number, each found at its place."""
    assert data.startswith(b"%PDF-1.4\n") and data.endswith(b"%%EOF\n")
    at = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", data)[1])
    head, n = re.match(rb"xref\n0 (\d+)\n", data[at:]), None
    n = int(head[1])
    places = data[at + head.end() :][: 20 * n]
    assert places[:20] == b"0000000000 65535 f \n" and re.search(rb"/Size %d /Root 1 0 R" % n, data[at:])
    out = {}
    for i in range(1, n):
        entry = places[20 * i : 20 * i + 20]
        assert re.fullmatch(rb"\d{10} 00000 n \n", entry)
        place = int(entry[:10])
        assert data[place:].startswith(b"%d 0 obj\n" % i)
        out[i] = data[place : data.index(b"\nendobj\n", place)].split(b" 0 obj\n", 1)[1]
    return out


def pages_of(objects: dict[int, bytes]) -> list[bytes]:
    """Commands of the pages in order, by way of the catalogue."""
    assert b"/Pages 2 0 R" in objects[1]
    kids = [int(k) for k in re.findall(rb"(\d+) 0 R", re.search(rb"\[(.*?)\]", objects[2])[1])]
    assert re.search(rb"/Count (\d+)", objects[2])[1] == b"%d" % len(kids)
    out = []
    for k in kids:
        body = objects[int(re.search(rb"/Contents (\d+) 0 R", objects[k])[1])]
        length = int(re.match(rb"<< /Length (\d+) >>\nstream\n", body)[1])
        commands = body.split(b"stream\n", 1)[1]
        assert commands[length:] == b"\nendstream"
        out.append(commands[:length])
    return out


def texts(commands: bytes) -> list[tuple[float, float, str]]:
    found = re.findall(rb"BT /F1 [\d.]+ Tf (-?[\d.]+) (-?[\d.]+) Td <([0-9A-F]*)> Tj ET", commands)
    return [(float(x), float(y), bytes.fromhex(t.decode()).decode("cp1252")) for x, y, t in found]


def test_template_files_hold_every_bubble(spark):
    layouts = {"L": Layout.of(), "M": Layout.of({"num_questions": 130, "option_set": "ABCD"}), "Ünd": Layout.of({"num_questions": 1})}
    table = geometry.layout_table(spark, layouts)
    files = {r.doc_id: bytes(r.file) for r in pdf.whole(pdf.documents(pdf.template_pages(table, Heading("Dinas <A>", "", "Tes", "日 — €")))).collect()}
    assert set(files) == set(layouts)
    bubbles = geometry.bubble_centers(table).collect()
    for name, layout in layouts.items():
        pages = pages_of(parsed(files[name]))
        for i, commands in enumerate(pages):
            mine = [b for b in bubbles if b.layout_id == name and b.page_index == i]
            begun = re.findall(rb"(-?[\d.]+) (-?[\d.]+) m ", commands)
            want = sorted((round(b.x_mm * pdf.POINTS + layout.bubble_diameter_mm * pdf.POINTS / 2, 3), round((297 - b.y_mm) * pdf.POINTS, 3)) for b in mine)
            assert [v for p in sorted((float(x), float(y)) for x, y in begun) for v in p] == pytest.approx([v for p in want for v in p], abs=2e-3)
            assert commands.count(b" re f\n") == 4
            lines = [t for *_, t in texts(commands)]
            assert "DINAS <A>" in lines and f"Halaman {i + 1} dari {len(pages)}" in lines and "TES — ? — €" in lines
            assert (geometry.INSTRUCTIONS_TITLE.upper() in lines) == (i == 0)
            assert {str(b.no) for b in mine} <= set(lines)


def test_report_keeps_every_row_and_cuts_no_line(spark, tmp_path):
    c = ScoringConfig(num_questions=2)
    key = scoring.key_table(spark, ["A", "B"])
    rows = [(str(i), i, f"Nama (é) {i}", [["A", "B", None][i % 3], "B"], "done") for i in range(180)]
    s = spark.createDataFrame(rows, "sheet_id string, sheet_ord long, name string, answers array<string>, status string")
    scored = scoring.score_sheets(s, key, c)
    normed = norms.with_norms(scored, c)
    stats = items.item_statistics_of_sheets(scored, key, c)
    one = scored.selectExpr("count(*) as n").crossJoin(items.kr20(stats)).crossJoin(norms.norm_basis(scored, c))
    parts = pdf.documents(pdf.report_pages(normed, norms.descriptive_stats(normed, "scaled_score"), reports.report_sentences(one), c, "Laporan"))
    path = str(tmp_path / "report.pdf")
    n = sinks.write_document(parts, path)
    with open(path, "rb") as f:
        data = f.read()
    assert len(data) == n
    pages = pages_of(parsed(data))
    assert len(pages) > 3
    seen = []
    for commands in pages:
        lines = texts(commands)
        ys = [y for x, y, _ in lines if abs(x - pdf.MARGIN) < 0.01]
        assert all(a - b >= 12.99 for a, b in zip(ys, ys[1:], strict=False)) and min(ys) >= pdf.MARGIN * 0.9 and max(ys) <= pdf.A4[1] - pdf.MARGIN
        seen += [t for *_, t in lines]
    assert seen[0] == "Laporan" and [t for t in seen if t.startswith("Nama")] == [f"Nama (é) {i}" for i in range(180)]
    assert any(t.startswith("Estimasi konsistensi") or t.startswith("Koefisien") for t in seen)


def test_places_beyond_a_million_bytes_are_counted(spark):
    from quillmark.plans.queries import _report_counts

    line = "BT /F1 8.000 Tf 1.000 1.000 Td <41> Tj ET\n"
    rows = [("report", page, 595.0, 842.0, line * 8_000) for page in range(6)]
    parts = pdf.documents(spark.createDataFrame(rows, "doc_id string, page long, width double, height double, commands string"))
    assert parts.selectExpr("sum(length(text))").first()[0] > 1_500_000
    assert _report_counts(parts).collect() == [(6, 48_000, 15)]


def test_printed_pages_need_no_exchange(spark):
    """A page's bubbles used to be exploded, drawn, shuffled and gathered again."""
    table = geometry.layout_table(spark, {"L": Layout.of(), "M": Layout.of({"num_questions": 130, "option_set": "ABCD"})})
    for pages in (geometry.template_svg(table), pdf.template_pages(table)):
        assert "Exchange" not in pages._jdf.queryExecution().executedPlan().toString()
        assert pages.count() == sum(r.page_count for r in geometry.layout_metrics(table).collect())


def test_no_pages_no_file(spark):
    none = spark.createDataFrame([], "doc_id string, page long, width double, height double, commands string")
    assert pdf.documents(none).count() == 0
