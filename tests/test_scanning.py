"""Mark reading on drawn and spoiled pages, and its image kernels against plain versions."""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.config import Layout, OmrOptions
from quillmark.operators import imaging as im
from quillmark.operators import decisions, geometry, scanning
from quillmark.plans import drawing
from quillmark.plans.queries import LAYOUTS
from quillmark.sources import images

#: The published conditions and the least share of right answers in each.
VARIANTS = {
    "straight": {}, "5 degrees": {"rotate": 5}, "12 degrees": {"rotate": 12}, "25 degrees": {"rotate": 25}, "dim": {"bright": 0.7}, "dark": {"bright": 0.35}, "keystone 10": {"keystone": 0.1},
    "keystone 18": {"keystone": 0.18}, "noise": {"noise": 55, "blur": 1}, "fair photo": {"rotate": -4, "keystone": 0.05, "bright": 0.75, "vignette": 0.2, "noise": 16, "blur": 1},
    "bad photo": {"rotate": -9, "keystone": 0.12, "bright": 0.6, "vignette": 0.35, "noise": 32, "blur": 2},
}
FLOOR = {"straight": 0.99, "bad photo": 0.9}


def truth(layout: Layout) -> tuple[dict[int, str], frozenset[int]]:
    """Answers drawn by chance, an eighth of the items blank, and half of the answered ones crossed."""
    rng = np.random.default_rng(layout.num_questions)
    items = range(1, min(layout.num_questions, layout.columns * layout.rows_per_column) + 1)
    answers = {no: str(rng.choice(list(layout.option_set))) for no in items if rng.random() > 0.125}
    return answers, frozenset(no for no in answers if rng.random() < 0.5)


def spoil(page: np.ndarray, rotate=0.0, keystone=0.0, bright=1.0, vignette=0.0, noise=0.0, blur=0, seed=1) -> np.ndarray:
    """A photograph of the page: one matrix of a camera that tilts and turns, then light, grain and focus.

    ``keystone`` is what either end of the upper edge loses of the page's width.
    """
    h, w = page.shape
    turn, taper = np.radians(rotate), 1 - 2 * keystone
    middle = np.array([[1, 0, -w / 2], [0, 1, -h / 2], [0, 0, 1.0]])
    # The upper edge is 1 / taper times as far away as the lower one.
    far = (1 / taper - 1) / ((1 / taper + 1) * h / 2)
    tilt = np.array([[2 / (1 + taper), 0, 0], [0, 1, 0], [0, -far, 1]]) * [[(1 + taper) / 2 * (1 + far * h / 2)], [1], [1]]
    spin = np.array([[np.cos(turn), -np.sin(turn), 0], [np.sin(turn), np.cos(turn), 0], [0, 0, 1]])
    camera = spin @ tilt @ middle
    edge = camera @ np.array([[0, w, w, 0], [0, 0, h, h], [1, 1, 1, 1.0]])
    edge = edge[:2] / edge[2]
    low, (width, height) = edge.min(axis=1) - 25, np.ceil(np.ptp(edge, axis=1) + 50).astype(int)
    y, x = np.mgrid[:height, :width]
    back = np.linalg.inv(camera) @ np.stack((x.ravel() + low[0], y.ravel() + low[1], np.ones(x.size)))
    sx, sy = back[:2] / back[2]
    # Bilinear between the four pixels around, on a table wider than the page.
    wide = np.pad(page.astype(float), 2, constant_values=255)
    sx, sy = np.clip(sx + 2, 0, w + 2.999), np.clip(sy + 2, 0, h + 2.999)
    i, j = sx.astype(int), sy.astype(int)
    fx, fy = sx - i, sy - j
    seen = (wide[j, i] * (1 - fx) + wide[j, i + 1] * fx) * (1 - fy) + (wide[j + 1, i] * (1 - fx) + wide[j + 1, i + 1] * fx) * fy
    out = seen.reshape(height, width)
    across, down = np.linspace(-1, 1, width)[None, :], np.linspace(-1, 1, height)[:, None]
    out = out * bright * (1 - vignette * (across**2 + down**2) / 2)
    # Grain of the same spread as even noise of that width.
    out += np.random.default_rng(seed).normal(0, noise / np.sqrt(12), out.shape) if noise else 0
    for _ in range(blur):
        for axis in (0, 1):
            out = (np.roll(out, 1, axis) + 2 * out + np.roll(out, -1, axis)) / 4
    return np.rint(out.clip(0, 255)).astype(np.uint8)


def decide(found: dict) -> dict[int, str | None]:
    o = OmrOptions()
    base = float(np.median([s["fill"] for s in found["samples"]]))
    out = {}
    for no in {s["no"] for s in found["samples"]}:
        mine = sorted(((s["fill"] - base, -s["option_index"], s["option"]) for s in found["samples"] if s["no"] == no), reverse=True)
        out[no] = mine[0][2] if mine[0][0] >= o.fill_threshold and mine[0][0] - mine[1][0] >= o.margin_threshold else None
    return out


def test_every_layout_in_every_condition():
    outcome = Counter()
    for name in ("L30", "L100", "L12", "L60"):
        layout = LAYOUTS[name]
        answers, crossed = truth(layout)
        page = drawing.draw_page(layout, answers, crossed)
        for variant, how in VARIANTS.items():
            found = scanning.read_page(spoil(page, **how), layout)
            if not found["ok"]:
                outcome["rejected"] += 1
                continue
            got = decide(found)
            right = np.mean([got[no] == answers.get(no) for no in range(1, len(got) + 1)])
            outcome["pass" if right >= FLOOR.get(variant, 0.95) else f"wrong: {name} {variant} {right}"] += 1
    assert outcome["rejected"] <= 0.15 * 44 and outcome["pass"] + outcome["rejected"] == 44, outcome


@pytest.mark.parametrize("turn", [1, 2, 3])
def test_pages_on_their_side_or_head(turn):
    layout = LAYOUTS["L30"]
    answers, crossed = truth(layout)
    found = scanning.read_page(np.ascontiguousarray(np.rot90(drawing.draw_page(layout, answers, crossed), turn)), layout)
    assert found["ok"] and {n: a for n, a in decide(found).items() if a} == answers


def test_what_is_no_sheet_is_refused():
    layout = LAYOUTS["L30"]
    for grey in (np.full((300, 200), 255, np.uint8), np.zeros((300, 200), np.uint8), np.random.default_rng(1).integers(0, 256, (400, 300), dtype=np.uint8), np.full((1, 1), 9, np.uint8)):
        assert not scanning.read_page(grey, layout)["ok"]
    page = drawing.draw_page(layout, *truth(layout))
    cut = page.copy()
    cut[:60, :60] = 255
    assert not scanning.read_page(cut, layout)["ok"]
    assert scanning.read_page(page, layout, page=3)["error"] == scanning.NO_ITEMS
    blank = drawing.Canvas(210, 297, 4)
    for x, y in scanning.mark_centers(layout):
        blank.ink((x - 3, y - 3, x + 3, y + 3))
    assert scanning.read_page(blank.grey, layout)["error"] == scanning.MISALIGNED


# ---- kernels -------------------------------------------------------------------


def test_components_agree_with_flood_fill():
    rng = np.random.default_rng(3)
    for density in (0.2, 0.5, 0.62, 0.9):
        mask = rng.random((37, 41)) < density
        seen, areas = np.zeros_like(mask), []
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            stack, cells = [(y, x)], []
            seen[y, x] = True
            while stack:
                a, b = stack.pop()
                cells.append((a, b))
                for i, j in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= i < 37 and 0 <= j < 41 and mask[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        stack.append((i, j))
            c = np.array(cells)
            areas.append((len(c), c[:, 1].min(), c[:, 1].max(), c[:, 0].min(), c[:, 0].max(), c[:, 1].mean(), c[:, 0].mean()))
        got = im.components(mask, 1)
        mine = list(zip(*(got[k] for k in ("area", "min_x", "max_x", "min_y", "max_y", "cx", "cy")), strict=True))
        assert np.allclose(mine, areas)
    assert len(im.components(np.zeros((5, 5), bool))["area"]) == 0


def test_otsu_integral_and_opening():
    grey = np.array([[10] * 50 + [200] * 50], np.uint8)
    assert im.otsu(grey) == 10 and im.otsu(np.full((4, 4), 77, np.uint8)) == 128
    a = np.random.default_rng(1).integers(0, 256, (9, 7), dtype=np.uint8)
    assert im.integral(a)[5, 4] == a[:5, :4].sum()
    plus = np.zeros((7, 7), bool)
    plus[2:5, 3] = plus[3, 2:5] = True
    assert (im.opened(plus) == plus).all()
    plus[3, 2] = False
    assert not im.opened(plus).any() and not im.opened(np.ones((2, 9), bool)).any()


def test_discs_agree_with_loops():
    rng = np.random.default_rng(2)
    mask = rng.random((40, 50)) < 0.4
    x, y, r = rng.uniform(-5, 55, 60), rng.uniform(-5, 45, 60), rng.uniform(0.2, 8, 60)
    got = im.disc_shares(mask, x, y, r, block=7)
    for k in range(60):
        rr = max(1.5, r[k])
        cells = [mask[j, i] for j in range(40) for i in range(50) if (i - x[k]) ** 2 + (j - y[k]) ** 2 <= rr * rr]
        assert got[k] == pytest.approx(np.mean(cells) if cells else 0.0)


def test_homography_round_trip_and_degenerate_points():
    rng = np.random.default_rng(4)
    src, dst = np.array([(9, 9), (201, 9), (201, 288), (9, 288)], float), rng.uniform(0, 900, (4, 2))
    px, py = im.project(im.homography(src, dst), src[:, 0], src[:, 1])
    assert np.allclose(np.column_stack((px, py)), dst)
    assert im.homography(np.array([(0, 0), (1, 1), (2, 2), (3, 3)], float), dst) is None


def test_hull_and_quad():
    p = np.array([(0, 0), (5, 0), (10, 0), (10, 10), (0, 10), (5, 5), (2, 3)], float)
    assert {tuple(p[i]) for i in im.convex_hull(p)} == {(0, 0), (10, 0), (10, 10), (0, 10)}
    q = im.widest_quad(p, np.ones(7))
    assert im.signed_area(p[q]) == 100 and im.widest_quad(p[:3], np.ones(3)) is None


def test_shrinking_keeps_means():
    a = np.random.default_rng(5).integers(0, 256, (600, 400), dtype=np.uint8)
    small = im.shrink(a, 300)
    assert small.shape == (300, 200) and np.abs(small - a.reshape(300, 2, 200, 2).mean(axis=(1, 3))).max() <= 0.5 and im.shrink(a, 600) is a


def test_pixels_of_colour_and_transparency():
    bgr = np.array([[[255, 0, 0], [0, 0, 255]]], np.uint8)
    assert scanning.pixels_of(1, 2, 3, bgr.tobytes()).tolist() == [[29, 76]]
    clear = np.array([[[0, 0, 0, 0], [0, 0, 0, 255]]], np.uint8)
    assert scanning.pixels_of(1, 2, 4, clear.tobytes()).tolist() == [[255, 0]]


def test_python_geometry_agrees_with_the_tables(spark):
    table = geometry.layout_table(spark, LAYOUTS)
    rows = geometry.bubble_centers(table).collect()
    marks = geometry.fiducials(table).collect()
    for name, layout in LAYOUTS.items():
        pages = -(-layout.num_questions // (layout.columns * layout.rows_per_column))
        mine = {}
        for page in range(pages):
            c = scanning.page_centers(layout, page)
            for i in range(len(c["no"])):
                mine[page, int(c["no"][i]), int(c["option_index"][i])] = (int(c["column"][i]), int(c["row"][i]), c["x_mm"][i], c["y_mm"][i])
        theirs = {(r.page_index, r.no, r.option_index): (r.column, r.row, r.x_mm, r.y_mm) for r in rows if r.layout_id == name}
        assert set(mine) == set(theirs) and all(np.allclose(mine[k], theirs[k]) for k in mine)
        assert np.allclose(scanning.mark_centers(layout), [next((m.x_mm, m.y_mm) for m in marks if (m.layout_id, m.corner) == (name, k)) for k in ("tl", "tr", "br", "bl")])


# ---- in Spark --------------------------------------------------------------------


def png(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in grey)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("scans")
    layout = LAYOUTS["L30"]
    (d / "ani budi.png").write_bytes(png(drawing.draw_page(layout, *truth(layout))))
    (d / "broken.png").write_bytes(b"no image")
    (d / "white.png").write_bytes(png(np.full((400, 300), 255, np.uint8)))
    return d


def test_files_to_answers(spark, folder):
    layout = LAYOUTS["L30"]
    read = images.read_images(spark, str(folder))
    assert tuple(images.intake_counts(read).first()) == (2, 1)
    assert {r.file_name: r.name for r in read.collect()}["ani budi.png"] == "ANI BUDI"
    missing = read.unionByName(spark.createDataFrame([("gone", "g.png", "G", None, None, None, None, None)], "sheet_id string, file_name string, name string, page_index int, height int, width int, n_channels int, data binary"))
    scans = scanning.scanned(missing, layout)
    by = {r.sheet_id: r for r in scans.collect()}
    names = {r.sheet_id: r.file_name for r in read.collect()}
    errors = {names.get(i, "gone"): r.error for i, r in by.items()}
    assert errors == {"ani budi.png": None, "broken.png": scanning.BAD_IMAGE, "white.png": scanning.NO_MARKS, "gone": scanning.NO_IMAGE}
    decided = decisions.decide_scans(scans, OmrOptions())
    ok = decided.where("ok").first()
    answers, _ = truth(layout)
    assert {a.no: a.response for a in ok.answers} == {n: answers.get(n) for n in range(1, 31)}
    assert ok.marked == len(answers) and ok.fill_rate == pytest.approx(len(answers) / 30)
    assert {a.flag for a in ok.answers if a.response is None} == {"kosong"}
    from quillmark.sources import sheets

    files = read.select("sheet_id", F.monotonically_increasing_id().alias("sheet_ord"), "file_name")
    after = {r.file_name: r for r in scanning.sheets_after(sheets.from_files(files, 30), decided, 30).collect()}
    assert after["ani budi.png"].status == "done" and after["ani budi.png"].answers == [answers.get(n) for n in range(1, 31)]
    assert after["white.png"].status == "error" and after["white.png"].error == scanning.NO_MARKS and after["white.png"].answers == [None] * 30


def test_nested_and_long_decisions_agree(spark, folder):
    scans = scanning.scanned(images.read_images(spark, str(folder)), LAYOUTS["L30"])
    o = OmrOptions(fill_threshold=0.05, margin_threshold=0.02)
    nested = decisions.decide_scans(scans, o).where("ok").select("sheet_id", F.explode("answers").alias("a")).select("sheet_id", "a.no", "a.response", "a.flag")
    long = decisions.decisions(decisions.with_net(scanning.samples_of(scans), "sheet_id"), o, "sheet_id").select("sheet_id", "no", "response", "flag")
    assert sorted(map(str, nested.collect())) == sorted(map(str, long.collect())) and nested.count() == 30


def test_decisions_are_made_once_a_page_when_answers_are_exploded(spark):
    """The filter that explode adds used to carry the sorting of all bubbles into every bubble's lambda."""
    bubble = "named_struct('no', {}, 'option', '{}', 'option_index', {}, 'column', 0, 'row', 0, 'x_mm', 0D, 'y_mm', 0D, 'x', 0D, 'y', 0D, 'radius', 1D, 'fill', {}D)"
    fills = {1: (0.1, 0.7), 3: (0.1, 0.1), 2: (0.6, 0.6), 7: (0.2,)}
    samples = ", ".join(bubble.format(no, "AB"[i], i, f) for no, of in fills.items() for i, f in reversed(list(enumerate(of))))
    scans = spark.sql(f"select 'x' as sheet_id, true as ok, array({samples}) as samples union all select 'y', false, null")
    decided = decisions.decide_scans(scans, OmrOptions())
    # The baseline is 0.2.
    assert [tuple(a) for a in decided.where("ok").first().answers] == [(1, "B", None), (2, None, "ganda"), (3, None, "kosong"), (7, None, "kosong")]
    one = decided.select("sheet_id", F.explode("answers").alias("a"))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert one.count() == 4 and 0 < plan.count(".fill, lambda") <= 3, plan.count(".fill, lambda")


def test_two_marks_are_flagged(spark):
    rows = [(1, 1, 0, "A", 0.6), (1, 1, 1, "B", 0.55), (1, 2, 0, "A", 0.1), (1, 2, 1, "B", 0.1), (1, 3, 0, "A", 0.7), (1, 3, 1, "B", 0.1), (1, 4, 0, "A", 0.1), (1, 4, 1, "B", 0.1)]
    samples = spark.createDataFrame(rows, "sheet_ord long, no int, option_index int, option string, fill double")
    got = {r.no: (r.response, r.flag) for r in decisions.decisions(decisions.with_net(samples), OmrOptions()).collect()}
    assert got == {1: (None, "ganda"), 2: (None, "kosong"), 3: ("A", None), 4: (None, "kosong")}


def test_drawn_pages_of_several_pages(spark):
    layout = LAYOUTS["L130"]
    answers = ["ABCDE"[i % 5] if i % 4 else None for i in range(130)]
    s = spark.createDataFrame([("x", answers)], "sheet_id string, answers array<string>")
    decided = decisions.decide_scans(scanning.scanned(drawing.drawn_pages(s, layout), layout), OmrOptions())
    got = {a.no: a.response for r in decided.collect() for a in r.answers}
    assert got == {i + 1: a for i, a in enumerate(answers)}


def test_pages_are_dealt_over_tasks_and_settings_stay(spark):
    layout = LAYOUTS["L12"]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    s = spark.range(70).selectExpr("cast(id as string) as sheet_id", "array('A', 'B', 'C') as answers")
    drawn = drawing.drawn_pages(scanning.spread(s, 70), layout, 3)
    scans = scanning.scanned(drawn, layout)
    assert scans.where("ok").count() == 70
    held = scans.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(held) > 1 and max(r["count"] for r in held) < 40
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) == before


def test_dark_mask_agrees_with_plain_means():
    rng = np.random.default_rng(3)
    for shape, divisor, bias in (((40, 57), 60, 30), ((33, 90), 5, 12.5), ((9, 8), 60, 30)):
        grey = rng.integers(0, 256, shape).astype(np.uint8)
        r = max(6, int(min(shape) / divisor + 0.5))
        mean = np.array([[grey[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].mean() for x in range(shape[1])] for y in range(shape[0])])
        mask, level = im.dark_mask(grey, divisor, bias)
        assert (mask == ((grey < level) | ((grey < mean - bias) & (grey < 200)))).all()


def test_kernels_agree_with_plain_sums_and_drawn_pages_with_inked_ones():
    rng = np.random.default_rng(4)
    for h, w in ((1, 9), (40, 33), (300, 57)):
        grey = rng.integers(0, 256, (h, w)).astype(np.uint8)
        for turned in (grey, np.rot90(grey)):
            mask, level = im.dark_mask(turned, 9, 12)
            r = max(6, int(min(h, w) / 9 + 0.5))
            for y, x in np.ndindex(turned.shape):
                box = turned[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
                assert mask[y, x] == (turned[y, x] < level or (turned[y, x] < 200 and int(turned[y, x]) + 12 < box.mean()))
        colours = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        assert (im.to_grey(colours) == im.to_grey(colours.astype(float))).all()


def test_pages_are_drawn_and_read_in_one_task(spark):
    """Images used to pass from Python to Spark and back, three times the bytes for colours."""
    layout = Layout.of({"num_questions": 12, "columns": 1, "rows_per_column": 12})
    s = spark.createDataFrame([(str(i), list("ABCDE"[i % 3 :] + "ABCDEABCDE")[:12]) for i in range(5)], "sheet_id string, answers array<string>")
    two = scanning.scanned(drawing.drawn_pages(s, layout), layout)
    one = scanning.scanned(s, layout, source=drawing.drawer(layout))
    assert one._jdf.queryExecution().toString().count("MapInPandas") < two._jdf.queryExecution().toString().count("MapInPandas")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_kernels_skip_what_is_white_or_plain_and_change_nothing():
    rng = np.random.default_rng(6)
    for h, w in ((1, 9), (33, 41), (40, 64)):
        colours = np.full((h, w, 3), 255, np.uint8)
        inked = rng.random((h, w)) < 0.1
        colours[inked] = rng.integers(0, 256, (inked.sum(), 3))
        plain = np.rint(colours.astype(float) @ [114.0, 587.0, 299.0] / 1000)
        assert (scanning.pixels_of(h, w, 3, colours.tobytes()) == plain).all()
        assert (im.grey_of(colours, im.LUMA) == im.to_grey(colours.astype(float))).all()
        grey = plain.astype(np.uint8)
        n = np.bincount(grey.ravel(), minlength=256).astype(float)
        low, all_ = np.cumsum(n), n.sum()
        mean = np.cumsum(n * np.arange(256))
        between = [a * (all_ - a) * (s / a - (mean[-1] - s) / (all_ - a)) ** 2 if 0 < a < all_ else 0 for a, s in zip(low, mean, strict=True)]
        assert im.otsu(grey) == (int(np.argmax(between)) if max(between) > 0 else 128)
        mask = np.pad(inked, 1)
        plus = lambda m: [m[1:-1, 1:-1], m[:-2, 1:-1], m[2:, 1:-1], m[1:-1, :-2], m[1:-1, 2:]]
        dense = np.pad(rng.random((h, w)) < 0.8, 1)[1:-1, 1:-1]
        eroded, out = np.zeros_like(dense), np.zeros_like(dense)
        if min(h, w) > 2:
            eroded[1:-1, 1:-1] = np.logical_and.reduce(plus(dense))
            out[1:-1, 1:-1] = np.logical_or.reduce(plus(eroded))
        assert (im.opened(dense) == out).all()
        for flat in (mask.ravel(), dense.ravel(), dense.ravel()[:5]):
            assert (im._set(flat) == np.flatnonzero(flat)).all()
    thousandths = np.arange(255_001)
    assert (np.rint(thousandths.astype(np.float32) / 1000) == np.rint(thousandths / 1000)).all()


def test_read_pages_leave_a_task_together():
    """Each page used to leave as a table of its own, made of 150 dictionaries."""
    import pyarrow as pa

    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    layout = Layout.of({"num_questions": 12, "columns": 1, "rows_per_column": 12})
    run = scanning.scanned(Frame(), layout, source=drawing.drawer(layout))
    sheets = [(str(i), list("ABCDE"[i % 3 :] + "ABCDEABCDE")[:12]) for i in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array([s for s, _ in sheets]), pa.array([a for _, a in sheets])], names=["sheet_id", "answers"])
    out = list(run(iter([batch, batch])))
    assert [b.num_rows for b in out] == [10]
    rows = out[0].to_pylist()
    for (sheet_id, answers), row in zip(sheets * 2, rows, strict=True):
        crossed = frozenset(range(2, 13, 3))
        want = scanning.read_page(drawing.draw_page(layout, dict(enumerate(answers, 1)), crossed), layout)
        assert row == want | {"sheet_id": sheet_id, "page_index": 0}


def test_images_with_missing_numbers_are_failed_rows(spark):
    rows = [("a", None, 2, None, 1, b"1234"), ("b", 0, 2, 2, None, b"1234"), ("c", 0, None, 2, 1, b"1234"), ("d", 1, 2, 2, 1, None), ("e", 0, 2, 2, 1, b"123"), ("f", 0, 0, 2, 1, b""), (None, 0, 2, 2, 1, b"1234")]
    images = spark.createDataFrame(rows, "sheet_id string, page_index int, height int, width int, n_channels int, data binary")
    got = {r.sheet_id: (r.page_index, r.ok, r.error, r.samples) for r in scanning.scanned(images, LAYOUTS["L30"]).collect()}
    bad = f"{scanning.BAD_IMAGE}: ValueError"
    assert got == {"a": (0, False, bad, None), "b": (0, False, bad, None), "c": (0, False, scanning.NO_IMAGE, None), "d": (1, False, scanning.NO_IMAGE, None), "e": (0, False, bad, None), "f": (0, False, scanning.BAD_IMAGE, None), None: (0, False, scanning.NO_MARKS, None)}
