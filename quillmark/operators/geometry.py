"""Sheet geometry from layouts: a row per layout in, a row per printed thing out.

All sizes are millimetres on the page. Renderer and reader use these tables, so
what is printed and what is sampled cannot drift apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.config import LAYOUT_BOUNDS, LAYOUT_COUNTS, OPTION_SETS, Heading, Layout
from quillmark.functions.formatting import thousandths
from quillmark.functions.scalars import half_up

FIELDS = [f.name for f in fields(Layout)]
_NUMERIC = [f for f in FIELDS if f != "option_set"]


def layout_table(spark: SparkSession, layouts: dict[str, Layout]) -> DataFrame:
    """(layout_id, field...) of checked layouts."""
    kinds = ", ".join(f"{f} {'string' if f == 'option_set' else 'int' if f in LAYOUT_COUNTS else 'double'}" for f in FIELDS)
    convert = lambda f, v: v if f == "option_set" else int(v) if f in LAYOUT_COUNTS else float(v)
    rows = [(name, *[convert(f, getattr(x, f)) for f in FIELDS]) for name, x in layouts.items()]
    return spark.createDataFrame(rows, f"layout_id string, {kinds}")


def normalised(raw: DataFrame) -> DataFrame:
    """(layout_id, field...) from text columns: numbers clamped to their bounds, counts rounded, defaults for the rest.

    An absent column takes the default. Null and blank text count as 0, so they
    end at the lower bound; other text that is no number takes the default.
    """
    out = []
    for f in fields(Layout):
        if f.name not in raw.columns:
            value = F.lit(f.default)
            value = value if f.name == "option_set" else value.cast("int" if f.name in LAYOUT_COUNTS else "double")
        elif f.name == "option_set":
            value = F.when(F.col(f.name).isin(*OPTION_SETS), F.col(f.name)).otherwise(f.default)
        else:
            text = F.trim(F.coalesce(F.col(f.name).cast("string"), F.lit("")))
            parsed = text.try_cast("double")
            finite = F.when(~F.isnan(parsed) & (F.abs(parsed) < float("inf")), parsed)
            value = F.when(text == "", 0.0).otherwise(F.coalesce(finite, F.lit(float(f.default))))
            if f.name in LAYOUT_BOUNDS:
                low, high = LAYOUT_BOUNDS[f.name]
                value = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))
            if f.name in LAYOUT_COUNTS:
                value = half_up(value).cast("int")
        out.append(value.alias(f.name))
    return raw.select("layout_id", *out)


def _let(df: DataFrame) -> DataFrame:
    """``df`` with what follows from its layout fields."""
    n_options = F.length("option_set")
    out = df.withColumn("option_count", n_options)
    out = out.withColumn("usable_width_mm", F.col("page_width_mm") - 2 * F.col("margin_mm"))
    out = out.withColumn("column_width_mm", (F.col("usable_width_mm") - F.col("column_gap_mm") * (F.col("columns") - 1)) / F.col("columns"))
    out = out.withColumn("bubble_block_mm", n_options * F.col("bubble_diameter_mm") + (n_options - 1) * F.col("bubble_gap_mm"))
    out = out.withColumn("required_column_mm", F.col("number_gutter_mm") + F.col("bubble_block_mm"))
    out = out.withColumn("grid_bottom_limit_mm", F.col("page_height_mm") - F.col("margin_mm") - F.col("footer_mm"))
    rows = F.floor((F.col("grid_bottom_limit_mm") - F.col("grid_top_mm")) / F.col("row_pitch_mm"))
    out = out.withColumn("max_rows", F.greatest(F.lit(0), rows).cast("int"))
    out = out.withColumn("per_page", F.col("columns") * F.col("rows_per_column"))
    return out.withColumn("page_count", F.greatest(F.lit(1), F.ceil(F.col("num_questions") / F.col("per_page"))).cast("int"))


def layout_metrics(layouts: DataFrame) -> DataFrame:
    """(layout_id, measures..., issues array<string>, printable); several pages are an issue but can be printed."""
    m = _let(layouts)
    narrow = F.col("required_column_mm") > F.col("column_width_mm")
    tall = F.col("rows_per_column") > F.col("max_rows")
    issues = [
        F.when(narrow, F.lit("column_too_narrow")),
        F.when(tall, F.lit("too_many_rows")),
        F.when(F.col("page_count") > 1, F.lit("several_pages")),
    ]
    names = ["option_count", "usable_width_mm", "column_width_mm", "bubble_block_mm", "required_column_mm", "grid_bottom_limit_mm", "max_rows", "per_page", "page_count"]
    return m.select("layout_id", *names, F.array_compact(F.array(*issues)).alias("issues"), (~narrow & ~tall).alias("printable"))


def page_items(layouts: DataFrame, pages: Column | None = None) -> DataFrame:
    """(layout_id, page_index, no, column, row) of every item of every page, columns of about equal length filled one after another."""
    m = _let(layouts)
    page = F.explode(F.sequence(F.lit(0), F.col("page_count") - 1) if pages is None else pages)
    m = m.select("layout_id", "columns", "per_page", "num_questions", page.alias("page_index"))
    m = m.withColumn("start", F.col("page_index") * F.col("per_page"))
    m = m.withColumn("count", F.greatest(F.lit(0), F.least("per_page", F.col("num_questions") - F.col("start")))).where("count > 0")
    m = m.withColumn("rows_used", F.ceil(F.col("count") / F.col("columns")).cast("int"))
    m = m.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    column = F.floor(F.col("k") / F.col("rows_used")).cast("int")
    return m.select("layout_id", "page_index", (F.col("start") + F.col("k") + 1).alias("no"), column.alias("column"), (F.col("k") % F.col("rows_used")).alias("row"))


def corners() -> dict[str, tuple[Column, Column]]:
    """Middles of the four marks."""
    inset = F.col("fiducial_inset_mm") + F.col("fiducial_size_mm") / 2
    right, bottom = F.col("page_width_mm") - inset, F.col("page_height_mm") - inset
    return {"tl": (inset, inset), "tr": (right, inset), "br": (right, bottom), "bl": (inset, bottom)}


def fiducials(layouts: DataFrame) -> DataFrame:
    """(layout_id, corner, x_mm, y_mm): centres of the four marks."""
    four = F.array(*[F.struct(F.lit(k).alias("corner"), x.alias("x_mm"), y.alias("y_mm")) for k, (x, y) in corners().items()])
    return layouts.select("layout_id", F.explode(four).alias("f")).select("layout_id", "f.*")


def _placed(layouts: DataFrame) -> DataFrame:
    """Items with their layout's measures and the left edge and height of their row."""
    items = page_items(layouts).join(_let(layouts), "layout_id")
    left = F.col("margin_mm") + F.col("column") * (F.col("column_width_mm") + F.col("column_gap_mm"))
    y = F.col("grid_top_mm") + F.col("row") * F.col("row_pitch_mm") + F.col("bubble_diameter_mm") / 2
    return items.withColumn("left_mm", left).withColumn("y_mm", y)


def bubble_centers(layouts: DataFrame) -> DataFrame:
    """(layout_id, page_index, no, option, option_index, column, row, x_mm, y_mm) of every bubble."""
    placed = _placed(layouts).withColumn("option_index", F.explode(F.sequence(F.lit(0), F.col("option_count") - 1)))
    pitch = F.col("bubble_diameter_mm") + F.col("bubble_gap_mm")
    x = F.col("left_mm") + F.col("number_gutter_mm") + F.col("option_index") * pitch + F.col("bubble_diameter_mm") / 2
    option = F.substring("option_set", F.col("option_index") + 1, F.lit(1))
    return placed.select("layout_id", "page_index", "no", option.alias("option"), "option_index", "column", "row", x.alias("x_mm"), "y_mm")


def number_anchors(layouts: DataFrame) -> DataFrame:
    """(layout_id, page_index, no, x_mm, width_mm, y_mm): where each item's number is printed."""
    return _placed(layouts).select("layout_id", "page_index", "no", F.col("left_mm").alias("x_mm"), (F.col("number_gutter_mm") - 1.5).alias("width_mm"), "y_mm")


def printed_pages(layouts: DataFrame) -> DataFrame:
    """A row for each page: its layout's fields and measures, page_index, first and last (numbers of its items) and rows_used."""
    m = _let(layouts).withColumn("page_index", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)))
    m = m.withColumn("first", F.col("page_index") * F.col("per_page") + 1)
    m = m.withColumn("last", F.least(F.col("first") + F.col("per_page") - 1, F.col("num_questions"))).where("last >= first")
    return m.withColumn("rows_used", F.ceil((F.col("last") - F.col("first") + 1) / F.col("columns")).cast("int"))


def printed_items(number: Callable, heights: Callable, widths: Callable, bubble: Callable) -> Column:
    """Text of all items of a row of ``printed_pages``, one after another, without an exchange.

    ``number`` makes the text of an item of its no, left edge and height; of
    each bubble ``bubble`` makes one of its letter and what ``heights`` and
    ``widths`` made, once an item and once a bubble, of its middle's y and x.
    """
    n = F.col("last") - F.col("first")
    column = lambda k: F.floor(k / F.col("rows_used"))
    y = lambda k: F.col("grid_top_mm") + k % F.col("rows_used") * F.col("row_pitch_mm") + F.col("bubble_diameter_mm") / 2
    left = lambda k: F.col("margin_mm") + column(k) * (F.col("column_width_mm") + F.col("column_gap_mm"))
    items = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((F.col("first") + k).alias("no"), left(k).alias("left"), y(k).alias("y")))
    items = F.transform(items, lambda i: F.struct(number(i["no"], i["left"], i["y"]).alias("number"), i["left"].alias("left"), heights(i["y"]).alias("heights")))
    x = lambda left, o: left + F.col("number_gutter_mm") + o * (F.col("bubble_diameter_mm") + F.col("bubble_gap_mm")) + F.col("bubble_diameter_mm") / 2

    def bubbles(i: Column) -> Column:
        placed = F.transform(F.sequence(F.lit(0), F.col("option_count") - 1), lambda o: F.struct(F.substr(F.col("option_set"), o + 1, F.lit(1)).alias("letter"), x(i["left"], o).alias("x")))
        placed = F.transform(placed, lambda b: F.struct(b["letter"].alias("letter"), widths(b["x"]).alias("widths")))
        return F.array_join(F.transform(placed, lambda b: bubble(b["letter"], b["widths"], i["heights"])), "")

    return F.array_join(F.transform(items, lambda i: F.concat(i["number"], bubbles(i))), "")


#: What every page prints; the instructions stand on the first page only.
NO_INSTITUTION = "Nama Institusi"
SHEET_TITLE = "Lembar Jawaban Komputer"
PAGE_OF = "Halaman %d dari %d"
NAME_BOX = ("Nama", "No. Peserta", "Kelas / Unit", "Tanggal")
INSTRUCTIONS_TITLE = "Petunjuk Pengisian"
INSTRUCTIONS = (
    "Tulis nama dengan HURUF KAPITAL yang jelas pada kolom identitas.",
    "Gunakan pensil 2B atau pulpen hitam. Jangan gunakan tipp-ex.",
    "Tandai jawaban dengan menghitamkan bulatan penuh (●) atau memberi tanda silang (X) pada satu pilihan saja.",
    "Jawaban ganda, ragu, atau terhapus tidak akan dinilai.",
    "Jaga keempat kotak hitam di sudut lembar tetap bersih — kotak itu acuan pemindai.",
)
ITEMS_OF = "Butir %d–%d — Opsi: %s"
SIGNATURE = "Paraf Pengawas"

#: Millimetres that the head takes at full size; a lower head is drawn smaller.
HEAD_MM = 70.0


def _mm(c: Column) -> Column:
    return thousandths(c)


def _xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _line(kind: str, x: Column, y: Column, size: Column, text: Column) -> Column:
    """A line of text that starts (class l) or ends (class r) at x."""
    return F.concat(F.lit(f'<text class="{kind}" x="'), _mm(x), F.lit('" y="'), _mm(y), F.lit('" style="font-size:'), _mm(size), F.lit('px">'), _xml(text), F.lit("</text>"))


def _box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.concat(F.lit('<path d="M'), _mm(left), F.lit(" "), _mm(top), F.lit("H"), _mm(right), F.lit("V"), _mm(bottom), F.lit("H"), _mm(left), F.lit('Z"/>'))


def _rule(left: Column, y: Column, right: Column) -> Column:
    return F.concat(F.lit('<path d="M'), _mm(left), F.lit(" "), _mm(y), F.lit("H"), _mm(right), F.lit('"/>'))


def _page_head(heading: Heading) -> Column:
    """Title, page number, name box and, on the first page, instructions, above grid_top_mm."""
    left, right = F.col("margin_mm"), F.col("page_width_mm") - F.col("margin_mm")
    scale = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("grid_top_mm") - F.col("margin_mm") - 4) / HEAD_MM))
    y = lambda mm: F.col("margin_mm") + scale * mm
    size = lambda mm: scale * mm
    middle, pad = left + (right - left) * 0.6, scale * 2
    title = " — ".join(t for t in (heading.test_name, heading.instrument) if t)
    parts = [
        _line("l", left, y(2), size(3.4), F.upper(F.lit(heading.institution or NO_INSTITUTION))),
        _line("r", right, y(2), size(2.8), F.upper(F.lit(SHEET_TITLE))),
        _line("l", left, y(6), size(2.5), F.lit(heading.unit)),
        _line("r", right, y(6), size(2.5), F.format_string(PAGE_OF, F.col("page_index") + 1, F.col("page_count"))),
        _rule(left, y(8.5), right),
        _line("l", left, y(12), size(2.9), F.upper(F.lit(title))),
        _box(left, y(15), right, y(31)),
    ]
    for i, label in enumerate(NAME_BOX):
        start, end = (middle, right - pad) if i % 2 else (left + pad, middle - pad)
        row = y(20 + 7 * (i // 2))
        parts += [_line("l", start, row, size(2.5), F.lit(label)), _rule(start + size(20), row + size(1.2), end)]
    rows = [INSTRUCTIONS_TITLE.upper(), *(f"{i}. {t}" for i, t in enumerate(INSTRUCTIONS, 1))]
    first = [_box(left, y(34), right, y(64)), *(_line("l", left + pad, y(37.5 + 4.7 * i), size(2.2), F.lit(t)) for i, t in enumerate(rows))]
    return F.concat(*parts, F.when(F.col("page_index") == 0, F.concat(*first)).otherwise(F.lit("")))


def _page_foot() -> Column:
    """Which items the page holds and a line for a signature; needs first and last, the numbers of its items."""
    left, right = F.col("margin_mm"), F.col("page_width_mm") - F.col("margin_mm")
    y = F.col("page_height_mm") - F.col("margin_mm") - 2
    options = F.array_join(F.split("option_set", ""), "/")
    items = F.format_string(ITEMS_OF, F.col("first"), F.col("last"), options)
    size = F.lit(2.3)
    return F.concat(_rule(left, y - 6, right), _line("l", left, y - 3.5, size, items), _line("r", right, y - 3.5, size, F.lit(SIGNATURE)), _rule(right - 25, y, right))


def template_svg(layouts: DataFrame, heading: Heading = Heading()) -> DataFrame:
    """(layout_id, page_index, svg): a printable page of each layout: head, marks, bubbles, letters, numbers and foot."""
    f1 = _mm
    radius, side = f1(F.col("bubble_diameter_mm") / 2), F.col("fiducial_size_mm")
    body = printed_items(
        lambda no, left, y: F.concat(F.lit('<text class="no" x="'), f1(left + (F.col("number_gutter_mm") - 1.5)), F.lit('" y="'), f1(y), F.lit('">'), no.cast("string"), F.lit("</text>")),
        f1, f1,
        lambda letter, x, y: F.concat(F.lit('<circle cx="'), x, F.lit('" cy="'), y, F.lit('" r="'), F.col("radius"), F.lit('"/><text x="'), x, F.lit('" y="'), y, F.lit('">'), letter, F.lit("</text>")),
    )
    square = lambda x, y: F.concat(F.lit('<rect x="'), f1(x - side / 2), F.lit('" y="'), f1(y - side / 2), F.lit('" width="'), f1(side), F.lit('" height="'), f1(side), F.lit('"/>'))
    marks = F.array_join(F.array_sort(F.array(*[square(x, y) for x, y in corners().values()])), "")
    size = F.concat(F.lit('width="'), f1(F.col("page_width_mm")), F.lit('mm" height="'), f1(F.col("page_height_mm")), F.lit('mm" viewBox="0 0 '), f1(F.col("page_width_mm")), F.lit(" "), f1(F.col("page_height_mm")), F.lit('"'))
    style = F.lit("<style>circle{fill:none;stroke:#000;stroke-width:.28}text{font:2.2px sans-serif;text-anchor:middle;dominant-baseline:central}.no{text-anchor:end}.l{text-anchor:start}.r{text-anchor:end}path{fill:none;stroke:#000;stroke-width:.3}</style>")
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" '), size, F.lit(">"), style, marks, _page_head(heading), body, _page_foot(), F.lit("</svg>"))
    return printed_pages(layouts).withColumn("radius", radius).select("layout_id", "page_index", svg.alias("svg"))
