"""PDF files as rows: pages of drawing commands become numbered objects, whose places in the file are running sums of their lengths.

A document is (doc_id, part, text) rows: the head, each object, and at last the
table of places. Only lengths meet by document; a long document stays many rows
and is written part by part. All text is ASCII, so characters are bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.config import Heading, ScoringConfig
from quillmark.functions.formatting import DASH, fmt, thousandths
from quillmark.operators import geometry
from quillmark.operators.reports import class_distribution, in_report_order

POINTS = 72 / 25.4
A4 = (595.276, 841.89)
HEAD = "%PDF-1.4\n"
FONT = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
#: Characters of the font's encoding that have another code in Unicode.
MARKS, CODES = "—–‘’“”•…€", "\x97\x96\x91\x92\x93\x94\x95\x85\x80"
#: Share of the radius at which the handles of a quarter circle stand.
HANDLE = 0.5523

#: Millimetres, and heights of a line of the report in points.
MARGIN = 15 * POINTS
LINE, TITLE = 13.0, 24.0
#: Places at which a roster row's cells begin, in points from the margin.
CELLS = (0, 32, 250, 290, 330, 375, 420)


def number(c: Column | float) -> Column:
    return thousandths(F.lit(c))


def text(x: Column, y: Column, size: Column | float, value: Column) -> Column:
    """A line of text that starts at (x, y); characters that the font lacks are question marks."""
    known = F.regexp_replace(F.translate(F.coalesce(value, F.lit("")), MARKS, CODES), r"[^\x00-\xFF]", "?")
    return F.concat(F.lit("BT /F1 "), number(size), F.lit(" Tf "), number(x), F.lit(" "), number(y), F.lit(" Td <"), F.hex(F.encode(known, "ISO-8859-1")), F.lit("> Tj ET\n"))


def beside(c: Column, r: Column) -> Column:
    """The coordinates of a circle's curves on one axis, as text: its middle, and the handle and the edge on either side."""
    k = r * HANDLE
    return F.struct(*[number(v).alias(name) for name, v in (("o", c), ("k", c + k), ("r", c + r), ("mk", c - k), ("mr", c - r))])


def circle(x: Column, y: Column) -> Column:
    """A circle whose coordinates are ``beside`` its middle."""
    pairs = ["r o m", "r k", "k r", "o r c", "mk r", "mr k", "mr o c", "mr mk", "mk mr", "o mr c", "k mr", "r mk", "r o c"]
    words = [w for p in pairs for w in zip((x, y, None), p.split(), strict=False)]
    return F.concat(*[part for axis, w in words for part in (F.lit(w) if axis is None else axis[w], F.lit(" "))], F.lit("S\n"))


def square(x: Column, y: Column, side: Column) -> Column:
    return F.concat(*[part for c in (x - side / 2, y - side / 2, side, side) for part in (number(c), F.lit(" "))], F.lit("re f\n"))


def documents(pages: DataFrame) -> DataFrame:
    """(doc_id, part, text) of the files of ``pages`` (doc_id, page from 0 on, width, height, commands); sides in points.

    Objects: 1 the catalogue, 2 the list of pages, 3 the font, then each page
    and its commands. Parts are in the order of the file; joined without
    anything between them they are the file.
    """
    number_of = lambda k: F.col("page") * 2 + k
    page = F.concat(F.lit("<< /Type /Page /Parent 2 0 R /MediaBox [0 0 "), number(F.col("width")), F.lit(" "), number(F.col("height")), F.lit("] /Resources << /Font << /F1 3 0 R >> >> /Contents "), number_of(5).cast("string"), F.lit(" 0 R >>"))
    stream = F.concat(F.lit("<< /Length "), F.length("commands").cast("string"), F.lit(" >>\nstream\n"), F.col("commands"), F.lit("\nendstream"))
    two = F.array(F.struct(number_of(4).cast("long").alias("part"), page.alias("body")), F.struct(number_of(5).cast("long").alias("part"), stream.alias("body")))
    own = pages.select("doc_id", F.inline(two))
    docs = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    kids = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.concat((i * 2 + 4).cast("string"), F.lit(" 0 R"))), " ")
    listed = F.concat(F.lit("<< /Type /Pages /Kids ["), kids, F.lit("] /Count "), F.col("n").cast("string"), F.lit(" >>"))
    three = F.array(*[F.struct(F.lit(i).cast("long").alias("part"), b.alias("body")) for i, b in ((1, F.lit("<< /Type /Catalog /Pages 2 0 R >>")), (2, listed), (3, F.lit(FONT)))])
    objects = own.unionByName(docs.select("doc_id", F.inline(three)))
    objects = objects.select("doc_id", "part", F.concat(F.col("part").cast("string"), F.lit(" 0 obj\n"), F.col("body"), F.lit("\nendobj\n")).alias("text"))
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = objects.select("doc_id", "part", F.length("text").alias("length")).withColumn("at", F.coalesce(F.sum("length").over(before), F.lit(0)) + len(HEAD))
    entry = F.format_string("%010d 00000 n \n", "at")
    tables = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", entry.alias("entry")))).alias("entries"), F.max(F.col("at") + F.col("length")).alias("end"), F.count("*").alias("n"))
    count = (F.col("n") + 1).cast("string")
    table = F.concat(F.lit("xref\n0 "), count, F.lit("\n0000000000 65535 f \n"), F.array_join(F.transform("entries", lambda e: e["entry"]), ""), F.lit("trailer\n<< /Size "), count, F.lit(" /Root 1 0 R >>\nstartxref\n"), F.col("end").cast("string"), F.lit("\n%%EOF\n"))
    ends = tables.select("doc_id", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("part"), F.lit(HEAD).alias("text")), F.struct((F.col("n") + 1).alias("part"), table.alias("text")))))
    return objects.unionByName(ends)


def whole(parts: DataFrame) -> DataFrame:
    """(doc_id, file binary): documents of few pages, each in one row."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
    return parts.groupBy("doc_id").agg(F.array_join(rows, "").cast("binary").alias("file"))


def template_pages(layouts: DataFrame, heading: Heading = Heading()) -> DataFrame:
    """``documents`` input: the printed sheet of each layout (doc_id is its layout_id): marks, head, numbers, bubbles and letters, foot."""
    across = lambda c: F.col(c) * POINTS
    up = lambda y: (F.col("page_height_mm") - y) * POINTS
    radius = F.col("bubble_diameter_mm") * POINTS / 2
    place = lambda c, less: F.struct(beside(c, radius).alias("ring"), number(c - less).alias("letter"))
    body = geometry.printed_items(
        lambda no, left, y: text(left * POINTS, up(y) - 2.5, 7, no.cast("string")),
        lambda y: place(up(y), 2), lambda x: place(x * POINTS, 2),
        lambda letter, x, y: F.concat(circle(x["ring"], y["ring"]), F.lit("BT /F1 6.000 Tf "), x["letter"], F.lit(" "), y["letter"], F.lit(" Td <"), F.hex(letter), F.lit("> Tj ET\n")),
    )
    marks = F.array_join(F.array_sort(F.array(*[square(x * POINTS, up(y), across("fiducial_size_mm")) for x, y in geometry.corners().values()])), "")
    left, top, middle = across("margin_mm"), (F.col("page_height_mm") - F.col("margin_mm")) * POINTS, across("page_width_mm") / 2
    title = " — ".join(t for t in (heading.test_name, heading.instrument) if t)
    lines = [
        text(left, top - 8, 9, F.upper(F.lit(heading.institution or geometry.NO_INSTITUTION))), text(middle, top - 8, 8, F.upper(F.lit(geometry.SHEET_TITLE))), text(left, top - 19, 7, F.lit(heading.unit)),
        text(middle, top - 19, 7, F.format_string(geometry.PAGE_OF, F.col("page_index") + 1, F.col("page_count"))), text(left, top - 32, 8, F.upper(F.lit(title))),
        *[text(left + (i % 2) * (middle - left), top - 46 - 12 * (i // 2), 7, F.lit(f"{label}: ______________________________")) for i, label in enumerate(geometry.NAME_BOX)],
    ]
    rows = [geometry.INSTRUCTIONS_TITLE.upper(), *(f"{i}. {t}" for i, t in enumerate(geometry.INSTRUCTIONS, 1))]
    first = [text(left, top - 76 - 9 * i, 6, F.lit(t)) for i, t in enumerate(rows)]
    foot = F.format_string(geometry.ITEMS_OF, F.col("first"), F.col("last"), F.array_join(F.split("option_set", ""), "/"))
    bottom = across("margin_mm") + 4
    commands = F.concat(F.lit("0.6 w\n"), marks, *lines, F.when(F.col("page_index") == 0, F.concat(*first)).otherwise(F.lit("")), body, text(left, bottom, 7, foot), text(middle, bottom, 7, F.lit(geometry.SIGNATURE)))
    return geometry.printed_pages(layouts).select(
        F.col("layout_id").alias("doc_id"), F.col("page_index").cast("long").alias("page"), across("page_width_mm").alias("width"), across("page_height_mm").alias("height"), commands.alias("commands")
    )


def report_pages(normed: DataFrame, stats: DataFrame, sentences: DataFrame, config: ScoringConfig, title: str, doc_id: str = "report") -> DataFrame:
    """``documents`` input: the report of a test: title, figures, classes, sentences, then the whole roster, on A4 pages.

    ``normed`` are participants, ``stats`` one row of ``norms.descriptive_stats``,
    ``sentences`` one of ``reports.report_sentences``. A line's place on the long
    sheet is the sum of the heights before it, for a roster row by its number, so
    no task holds the roster; the sheet is cut so that no line is.
    """
    label = lambda name, c, digits=2: F.concat(F.lit(f"{name}: "), fmt(F.col(c), digits))
    block = lambda order, height, value: F.struct(F.lit(order).alias("i"), F.lit(height).alias("height"), value.alias("value"))
    cells = [label("N", "n", 0), label("Mean", "mean"), label("SD", "sd"), label("Min", "min"), label("Max", "max"), label("Median", "median"), label("Rentang", "range"), F.lit(f"Batas lulus: {config.passing_score:g}")]
    head = stats.select(F.inline(F.array(block(0, TITLE, F.lit(title)), block(1, LINE, F.concat_ws("   ", *cells)))))
    head = head.unionByName(class_distribution(normed).select((F.col("class_rank") + 1).alias("i"), F.lit(LINE).alias("height"), F.concat(F.col("classification"), F.lit(": "), F.col("count").cast("string"), F.lit(" ("), fmt(F.col("percent"), 1), F.lit(" %)")).alias("value")))
    head = head.unionByName(sentences.select(F.inline(F.array(*[block(20 + i, LINE, F.col(c)) for i, c in enumerate(("reliability_sentence", "norm_sentence", "note"))]))))
    head = head.unionByName(stats.select(F.inline(F.array(block(30, TITLE, F.lit("Peserta"))))))
    # A few lines: title, figures, at most seven classes, sentences.
    start = F.coalesce(F.sum("height").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    head = head.withColumn("start", start)
    rows = in_report_order(normed).crossJoin(F.broadcast(head.agg(F.sum("height").alias("top"))))
    values = [F.col("row_no").cast("string"), F.col("name"), F.col("correct").cast("string"), fmt(F.col("scaled_score"), 1), fmt(F.col("z_score"), 2), fmt(F.col("percentile"), 1), F.coalesce("classification", F.lit(DASH))]
    rows = rows.select(F.col("row_no").alias("order"), (F.col("top") + (F.col("row_no") - 1) * LINE).alias("start"), F.array(*values).alias("values"))
    usable = A4[1] - 2 * MARGIN - TITLE
    lines = head.select(F.col("i").cast("long").alias("order"), "start", F.array("value").alias("values"), (F.col("height") == TITLE).alias("large"), F.lit(0).alias("kind"))
    lines = lines.unionByName(rows.select("order", "start", "values", F.lit(False).alias("large"), F.lit(1).alias("kind"))).withColumn("page", F.floor(F.col("start") / usable).cast("long"))
    y = A4[1] - MARGIN - LINE - (F.col("start") - F.col("page") * usable)
    size = F.when(F.col("large"), 14.0).otherwise(8.0)
    at = F.array(*[F.lit(float(c)) for c in CELLS])
    drawn = F.array_join(F.transform("values", lambda v, i: text(F.lit(MARGIN) + F.get(at, i), y, size, v)), "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "order", drawn.alias("c")))), lambda x: x["c"]), "")
    return lines.groupBy("page").agg(joined.alias("commands")).select(F.lit(doc_id).alias("doc_id"), "page", F.lit(A4[0]).alias("width"), F.lit(A4[1]).alias("height"), "commands")
