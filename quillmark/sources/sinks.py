"""Results as files: CSV, stored sheets and settings, template pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.config import ScoringConfig
from quillmark.functions.scalars import sanitize_filename, slugify
from quillmark.operators.reports import csv_header, csv_lines

BOM = "﻿"


def _head(config: ScoringConfig) -> str:
    return BOM + ",".join('"' + h.replace('"', '""') + '"' for h in csv_header(config))


def csv_text(rows: DataFrame, config: ScoringConfig, safe: bool = False) -> str:
    """The whole CSV of one test's roster as text: BOM, every cell quoted, CRLF between rows and none at the end.

    For a roster that a person opens; ``write_csv`` writes any size.
    """
    lines = [r.line for r in csv_lines(rows, safe).orderBy("row_no").toLocalIterator()]
    return "\r\n".join([_head(config), *lines])


def write_csv(rows: DataFrame, config: ScoringConfig, path: str, safe: bool = False) -> None:
    """The same text as a folder of part files: the header is the first line of the first, and every line ends in CRLF; refuses an empty result."""
    lines = csv_lines(rows, safe).select("row_no", "line")
    if lines.isEmpty():
        raise ValueError("nothing to export")
    head = rows.sparkSession.createDataFrame([(0, _head(config))], "row_no long, line string")
    head.unionByName(lines).orderBy("row_no").select("line").write.option("lineSep", "\r\n").text(path)


def export_name(df: DataFrame, kind: str, title: str, date: str, extension: str) -> DataFrame:
    """``df`` with file_name, such as rekap-<slug of the title>-<date>.csv, made safe."""
    stem = F.concat_ws("-", F.lit(kind), slugify(F.col(title)), F.col(date))
    return df.withColumn("file_name", sanitize_filename(F.concat(stem, F.lit(f".{extension}"))))


def write_sheets(sheets: DataFrame, path: str) -> None:
    """Sheets as Parquet, without image bytes: the file name leads back to the image."""
    sheets.drop("image", "thumb", "data").write.mode("overwrite").parquet(path)


def write_state(state: DataFrame, path: str) -> None:
    """Settings as JSON lines."""
    state.write.mode("overwrite").json(path)


def write_templates(svg: DataFrame, path: str) -> None:
    """One SVG text per page, under a folder for each layout and page."""
    svg.write.partitionBy("layout_id", "page_index").text(path)


def write_document(parts: DataFrame, path: str) -> int:
    """One document of ``pdf.documents`` as a local file, part by part as they stream in; its length in bytes."""
    length = 0
    with open(path, "wb") as f:
        for r in parts.orderBy("part").toLocalIterator():
            length += f.write(r.text.encode("ascii"))
    return length
