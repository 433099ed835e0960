"""Sheets: made from files, typed answers or stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import schemas
from quillmark.functions.scalars import fit_length, normalised_name, parse_answers, sheet_name
from quillmark.operators.scoring import answer_maps

_TYPES = {f.name: f.dataType for f in schemas.SHEETS}


def _sheets(df: DataFrame, **given) -> DataFrame:
    """All columns of a sheet table, null where not given."""
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _TYPES.items()])


def in_file_order(files: DataFrame) -> DataFrame:
    """(sheet_id, sheet_ord, file_name): positions that rise with the file name, with gaps, from a sort by ranges and no single task."""
    rows = files.select("sheet_id", "file_name").orderBy("file_name", "sheet_id")
    return rows.select("sheet_id", F.monotonically_increasing_id().alias("sheet_ord"), "file_name")


def from_files(files: DataFrame, n: int) -> DataFrame:
    """Pending sheets of (sheet_id, sheet_ord, file_name): named after the file, all answers blank."""
    blank = F.array_repeat(F.lit(None).cast("string"), n)
    return _sheets(
        files, sheet_id=F.col("sheet_id"), sheet_ord=F.col("sheet_ord"), file_name=F.col("file_name"), name=sheet_name(F.col("file_name")), status=F.lit("pending"),
        source=F.lit("omr"), page_index=F.lit(0), answers=blank,
    )


def from_typed(typed: DataFrame, n: int, option_set: str) -> DataFrame:
    """Finished sheets of (sheet_id, sheet_ord, name, text); rows with a blank name or without a single answer are left out."""
    answers = parse_answers(F.col("text"), n, option_set)
    out = _sheets(
        typed, sheet_id=F.col("sheet_id"), sheet_ord=F.col("sheet_ord"), name=normalised_name(F.col("name")), status=F.lit("done"), source=F.lit("manual"), page_index=F.lit(0),
        answers=answers,
    )
    return out.where(F.col("name").isNotNull() & F.exists("answers", lambda a: a.isNotNull()))


def from_responses(responses: DataFrame, n: int, by: str = "sheet_ord") -> DataFrame:
    """Finished sheets from long responses (by, item_no, response); of several answers to an item the first by letter counts."""
    wide = answer_maps(responses, n, by)
    answers = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.try_element_at("answers", i))
    return _sheets(
        wide, sheet_id=F.col(by).cast("string"), sheet_ord=F.col(by), name=F.concat(F.lit("PESERTA "), F.col(by).cast("string")), status=F.lit("done"), source=F.lit("manual"),
        page_index=F.lit(0), answers=answers,
    )


def resized(sheets: DataFrame, n: int) -> DataFrame:
    """Answers cut or filled up to ``n`` items."""
    return sheets.withColumn("answers", fit_length("answers", n))


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Stored sheets, as Parquet."""
    return spark.read.schema(schemas.SHEETS).parquet(path)


def read_state(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Stored settings as JSON lines: what is broken or absent is null or empty, the key has ``n`` letters."""
    raw = spark.read.schema(schemas.STATE).option("mode", "PERMISSIVE").json(path)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return raw.select(
        F.coalesce("config", empty).alias("config"), F.coalesce("layout", empty).alias("layout"),
        F.coalesce("omr_options", empty.cast("map<string,double>")).alias("omr_options"),
        fit_length(F.coalesce("answer_key", F.array().cast("array<string>")), n).alias("answer_key"),
    )
