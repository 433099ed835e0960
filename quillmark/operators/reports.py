"""What a report shows: rosters, classes, histogram, pass and verification counts, sentences, CSV rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.config import ScoringConfig
from quillmark.functions.formatting import DASH, fmt
from quillmark.functions.scalars import CLASSES, answer_pattern, trimmed
from quillmark.operators.ranking import SortKey, numbered, placed

BINS = 8
#: Caution that every report carries.
NOTE = "Norm-based scores describe standing relative to the chosen comparison group and are not standardised IQ scores."


def class_distribution(normed: DataFrame) -> DataFrame:
    """(class_rank, classification, count, percent) of the classes that occur, best first; percent is of all rows.

    A class row each and one count: at most seven rows are joined.
    """
    spark = normed.sparkSession
    names = spark.createDataFrame([(i + 1, label) for i, (_, label) in enumerate(CLASSES)], "class_rank int, label string")
    counts = normed.groupBy("classification").agg(F.count("*").alias("count"))
    counts = counts.withColumn("all", F.sum("count").over(Window.partitionBy()))
    out = counts.join(F.broadcast(names), F.col("classification") == F.col("label"))
    return out.select("class_rank", "classification", "count", (F.col("count") * 100.0 / F.col("all")).alias("percent"))


def pass_count(graded: DataFrame, config: ScoringConfig) -> DataFrame:
    """One row (passed, n, share)."""
    passed = F.count_if(F.col("scaled_score") >= F.lit(float(config.passing_score)))
    return graded.agg(passed.alias("passed"), F.count("*").alias("n")).withColumn("share", F.try_divide("passed", "n"))


def needs_verification(graded: DataFrame, config: ScoringConfig) -> DataFrame:
    """One row (needs_verification, n): sheets with more than half the items blank."""
    return graded.agg(F.count_if(F.col("blank") > F.lit(config.num_questions / 2)).alias("needs_verification"), F.count("*").alias("n"))


def score_histogram(graded: DataFrame, config: ScoringConfig) -> DataFrame:
    """(bin, low, high, count, peak) of all 8 bins over 0 to scale_max, the last one closed; values outside count nowhere."""
    width = float(config.scale_max) / BINS
    v = F.col("scaled_score")
    inside = graded.where((v >= 0) & (v <= F.lit(float(config.scale_max))) & ~F.isnan(v))
    number = F.least(F.floor(v / F.lit(width)) + 1, F.lit(BINS)).cast("int")
    counts = inside.groupBy(number.alias("bin")).agg(F.count("*").alias("count"))
    bins = graded.sparkSession.range(1, BINS + 1).select(F.col("id").cast("int").alias("bin"))
    out = bins.join(F.broadcast(counts), "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    out = out.withColumn("peak", F.greatest(F.lit(1), F.max("count").over(Window.partitionBy())))
    return out.select("bin", ((F.col("bin") - 1) * width).alias("low"), (F.col("bin") * width).alias("high"), "count", "peak")


def searched(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose name contains the query anywhere, in any case; an empty query keeps all with a name."""
    return rows.where(F.contains(F.lower("name"), F.lower(trimmed(F.lit(query)))))


#: Column names of the CSV; the seventh takes the top of the scale.
CSV_COLUMNS = ("No", "Nama", "Benar", "Salah", "Kosong", "Skor Mentah", "Nilai (0-{top})", "Z", "T", "Skor Deviasi", "Persentil", "Klasifikasi", "Pola Jawaban")
#: Sentences of the report.
KNOWN = "Estimasi konsistensi internal melalui KR-20 sebesar %s tergolong %s pada sampel berukuran %s peserta"
UNKNOWN = "Koefisien konsistensi internal KR-20 belum dapat diestimasi karena variansi skor total pada sampel berukuran %s peserta belum memadai"
MANUAL_BASIS = "parameter normatif yang ditetapkan pemeriksa"
SAMPLE_BASIS = "norma lokal yang diturunkan dari sampel pemeriksaan ini"
MOMENTS = "%s (M = %s; SD = %s)"

#: How each column of the roster sorts: missing values come last when falling, first when rising.
SORT_KEYS = ("name", "correct", "wrong", "blank", "raw_score", "scaled_score", "z_score", "deviation_iq", "percentile", "classification")


def _sort_columns(key: str, ascending: bool) -> list[Column]:
    if key not in SORT_KEYS:
        raise ValueError(f"no such sort key: {key}")
    c = F.col(key)
    if key == "name":
        c = F.collate(c, "id")
    elif key == "classification":
        c = F.coalesce(F.col("deviation_iq"), F.lit(0.0))
    return [c.asc_nulls_first() if ascending else c.desc_nulls_last(), F.col("sheet_ord").asc()]


def roster(rows: DataFrame, query: str = "", key: str = "scaled_score", ascending: bool | None = None) -> DataFrame:
    """Searched and sorted rows; a new key sorts falling, except names."""
    found = searched(rows, query) if query else rows
    return found.orderBy(*_sort_columns(key, key == "name" if ascending is None else ascending))


def roster_page(rows: DataFrame, limit: int, query: str = "", key: str = "scaled_score", ascending: bool | None = None) -> DataFrame:
    """The first ``limit`` rows of the roster with their number (row_no). Only that many are sorted in the end."""
    rising = key == "name" if ascending is None else ascending
    first = roster(rows, query, key, rising).limit(limit)
    return first.withColumn("row_no", F.row_number().over(Window.orderBy(*_sort_columns(key, rising))).cast("long"))


def _sort_keys(rows: DataFrame, key: str, ascending: bool | None) -> tuple[DataFrame, list[SortKey]]:
    """``rows`` with the values that its columns sort by."""
    if key not in SORT_KEYS:
        raise ValueError(f"no such sort key: {key}")
    rising = key == "name" if ascending is None else ascending
    by = F.collate("name", "id") if key == "name" else F.coalesce("deviation_iq", F.lit(0.0)) if key == "classification" else F.col(key)
    return rows.withColumn("_qm_by", by), [("_qm_by", not rising), ("sheet_ord", False)]


def numbered_roster(rows: DataFrame, query: str = "", key: str = "scaled_score", ascending: bool | None = None) -> DataFrame:
    """Searched rows with row_no, their number in the whole roster sorted by ``key``; no task sorts them all.

    ``rows`` are read three times: store them first.
    """
    found, keys = _sort_keys(searched(rows, query) if query else rows, key, ascending)
    return placed(found, keys, "row_no").drop("_qm_by")


def roster_at(rows: DataFrame, page: int, size: int, query: str = "", key: str = "scaled_score", ascending: bool | None = None) -> DataFrame:
    """Page ``page``, from 1 on, of ``size`` rows of the numbered roster."""
    last = page * size
    return numbered_roster(rows, query, key, ascending).where(F.col("row_no").between(last - size + 1, last))


def run_tally(pages: DataFrame) -> DataFrame:
    """One row (pages, passed, failed_safely, failed_silently, rejection_rate) of pages (ok, accuracy, floor).

    A page that was not read fails safely, one that was read below the accuracy
    asked of it silently.
    """
    ok = F.coalesce("ok", F.lit(False))
    good = F.coalesce(F.col("accuracy") >= F.col("floor"), F.lit(False))
    out = pages.agg(F.count("*").alias("pages"), F.count_if(ok & good).alias("passed"), F.count_if(~ok).alias("failed_safely"), F.count_if(ok & ~good).alias("failed_silently"))
    return out.withColumn("rejection_rate", F.try_divide("failed_safely", "pages"))


def in_report_order(rows: DataFrame) -> DataFrame:
    """Rows with row_no, their number in input order."""
    return numbered(rows, None, "sheet_ord", "row_no")


def overlay(samples: DataFrame, fill_threshold: float) -> DataFrame:
    """Bubble samples with overlay_marked: dark enough by itself, whatever the other options are."""
    return samples.withColumn("overlay_marked", F.col("net") >= F.lit(fill_threshold))


def report_sentences(spark_row: DataFrame) -> DataFrame:
    """(reliability_sentence, norm_sentence, note) from one row (n, kr20, interpretation, norm_mean, norm_sd, norm_mode)."""
    of = lambda c, d: fmt(F.col(c), d)
    n = F.col("n").cast("string")
    reliability = F.when(F.col("kr20").isNotNull(), F.format_string(KNOWN, of("kr20", 3), "interpretation", n)).otherwise(F.format_string(UNKNOWN, n))
    source = F.when(F.col("norm_mode") == "manual", MANUAL_BASIS).otherwise(SAMPLE_BASIS)
    basis = F.format_string(MOMENTS, source, of("norm_mean", 2), of("norm_sd", 2))
    return spark_row.select(reliability.alias("reliability_sentence"), basis.alias("norm_sentence"), F.lit(NOTE).alias("note"))


def csv_header(config: ScoringConfig) -> list[str]:
    top = int(config.scale_max) if float(config.scale_max).is_integer() else config.scale_max
    return [c.format(top=top) for c in CSV_COLUMNS]


def csv_lines(rows: DataFrame, safe: bool = False) -> DataFrame:
    """(row_no, line): the CSV text of each row without its line end, numbered in input order.

    ``rows`` are normed sheets with their items. Every cell is quoted. ``safe``
    puts an apostrophe before names that a spreadsheet would take for a formula.
    """
    name = F.col("name")
    if safe:
        name = F.when(name.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), name)).otherwise(name)
    cells = [
        F.col("row_no").cast("string"), name, F.col("correct").cast("string"), F.col("wrong").cast("string"), F.col("blank").cast("string"),
        fmt(F.col("raw_score"), 2), fmt(F.col("scaled_score"), 1), fmt(F.col("z_score"), 2), fmt(F.col("t_score"), 1), fmt(F.col("deviation_iq"), 0),
        fmt(F.col("percentile"), 1), F.coalesce("classification", F.lit(DASH)), answer_pattern(F.transform("items", lambda i: i["response"])),
    ]
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells]
    return in_report_order(rows).select("row_no", F.concat_ws(",", *quoted).alias("line"))


def outcome_counts(sheets: DataFrame) -> DataFrame:
    """(status, count): how a batch of reading went."""
    return sheets.groupBy("status").agg(F.count("*").alias("count"))


def appendix(scored: DataFrame) -> DataFrame:
    """(sheet_ord, name, item_no, response, key, status): the per-person detail of a report."""
    return scored.select("sheet_ord", "name", F.explode("items").alias("i")).select("sheet_ord", "name", F.col("i.no").alias("item_no"), "i.response", "i.key", "i.status")


def report(spark: SparkSession, normed: DataFrame, stats: DataFrame, reliability: DataFrame, basis: DataFrame, config: ScoringConfig) -> dict[str, DataFrame]:
    """The report's tables by name; the appendix needs the items of ``normed``."""
    from quillmark.operators.norms import descriptive_stats

    one = normed.agg(F.count("*").alias("n")).crossJoin(reliability).crossJoin(basis)
    return {
        "descriptive": descriptive_stats(normed, "scaled_score"),
        "passed": pass_count(normed, config),
        "roster": in_report_order(normed),
        "classes": class_distribution(normed),
        "items": stats,
        "method": report_sentences(one),
        **({"appendix": appendix(normed)} if "items" in normed.columns else {}),
    }
