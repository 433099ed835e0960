"""Reading pages as they land: the batch queue as Structured Streaming.

There is no event time: a page is read once, when its file appears. Stages are
the functions that batches use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark import schemas
from quillmark.config import Layout, OmrOptions, ScoringConfig
from quillmark.operators.decisions import decide_scans
from quillmark.operators.scanning import scanned
from quillmark.operators.scoring import score_sheets
from quillmark.sources.images import image_rows

_IMAGE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def landing_images(spark: SparkSession, folder: str, per_trigger: int = 64) -> DataFrame:
    """Stream of the image files in ``folder``, with the columns of ``read_images``."""
    raw = spark.readStream.format("image").schema(_IMAGE).option("maxFilesPerTrigger", per_trigger).load(folder)
    return image_rows(raw)


def read_landing(spark: SparkSession, folder: str, out: str, checkpoint: str, layout: Layout, options: OmrOptions = OmrOptions()) -> StreamingQuery:
    """Read every page in ``folder`` that was not read before and append its scan to ``out``; stops when none is left."""
    scans = decide_scans(scanned(landing_images(spark, folder), layout, options), options)
    return scans.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landing_sheets(spark: SparkSession, folder: str, per_trigger: int = 64) -> DataFrame:
    """Stream of stored sheets (Parquet files of schemas.SHEETS)."""
    return spark.readStream.schema(schemas.SHEETS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def score_landing(spark: SparkSession, folder: str, key: DataFrame, config: ScoringConfig, out: str, checkpoint: str) -> StreamingQuery:
    """Score finished sheets as their files land and append them to ``out``: a projection, so no state is kept."""
    scored = score_sheets(landing_sheets(spark, folder), key, config)
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_tally(sheets: DataFrame) -> DataFrame:
    """(status, count) of a stream of sheets so far; state is one row per status."""
    return sheets.groupBy("status").agg(F.count("*").alias("count"))
