"""Tables that a plan stores for its own use, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; only a local master that names none has one made."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="qm-work-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        root = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again, so that what follows doesn't compute it anew."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
