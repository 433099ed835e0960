"""Descriptive statistics and norms of a group of participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.config import ScoringConfig
from quillmark.functions.scalars import clamp, classify, normal_cdf


def sample_sd(c: str | Column) -> Column:
    """Sample standard deviation; 0 of one value, null of none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))


def descriptive_stats(df: DataFrame, c: str) -> DataFrame:
    """One row (n, mean, sd, min, max, median, range) of the values of ``c`` that are not null or NaN.

    n is 0 and the rest null where there is none. The exact median counts
    distinct values: scores have few.
    """
    v = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.select(v.alias("v")).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), sample_sd("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.percentile("v", 0.5).alias("median"), (F.max("v") - F.min("v")).alias("range"),
    )


def norm_basis(graded: DataFrame, config: ScoringConfig) -> DataFrame:
    """One row (norm_mean, norm_sd, norm_mode); a standard deviation that is not above 0 is null."""
    if config.norm_mode == "manual":
        sd = float(config.norm_sd) if config.norm_sd > 0 else None
        return graded.sparkSession.createDataFrame([(float(config.norm_mean), sd, "manual")], "norm_mean double, norm_sd double, norm_mode string")
    stats = graded.agg(F.avg("raw_score").alias("norm_mean"), sample_sd("raw_score").alias("sd"))
    return stats.select("norm_mean", F.when(F.col("sd") > 0, F.col("sd")).alias("norm_sd"), F.lit("sample").alias("norm_mode"))


def with_norms(graded: DataFrame, config: ScoringConfig) -> DataFrame:
    """``graded`` with z_score, deviation_iq, t_score, percentile and classification.

    The basis is one row, so it is broadcast. All five are null where the
    spread is zero or unknown.
    """
    joined = graded.crossJoin(F.broadcast(norm_basis(graded, config)))
    z = F.try_divide(F.col("raw_score") - F.col("norm_mean"), F.col("norm_sd"))
    out = joined.withColumn("z_score", z)
    out = out.withColumns(
        {"deviation_iq": 100 + 15 * F.col("z_score"), "t_score": 50 + 10 * F.col("z_score"), "percentile": clamp(normal_cdf(F.col("z_score")) * 100, 0.1, 99.9)}
    )
    return out.withColumn("classification", classify(F.col("deviation_iq"))).drop("norm_mean", "norm_sd", "norm_mode")
