"""Response and darkness matrices derived from lineitem.

A participant is a supplier, an item one of 30 classes of parts; item 30 has no
key. Both are dense. The SQL versions are what oracles build on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = 30
OPTIONS = "ABCDE"


def _letter(i: Column) -> Column:
    return F.substring(F.lit(OPTIONS), i.cast("int") + 1, F.lit(1))


def key_letter(no: Column) -> Column:
    return F.when(no != ITEMS, _letter((no * 3) % 5))


def key_of(spark: SparkSession) -> DataFrame:
    """(item_no, key)."""
    no = F.col("id").cast("int")
    return spark.range(1, ITEMS + 1, numPartitions=1).select(no.alias("item_no"), key_letter(no).alias("key"))


def r_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet_ord, item_no, q, response)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    item = (F.col("l_partkey") % ITEMS).cast("int") + 1
    base = lines.groupBy(F.col("l_suppkey").alias("sheet_ord"), item.alias("item_no")).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    no, q, ability = F.col("item_no"), F.col("q"), F.col("sheet_ord") % 10
    chance = F.when(no == 29, (ability - 6) * 25).when(no % 7 == 0, 50 - 7 * ability + 5 * (no % 6)).otherwise(10 + 7 * ability + 5 * (no % 6))
    right, other = _letter((no * 3) % 5), _letter((no * 3 + 1 + q % 4) % 5)
    response = F.when((q * 7 + no * 13) % 20 == 0, F.lit(None).cast("string")).when((q * 37 + no * 11) % 100 < chance, right).otherwise(other)
    return base.select("sheet_ord", "item_no", "q", response.alias("response"))


def d_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet_ord, no, option_index, option, fill)."""
    r = r_matrix(spark, sf_dir).withColumnRenamed("item_no", "no")
    o = r.withColumn("option_index", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("option", _letter(F.col("option_index")))
    second = (F.col("q") % 17 == 0) & F.col("response").isNotNull() & (_letter((F.col("no") + 2) % 5) == F.col("option"))
    marked = F.coalesce(F.col("response") == F.col("option"), F.lit(False)) | second
    grain = (F.col("q") * 31 + F.col("no") * 7 + F.col("option_index") * 13) % 10
    fill = F.lit(0.08) + F.when(marked, 0.45).otherwise(0.0) + grain.cast("double") / 200.0
    return o.select("sheet_ord", "no", "option_index", "option", fill.alias("fill"))


R_SQL = """
base as (
  select l_suppkey as sheet_ord, cast(l_partkey % 30 as int) + 1 as no, cast(sum(l_quantity) as bigint) as q from lineitem group by 1, 2
), k as (
  select distinct no, case when no = 30 then null else substr('ABCDE', (no * 3) % 5 + 1, 1) end as key from base
), r as (
  select b.sheet_ord, b.no, b.q, k.key,
    case when (b.q * 7 + b.no * 13) % 20 = 0 then null
         when (b.q * 37 + b.no * 11) % 100 < case when b.no = 29 then ((b.sheet_ord % 10) - 6) * 25 when b.no % 7 = 0 then 50 - 7 * (b.sheet_ord % 10) + 5 * (b.no % 6) else 10 + 7 * (b.sheet_ord % 10) + 5 * (b.no % 6) end
           then substr('ABCDE', (b.no * 3) % 5 + 1, 1)
         else substr('ABCDE', cast((b.no * 3 + 1 + b.q % 4) % 5 as int) + 1, 1) end as response
  from base b join k on b.no = k.no
)"""

D_SQL = (
    R_SQL
    + """, d as (
  select r.sheet_ord, r.no, o.option_index, substr('ABCDE', o.option_index + 1, 1) as option,
    cast(0.08 as double)
    + case when coalesce(r.response = substr('ABCDE', o.option_index + 1, 1), false) or (r.q % 17 = 0 and r.response is not null and substr('ABCDE', cast((r.no + 2) % 5 as int) + 1, 1) = substr('ABCDE', o.option_index + 1, 1))
           then cast(0.45 as double) else cast(0.0 as double) end
    + cast((r.q * 31 + r.no * 7 + o.option_index * 13) % 10 as double) / 200.0 as fill
  from r cross join (select 0 as option_index union all select 1 union all select 2 union all select 3 union all select 4) o
), net as (
  select *, quantile_cont(fill, 0.5) over (partition by sheet_ord) as baseline, fill - quantile_cont(fill, 0.5) over (partition by sheet_ord) as net from d
)"""
)
