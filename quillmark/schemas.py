"""Fixed schemas of stored tables; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

SHEETS = T.StructType(
    [
        T.StructField("sheet_id", T.StringType()),
        T.StructField("sheet_ord", T.LongType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("page_index", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("answers", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("baseline", T.DoubleType()),
        T.StructField("scanned_at", T.TimestampType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("sheet_id", T.StringType()),
        T.StructField("sheet_ord", T.LongType()),
        T.StructField("item_no", T.IntegerType()),
        T.StructField("response", T.StringType()),
    ]
)

ANSWER_KEY = T.StructType([T.StructField("item_no", T.IntegerType()), T.StructField("key", T.StringType())])

BUBBLE = T.StructType(
    [
        T.StructField("no", T.IntegerType()),
        T.StructField("option", T.StringType()),
        T.StructField("option_index", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("x_mm", T.DoubleType()),
        T.StructField("y_mm", T.DoubleType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("radius", T.DoubleType()),
        T.StructField("fill", T.DoubleType()),
    ]
)

#: One row per scanned page: what reading found, or why it failed.
SCAN = T.StructType(
    [
        T.StructField("sheet_id", T.StringType()),
        T.StructField("page_index", T.IntegerType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("threshold", T.IntegerType()),
        T.StructField("alignment", T.DoubleType()),
        T.StructField("homography", T.ArrayType(T.DoubleType())),
        T.StructField("samples", T.ArrayType(BUBBLE)),
    ]
)

#: A whole application state: what a session stores and loads again.
STATE = T.StructType(
    [
        T.StructField("config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("layout", T.MapType(T.StringType(), T.StringType())),
        T.StructField("omr_options", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("answer_key", T.ArrayType(T.StringType())),
    ]
)
