"""Scoring of sheets against an answer key.

Two shapes of the same data: one row per sheet with an array of answers, where
scoring is a projection and nothing is shuffled, and one row per response,
where it is one aggregation with partial sums. A key has at most 200 items (a
bound of the printed sheet), so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.config import ScoringConfig
from quillmark.functions.scalars import clamp, fit_length, item_status, raw_score, scaled_score


def key_table(spark: SparkSession, letters: list[str | None]) -> DataFrame:
    """(item_no, key) from letters in order; an empty letter is no key."""
    rows = [(i + 1, c or None) for i, c in enumerate(letters)]
    return spark.createDataFrame(rows, "item_no int, key string")


def validated(settings: DataFrame) -> DataFrame:
    """``settings`` with scale_max within 1 to 1000 and passing_score within 0 to that."""
    top = settings.withColumn("scale_max", clamp(F.col("scale_max"), 1, 1000))
    return top.withColumn("passing_score", F.when(F.col("passing_score").isNotNull(), F.least("scale_max", F.greatest(F.lit(0.0), "passing_score"))))


def key_letters(key: DataFrame, n: int) -> DataFrame:
    """One row (keys array<string>) of ``n`` letters from (item_no, key)."""
    pairs = F.array_sort(F.collect_list(F.struct("item_no", "key")))
    entries = key.where(F.col("item_no").between(1, n)).agg(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["item_no"], x["key"]))).alias("m"))
    return entries.select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.try_element_at("m", i)).alias("keys"))


def _scores(config: ScoringConfig) -> tuple[Column, Column]:
    raw = raw_score(F.col("correct"), F.col("wrong"), config.penalty, len(config.option_set))
    return raw.alias("raw_score"), scaled_score(F.col("raw_score"), F.col("scored_items"), config.scale_max).alias("scaled_score")


def score_responses(responses: DataFrame, key: DataFrame, config: ScoringConfig, by: list[str] | None = None) -> DataFrame:
    """(by..., correct, wrong, blank, scored_items, raw_score, scaled_score) from (by..., item_no, response).

    Items of the key that a sheet has no row for count as blank, so the input
    may be sparse. Items outside 1 to num_questions do not count. A sheet
    without any row does not appear.
    """
    by = by or ["sheet_ord"]
    key = key.where(F.col("item_no").between(1, config.num_questions))
    joined = responses.join(F.broadcast(key.where("key is not null")), "item_no", "left")
    keyed = F.col("key").isNotNull() & F.col("response").isNotNull()
    counted = joined.groupBy(*by).agg(
        F.count_if(keyed & (F.col("response") == F.col("key"))).alias("correct"),
        F.count_if(keyed & (F.col("response") != F.col("key"))).alias("wrong"),
    )
    scored = key.agg(F.count("key").alias("scored_items"))
    out = counted.crossJoin(F.broadcast(scored)).withColumn("blank", F.col("scored_items") - F.col("correct") - F.col("wrong"))
    raw, scaled = _scores(config)
    out = out.withColumn("raw_score", raw).withColumn("scaled_score", scaled)
    return out.select(*by, "correct", "wrong", "blank", "scored_items", "raw_score", "scaled_score")


def score_sheets(sheets: DataFrame, key: DataFrame, config: ScoringConfig) -> DataFrame:
    """``sheets`` with items, correct, wrong, blank, scored_items, raw_score and scaled_score; no shuffle of sheets.

    items: array<struct<no, response, key, status>> of every item, keyed or
    not. Only sheets whose status is done are scored; without a status column
    all are. A null answers array is all blank.
    """
    if "status" in sheets.columns:
        sheets = sheets.where("status = 'done'")
    n = config.num_questions
    with_key = sheets.crossJoin(F.broadcast(key_letters(key, n)))
    answers = fit_length(F.coalesce("answers", F.array().cast("array<string>")), n)
    item = lambda r, i: F.struct(
        (i + 1).alias("no"), r.alias("response"), F.get("keys", i).alias("key"), item_status(F.get("keys", i), r).alias("status")
    )
    out = with_key.withColumn("items", F.transform(answers, item)).drop("keys")
    count = lambda s: F.size(F.filter("items", lambda x: x["status"] == s)).cast("long")
    out = out.withColumns({"correct": count("correct"), "wrong": count("wrong"), "blank": count("blank")})
    raw, scaled = _scores(config)
    return out.withColumn("scored_items", F.col("correct") + F.col("wrong") + F.col("blank")).withColumn("raw_score", raw).withColumn("scaled_score", scaled)


def item_rows(responses: DataFrame, key: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., item_no, response, key, status) of long responses."""
    joined = responses.join(F.broadcast(key), "item_no", "left")
    return joined.select(*(by or ["sheet_ord"]), "item_no", "response", "key", item_status(F.col("key"), F.col("response")).alias("status"))


def responses_of(sheets: DataFrame, n: int) -> DataFrame:
    """(sheet_id, sheet_ord, item_no, response) of items 1 to n, blanks included, from sheets of arrays."""
    answers = fit_length(F.coalesce("answers", F.array().cast("array<string>")), n)
    long = sheets.select("sheet_id", "sheet_ord", F.posexplode(answers).alias("i", "response"))
    return long.select("sheet_id", "sheet_ord", (F.col("i") + 1).alias("item_no"), "response")


def answer_maps(responses: DataFrame, n: int, by: str = "sheet_ord") -> DataFrame:
    """(by, answers map<int, string>): a row per sheet in ``responses``, its answers to items 1 to n that are not null.

    One aggregation; equal rows meet in partial sets. Of several answers to an
    item the first by letter counts.
    """
    known = F.col("item_no").between(1, n) & F.col("response").isNotNull()
    sets = responses.groupBy(by).agg(F.array_sort(F.collect_set(F.when(known, F.struct("item_no", "response")))).alias("pairs"))
    first = F.filter("pairs", lambda x, i: (i == 0) | (F.get("pairs", i - 1)["item_no"] != x["item_no"]))
    return sets.select(by, F.map_from_entries(first).alias("answers"))


def dense(responses: DataFrame, n: int, by: str = "sheet_ord") -> DataFrame:
    """A row for every sheet in ``responses`` and item 1 to n, null where it has no answer."""
    wide = answer_maps(responses, n, by)
    item = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("item_no")
    return wide.select(by, "answers", item).select(by, "item_no", F.try_element_at("answers", F.col("item_no")).alias("response"))


def key_from_sheet(responses: DataFrame, sheet: int, n: int, by: str = "sheet_ord") -> DataFrame:
    """(item_no, key): one sheet's responses as the key, the first n items."""
    return responses.where((F.col(by) == sheet) & F.col("item_no").between(1, n)).select("item_no", F.col("response").alias("key"))


def toggled_key(key: DataFrame, item_no: int, letter: str) -> DataFrame:
    """The key with one item set to a letter, or cleared if it had that letter."""
    new = F.when(F.col("key") == letter, F.lit(None).cast("string")).otherwise(letter)
    return key.withColumn("key", F.when(F.col("item_no") == item_no, new).otherwise(F.col("key")))


def key_string(key: DataFrame) -> DataFrame:
    """One row (key_string): letters in order, a hyphen for each item without a key."""
    pairs = F.array_sort(F.collect_list(F.struct("item_no", "key")))
    return key.agg(F.array_join(F.transform(pairs, lambda x: F.coalesce(x["key"], F.lit("-"))), "").alias("key_string"))


def fill_summary(key: DataFrame) -> DataFrame:
    """One row (filled, items)."""
    return key.agg(F.count("key").alias("filled"), F.count("*").alias("items"))
