"""Participants that stand on several sheets: merging by name, and edits of what they own.

Membership is a table, not an array, and answers merge by aggregates with
partial sums. Sheets find the first of their name in a join that copies names'
rows ``SALT`` times, so a name on very many sheets stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.scalars import merge_key, normalised_name


SALT = 16


def memberships(sheets: DataFrame, merge: bool = True) -> DataFrame:
    """(participant_id, sheet_id, sheet_ord): each sheet's participant, the first sheet of its name; itself without ``merge``."""
    if not merge:
        return sheets.select(F.col("sheet_id").cast("string").alias("participant_id"), "sheet_id", "sheet_ord")
    keyed = sheets.select("sheet_id", "sheet_ord", merge_key(F.col("name"), F.col("sheet_id")).alias("_qm_key"))
    first = keyed.groupBy("_qm_key").agg(F.min_by(F.col("sheet_id").cast("string"), "sheet_ord").alias("participant_id"))
    dealt = keyed.withColumn("_qm_salt", F.pmod(F.xxhash64("sheet_id"), F.lit(SALT)).cast("int"))
    copies = first.withColumn("_qm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return dealt.join(copies, ["_qm_key", "_qm_salt"]).select("participant_id", "sheet_id", "sheet_ord")


def appended(sheets: DataFrame, more: DataFrame) -> DataFrame:
    """``sheets`` and behind them the rows of ``more``, whose positions go on from the last; absent columns are null."""
    last = sheets.agg(F.coalesce(F.max("sheet_ord") + 1, F.lit(0).cast("long")).alias("_qm_last"))
    behind = more.crossJoin(F.broadcast(last)).withColumn("sheet_ord", F.col("sheet_ord") + F.col("_qm_last")).drop("_qm_last")
    return sheets.unionByName(behind, allowMissingColumns=True)


def merged_participants(sheets: DataFrame) -> DataFrame:
    """(participant_id, sheet_ord, name, n_sheets): one row per merge key, described by its first sheet."""
    keyed = sheets.withColumn("_qm_key", merge_key(F.col("name"), F.col("sheet_id")))
    first = F.min_by(F.struct(F.col("sheet_id").cast("string").alias("id"), "name"), F.col("sheet_ord"))
    out = keyed.groupBy("_qm_key").agg(first.alias("f"), F.min("sheet_ord").alias("sheet_ord"), F.count("*").alias("n_sheets"))
    return out.select(F.col("f.id").alias("participant_id"), "sheet_ord", F.col("f.name").alias("name"), "n_sheets")


def merged_responses(responses: DataFrame, members: DataFrame) -> DataFrame:
    """(participant_id, item_no, response, conflict) from (sheet_id, item_no, response) and memberships.

    The response is the first that is not null in sheet order; conflict tells
    whether the sheets hold different ones.
    """
    joined = responses.select("sheet_id", "item_no", "response").join(members, "sheet_id")
    some = F.col("response").isNotNull()
    return joined.groupBy("participant_id", "item_no").agg(
        F.min_by("response", F.when(some, F.col("sheet_ord"))).alias("response"),
        F.coalesce(F.min("response") != F.max("response"), F.lit(False)).alias("conflict"),
    )


def conflict_counts(merged: DataFrame) -> DataFrame:
    """(participant_id, conflict_count) of every participant."""
    return merged.groupBy("participant_id").agg(F.count_if("conflict").alias("conflict_count"))


def sheets_of(members: DataFrame, participant_id: str) -> DataFrame:
    """(sheet_id) of one participant; a sheet that has no membership row stands for itself."""
    return members.where(F.col("participant_id") == participant_id).select("sheet_id")


def _mine(sheets: DataFrame, members: DataFrame, participant_id: str) -> DataFrame:
    """``sheets`` with _qm_mine, true on the participant's sheets."""
    own = sheets_of(members, participant_id).select(F.col("sheet_id").alias("_qm_id"), F.lit(True).alias("_qm_hit")).distinct()
    joined = sheets.join(own, F.col("sheet_id") == F.col("_qm_id"), "left").drop("_qm_id")
    return joined.withColumn("_qm_mine", F.coalesce("_qm_hit", F.col("sheet_id").cast("string") == participant_id)).drop("_qm_hit")


def renamed(sheets: DataFrame, members: DataFrame, participant_id: str, name: str) -> DataFrame:
    """All sheets of a participant get the name, trimmed and in capitals; a blank name changes nothing."""
    new = normalised_name(F.lit(name))
    named = F.coalesce(F.when(F.col("_qm_mine"), new), F.col("name"))
    return _mine(sheets, members, participant_id).withColumn("name", named).drop("_qm_mine")


def removed(sheets: DataFrame, members: DataFrame, participant_id: str) -> DataFrame:
    """Without all sheets of a participant."""
    return sheets.where(F.col("sheet_id").cast("string") != participant_id).join(sheets_of(members, participant_id), "sheet_id", "left_anti")


def cleared(sheets: DataFrame) -> DataFrame:
    """No sheet, the same columns."""
    return sheets.limit(0)


def edited(responses: DataFrame, members: DataFrame, participant_id: str, item_no: int, letter: str) -> DataFrame:
    """(sheet_id, item_no, response): one item of a participant set to a letter, or cleared if it had that letter.

    It is compared with the merged response, so one edit is enough whichever
    sheet holds it. The participant's own sheet takes the new value, its other
    sheets become blank there.
    """
    own = responses.where(F.col("item_no") == item_no)
    now = merged_responses(own, members.where(F.col("participant_id") == participant_id)).select(F.col("response").alias("_qm_now"))
    now = now.agg(F.max("_qm_now").alias("_qm_now"))
    joined = _mine(responses, members, participant_id).crossJoin(F.broadcast(now))
    toggled = F.when(F.col("_qm_now") == letter, F.lit(None).cast("string")).otherwise(F.lit(letter))
    new = F.when(F.col("sheet_id").cast("string") == participant_id, toggled)
    hit = F.col("_qm_mine") & (F.col("item_no") == item_no)
    return joined.select("sheet_id", "item_no", F.when(hit, new).otherwise(F.col("response")).alias("response"))


def with_page_index(sheets: DataFrame, sheet_id: str, page_index: int) -> DataFrame:
    hit = F.col("sheet_id").cast("string") == sheet_id
    return sheets.withColumn("page_index", F.when(hit, F.lit(page_index)).otherwise(F.col("page_index")))


def updated(sheets: DataFrame, changes: DataFrame, nulls: bool = False) -> DataFrame:
    """Columns that ``changes`` has (besides sheet_id) replace those of the same sheet; a null changes nothing, or with ``nulls`` is written."""
    cols = [c for c in changes.columns if c != "sheet_id"]
    new = changes.select(F.col("sheet_id").alias("_qm_id"), *[F.col(c).alias(f"_qm_new_{c}") for c in cols])
    joined = sheets.join(new, F.col("sheet_id") == F.col("_qm_id"), "left")
    hit = F.col("_qm_id").isNotNull()
    return joined.withColumns({c: F.when(hit, F.col(f"_qm_new_{c}")).otherwise(F.col(c)) if nulls else F.coalesce(f"_qm_new_{c}", c) for c in cols}).select(*sheets.columns)


def with_detection(previous: DataFrame, detected: DataFrame, n: int) -> DataFrame:
    """(sheet_id, item_no, response): detected responses, null ones too, over those that were there; items outside 1 to n do not count."""
    inside = F.col("item_no").between(1, n)
    d = detected.where(inside).select("sheet_id", "item_no", F.struct("response").alias("_qm_d"))
    joined = previous.where(inside).join(d, ["sheet_id", "item_no"], "full")
    return joined.select("sheet_id", "item_no", F.when(F.col("_qm_d").isNotNull(), F.col("_qm_d.response")).otherwise(F.col("response")).alias("response"))


def pending(sheets: DataFrame, stalled: Column | None = None) -> DataFrame:
    """Sheets that wait to be read: pending, failed, and those that ``stalled`` says were abandoned while processing."""
    waiting = F.col("status").isin("pending", "error")
    return sheets.where(waiting if stalled is None else waiting | (F.col("status") == "processing") & stalled)
