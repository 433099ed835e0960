"""Edits as a log: answers set, toggled and cleared, sheets renamed, paged, removed, appended, all cleared.

What an edit does to one answer is a function of what stood there: set and
clear forget it, a toggle clears the letter that it finds and sets any other.
One after another such functions are again one, of the same form: what becomes
of one letter, and what of anything else. So a cell's edits fold in any
grouping, in pieces and in parallel, and a log of any length is applied in one
pass. Of a sheet's own fields the last edit counts.

A log is (seq long, kind string, target string, item_no int, value string); seq
is unique and tells the order. Kinds: set (value is a letter), toggle, clear;
rename, page, remove; append (value is the name of a new sheet, or one that
comes back blank); clear_all (every sheet of before is gone). Targets are
participants: an edit of an answer is that of the merged answer, which the
participant's own sheet then holds alone. A target that is no participant and no
appended sheet changes nothing, and null kinds, targets or items neither.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.scalars import normalised_name
from quillmark.operators import merging

CELL_KINDS = ("set", "toggle", "clear")
SHEET_KINDS = ("rename", "page", "remove", "append")
#: Edits of one cell that fold at a time.
FOLD = 4096

#: What keeps a table that is read several times, under a name.
Keep = Callable[[DataFrame, str], DataFrame]


def _anew(df: DataFrame, name: str) -> DataFrame:
    """Keeps nothing: each use computes the table."""
    return df


def effects(log: DataFrame) -> DataFrame:
    """(target, item_no, seq, x, found, other): what the log's edits do to a cell: ``found`` where it holds x, else ``other``."""
    cells = log.where(F.col("kind").isin(*CELL_KINDS) & F.col("target").isNotNull() & F.col("item_no").isNotNull())
    toggles = F.col("kind") == "toggle"
    nothing = F.lit(None).cast("string")
    new = F.when(F.col("kind") == "clear", nothing).otherwise(F.nullif("value", F.lit("")))
    return cells.select("target", F.col("item_no").cast("int").alias("item_no"), "seq", F.when(toggles, F.nullif("value", F.lit(""))).alias("x"), nothing.alias("found"), new.alias("other"))


def after(f: Column, value: Column) -> Column:
    """What the effect ``f`` makes of a value; an effect without x makes the same of all."""
    return F.when(f["x"].isNotNull() & value.eqNullSafe(f["x"]), f["found"]).otherwise(f["other"])


def _fold(fs: Column) -> Column:
    """One effect of an array of effects in order."""
    shape = lambda x, found, other: F.struct(x.alias("x"), found.alias("found"), other.alias("other"))
    first = F.get(fs, F.lit(0))
    start = shape(first["x"], first["found"], first["other"])
    return F.aggregate(F.slice(fs, 2, F.greatest(F.size(fs) - 1, F.lit(0))), start, lambda f, g: shape(f["x"], after(g, f["found"]), after(g, f["other"])))


def folded(edits: DataFrame) -> DataFrame:
    """(target, item_no, x, found, other): one effect for each cell in ``effects``.

    A cell of more than ``FOLD`` edits is folded by ranges of seq first, and
    these by ranges of ranges, so no array is longer; all others in one step.
    """
    cell = ["target", "item_no"]
    many = edits.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > FOLD).select(*cell, F.lit(True).alias("many"))
    low, high = edits.agg(F.min("seq"), F.max("seq")).first()
    at = F.when(F.coalesce("many", F.lit(False)), F.floor((F.col("seq") - F.lit(low or 0)) / FOLD)).otherwise(0).cast("long")
    out = edits.join(many, cell, "left").withColumn("at", at)
    span = ((high or 0) - (low or 0)) // FOLD
    while True:
        fs = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "found", "other"))), lambda e: e.dropFields("seq"))
        out = out.groupBy(*cell, "at").agg(_fold(fs).alias("f")).select(*cell, F.col("at").alias("seq"), "f.*")
        if not span:
            return out.drop("seq")
        out = out.withColumn("at", F.floor(F.col("seq") / FOLD).cast("long"))
        span //= FOLD


def lives(log: DataFrame, members: DataFrame) -> DataFrame:
    """(sheet_id, born, alive, new_name, new_page) of the sheets that sheet edits name: the last of each kind counts, an append names and pages anew."""
    own = log.where(F.col("kind").isin(*SHEET_KINDS) & F.col("target").isNotNull())
    of = members.select("participant_id", F.col("sheet_id").cast("string").alias("_qm_sheet"))
    # An append makes the sheet of its own name only; the others mean all sheets of a participant.
    hit = own.where("kind <> 'append'").join(of, F.col("target") == F.col("participant_id"), "left").select("seq", "kind", "value", F.coalesce("_qm_sheet", "target").alias("sheet_id"))
    every = hit.unionByName(own.where("kind = 'append'").select("seq", "kind", "value", F.col("target").alias("sheet_id")))
    kind = lambda *k: F.col("kind").isin(*k)
    name = F.when(kind("append"), F.struct("seq", F.col("value").alias("v"))).when(kind("rename"), F.when(normalised_name(F.col("value")).isNotNull(), F.struct("seq", normalised_name(F.col("value")).alias("v"))))
    number = F.col("value").try_cast("int")
    page = F.when(kind("append"), F.struct("seq", F.lit(0).alias("v"))).when(kind("page") & number.isNotNull(), F.struct("seq", number.alias("v")))
    return every.groupBy("sheet_id").agg(
        F.max(F.when(kind("append"), F.col("seq"))).alias("born"), F.max(F.when(kind("remove"), F.col("seq"))).alias("died"), F.max(name).alias("new_name"), F.max(page)["v"].alias("new_page")
    )


def replayed_sheets(sheets: DataFrame, log: DataFrame, members: DataFrame) -> DataFrame:
    """``sheets`` (sheet_id, sheet_ord, name, page_index) after the log, with born, the seq of the last append or null.

    Appended sheets stand behind all others in the order of the log: their
    sheet_ord is the last one plus one plus seq.
    """
    cleared = log.where("kind = 'clear_all'").agg(F.max("seq").alias("_qm_cleared"))
    last = sheets.agg(F.coalesce(F.max("sheet_ord") + 1, F.lit(0).cast("long")).alias("_qm_last"))
    base = sheets.select(F.col("sheet_id").cast("string").alias("sheet_id"), "sheet_ord", "name", "page_index", F.lit(True).alias("_qm_base"))
    both = base.join(lives(log, members), "sheet_id", "full").crossJoin(F.broadcast(cleared)).crossJoin(F.broadcast(last))
    died = F.greatest("died", "_qm_cleared")
    alive = F.coalesce(F.col("born") > died, F.col("born").isNotNull() | (F.col("_qm_base").isNotNull() & died.isNull()))
    back = F.col("born").isNotNull()
    return both.where(alive).select(
        "sheet_id", F.when(back, F.col("_qm_last") + F.col("born")).otherwise(F.col("sheet_ord")).alias("sheet_ord"),
        F.when(F.col("new_name").isNotNull(), F.col("new_name.v")).otherwise(F.col("name")).alias("name"), F.coalesce("new_page", "page_index").alias("page_index"), "born",
    )


def replayed_responses(responses: DataFrame, log: DataFrame, members: DataFrame, alive: DataFrame, keep: Keep = _anew) -> DataFrame:
    """``responses`` (sheet_id, item_no, response) of the sheets that are ``alive`` (sheet_id, born) after the log.

    Edits before a sheet's last append don't count, nor what it held then.
    ``keep`` gets the edits that count and the new answers, which are read several times.
    """
    rows = responses.select(F.col("sheet_id").cast("string").alias("sheet_id"), F.col("item_no").cast("int").alias("item_no"), "response")
    rows = rows.join(alive.where("born is null").select("sheet_id"), "sheet_id", "left_semi")
    members = members.select("participant_id", F.col("sheet_id").cast("string").alias("sheet_id"), "sheet_ord").join(alive.where("born is null").select("sheet_id"), "sheet_id", "left_semi")
    people = members.select(F.col("participant_id").alias("target"), F.lit(None).cast("long").alias("born")).distinct()
    people = people.unionByName(alive.where("born is not null").select(F.col("sheet_id").alias("target"), "born"))
    edits = keep(effects(log).join(people, "target").where("born is null or seq > born").drop("born"), "edits")
    done = folded(edits)
    now = merging.merged_responses(rows, members).select(F.col("participant_id").alias("target"), "item_no", F.col("response").alias("now"))
    f = F.struct("x", "found", "other")
    new = keep(done.join(now, ["target", "item_no"], "left").select("target", "item_no", after(f, F.col("now")).alias("response")), "new")
    # Every sheet of the participant gives the answer up, and its own takes the new one.
    touched = new.join(members.select(F.col("participant_id").alias("target"), "sheet_id"), "target").select("sheet_id", "item_no", F.lit(True).alias("_qm_touched"))
    kept = rows.join(touched, ["sheet_id", "item_no"], "left")
    kept = kept.where(F.col("_qm_touched").isNull()).select("sheet_id", "item_no", "response").unionByName(
        kept.where("_qm_touched").join(new.select(F.col("target").alias("sheet_id"), "item_no"), ["sheet_id", "item_no"], "left_anti").select("sheet_id", "item_no", F.lit(None).cast("string").alias("response"))
    )
    return kept.unionByName(new.select(F.col("target").alias("sheet_id"), "item_no", "response"))


def replayed(sheets: DataFrame, responses: DataFrame, log: DataFrame, merge: bool = False, keep: Keep = _anew) -> tuple[DataFrame, DataFrame]:
    """Sheets and responses after the log; with ``merge`` sheets of equal names are one participant, as they are before the log.

    ``keep`` stores tables that are read several times, so that they are computed once.

    The part of a log up to some seq may be replayed and stored, and the rest
    on what was stored: the result is the same, except that with ``merge`` the
    participants are those of the stored sheets.
    """
    members = keep(merging.memberships(sheets, merge), "members")
    kept = keep(replayed_sheets(sheets, log, members), "alive")
    return kept.drop("born"), replayed_responses(responses, log, members, kept, keep)
