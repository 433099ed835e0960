"""Classical item analysis: difficulty, discrimination, point-biserial, distractors, KR-20.

All of it follows from one table of joint counts: how many sheets of a score
gave a response to an item. A test has at most 200 items, a few hundred scores
and seven kinds of response, so the table is small whatever the number of
sheets, and it adds up: the counts of two sets of sheets are the sum of theirs,
and a changed sheet is one taken off and one added (``changed_counts``). Only
the extreme groups need more than counts: of the sheets that tie at a group's
border, the earliest or the latest belong to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.config import ScoringConfig
from quillmark.functions.scalars import reliability_grade, verdict
from quillmark.operators.ranking import tie_cuts

BLANK = "kosong"
OTHER = "lain"
SHARE = 0.27

#: What a joint count counts: sheets by item (0: the sheet itself), kind of response, whether it is right, and score.
CELL = ["item_no", "key", "option", "right", "raw_score", "correct"]


def option_of(response: Column, config: ScoringConfig) -> Column:
    """A letter of the option set, or that it is another or none."""
    return F.when(response.isNull(), BLANK).when(response.isin(*config.options), response).otherwise(OTHER)


def joint_counts(scored: DataFrame, config: ScoringConfig) -> DataFrame:
    """(item_no, key, option, right, raw_score, correct, n) of sheets scored with their items array.

    Item 0 stands for the sheet itself, so its rows count sheets by score. One
    aggregation, whose partial sums leave a task at most one row per cell.
    """
    sheet = F.struct(F.lit(0).alias("no"), F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("key"), F.lit("sheet").alias("status"))
    long = scored.select("raw_score", "correct", F.explode(F.concat(F.array(sheet), "items")).alias("x"))
    cells = long.select(F.col("x.no").alias("item_no"), F.col("x.key").alias("key"), option_of(F.col("x.response"), config).alias("option"), (F.col("x.status") == "correct").alias("right"), "raw_score", "correct")
    return cells.groupBy(*CELL).agg(F.count("*").alias("n"))


def response_counts(responses: DataFrame, graded: DataFrame, key: DataFrame, config: ScoringConfig, by: str = "sheet_ord") -> DataFrame:
    """The same of (by, item_no, response) rows, which may be sparse, and their sheets' scores; an item needs a row in ``key``."""
    inside = responses.where(F.col("item_no").between(1, config.num_questions)).join(F.broadcast(key), "item_no")
    long = inside.join(graded.select(by, "raw_score", "correct"), by)
    right = F.coalesce(F.col("response") == F.col("key"), F.lit(False))
    cells = long.select(F.col("item_no").cast("int").alias("item_no"), "key", option_of(F.col("response"), config).alias("option"), right.alias("right"), "raw_score", "correct")
    sheets = graded.select(F.lit(0).alias("item_no"), F.lit(None).cast("string").alias("key"), F.lit(BLANK).alias("option"), F.lit(False).alias("right"), "raw_score", "correct")
    return cells.unionByName(sheets).groupBy(*CELL).agg(F.count("*").alias("n"))


def added_counts(*counts: DataFrame) -> DataFrame:
    """The sum of joint counts; cells that come to nothing are gone."""
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return every.groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0")


def changed_counts(counts: DataFrame, before: DataFrame, after: DataFrame, config: ScoringConfig) -> DataFrame:
    """``counts`` once the scored sheets ``before`` have become ``after``; either may be empty. No other sheet is read."""
    off = joint_counts(before, config).withColumn("n", -F.col("n"))
    return added_counts(counts, off, joint_counts(after, config))


def borders(counts: DataFrame) -> DataFrame:
    """One row (n, group_size, total_mean, total_sd, upper_at, upper_ties, lower_at, lower_ties); none without a sheet.

    Sheets above upper_at are in the upper group, and the upper_ties earliest
    of those at upper_at; the lower group likewise. A score is a row here, so
    the windows hold a few hundred.
    """
    levels = counts.where("item_no = 0").groupBy("raw_score").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.col("correct")).alias("s"), F.sum(F.col("n") * F.col("correct") * F.col("correct")).alias("ss"))
    whole = Window.partitionBy()
    levels = levels.withColumns({"n": F.sum("c").over(whole), "s": F.sum("s").over(whole), "ss": F.sum("ss").over(whole)})
    falling = Window.orderBy(F.col("raw_score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumn("upto", F.sum("c").over(falling)).withColumn("g", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(SHARE) + 0.5)).cast("long"))
    above, below = F.col("upto") - F.col("c"), F.col("n") - F.col("upto")
    at = lambda before: (before < F.col("g")) & (before + F.col("c") >= F.col("g"))
    pick = lambda before, c: F.max(F.when(at(before), c))
    n = F.col("n")
    # Sums of whole numbers are exact; the difference is taken before anything is divided.
    spread = (n * F.col("ss") - F.col("s") * F.col("s")).cast("double")
    sd = F.when(n == 1, 0.0).otherwise(F.sqrt(F.try_divide(spread, (n * (n - 1)).cast("double"))))
    return levels.groupBy("n", F.col("g").alias("group_size"), (F.col("s") / n).alias("total_mean"), sd.alias("total_sd")).agg(
        pick(above, F.col("raw_score")).alias("upper_at"), pick(above, F.col("g") - above).alias("upper_ties"), pick(below, F.col("raw_score")).alias("lower_at"), pick(below, F.col("g") - below).alias("lower_ties")
    )


def _sides(one: DataFrame) -> DataFrame:
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"{name}_at").alias("at"), F.col(f"{name}_ties").alias("m"))
    return one.select(F.inline(F.array(side("upper"), side("lower"))))


def tied(sheets: DataFrame, one: DataFrame, ord_col: str = "sheet_ord") -> DataFrame:
    """(side, and the columns of ``sheets``): the sheets at a border's score that belong to the group. Only those of the two scores are looked at."""
    sides = _sides(one)
    cuts = tie_cuts(sheets.select(F.col("raw_score").alias("at"), F.col(ord_col).alias("ord")), sides)
    near = sheets.join(F.broadcast(cuts), F.col("raw_score") == F.col("at"))
    return near.where(F.when(F.col("side") == "upper", F.col(ord_col) <= F.col("cut")).otherwise(F.col(ord_col) >= F.col("cut"))).drop("at", "cut")


def _by_side(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item_no").agg(F.count_if(F.col("side") == "upper").alias("upper_tied"), F.count_if(F.col("side") == "lower").alias("lower_tied"))


def tied_rights(scored: DataFrame, one: DataFrame) -> DataFrame:
    """(item_no, upper_tied, lower_tied): right responses of the tied sheets of each group, from scored sheets."""
    some = tied(scored.select("sheet_ord", "raw_score", "items"), one)
    return _by_side(some.select("side", F.explode(F.filter("items", lambda x: x["status"] == "correct")).alias("x")).select("side", F.col("x.no").alias("item_no")))


def statistics(counts: DataFrame, rights: DataFrame, config: ScoringConfig, one: DataFrame | None = None) -> DataFrame:
    """One row per item: (item_no, key, p, discrimination, point_biserial, n_<letter>..., n_other, n_blank, verdict, n, group_size, total_sd)."""
    one = borders(counts) if one is None else one
    total = lambda when: F.sum(F.when(when, F.col("n_cell")).otherwise(0))
    right, option = F.col("right"), F.col("option")
    agg = counts.where("item_no > 0").withColumnRenamed("n", "n_cell").crossJoin(F.broadcast(one)).groupBy("item_no", "key", "n", "group_size", "total_mean", "total_sd").agg(
        total(right).alias("n_correct"), total(right & (F.col("raw_score") > F.col("upper_at"))).alias("above"), total(right & (F.col("raw_score") < F.col("lower_at"))).alias("below"),
        F.sum(F.when(right, F.col("n_cell") * F.col("correct"))).alias("sum_correct"), *[total(option == c).alias(f"n_{c.lower()}") for c in config.options],
        total(option == OTHER).alias("n_other"), total(option != BLANK).alias("n_answered"),
    )
    agg = agg.join(F.broadcast(rights), "item_no", "left")
    some = lambda c: F.coalesce(c, F.lit(0))
    keyed = F.col("key").isNotNull()
    p = F.when(keyed, F.col("n_correct") / F.col("n"))
    d = F.when(keyed, (F.col("above") + some("upper_tied")) / F.col("group_size") - (F.col("below") + some("lower_tied")) / F.col("group_size"))
    out = agg.withColumn("p", p).withColumn("discrimination", d)
    usable = keyed & (F.col("total_sd") > 0) & (F.col("p") > 0) & (F.col("p") < 1)
    r = F.try_divide(F.try_divide(F.col("sum_correct"), F.col("n_correct")) - F.col("total_mean"), F.col("total_sd")) * F.sqrt(F.try_divide(F.col("p"), 1 - F.col("p")))
    out = out.withColumn("point_biserial", F.when(usable, r)).withColumn("n_blank", F.col("n") - F.col("n_answered"))
    out = out.withColumn("verdict", verdict(F.col("p"), F.col("discrimination")))
    return out.select("item_no", "key", "p", "discrimination", "point_biserial", *[f"n_{c.lower()}" for c in config.options], "n_other", "n_blank", "verdict", "n", "group_size", "total_sd")


def item_statistics(responses: DataFrame, graded: DataFrame, key: DataFrame, config: ScoringConfig, by: str = "sheet_ord") -> DataFrame:
    """``statistics`` of each item that has a row in ``responses`` (by, item_no, response) and in ``key``.

    Letters outside the option set are counted as other; a participant without
    a row for an item counts as blank there.
    """
    counts = response_counts(responses, graded, key, config, by)
    one = borders(counts)
    some = tied(graded.select(by, "raw_score"), one, by).select(by, "side")
    right = responses.where(F.col("item_no").between(1, config.num_questions)).join(F.broadcast(key.where("key is not null")), "item_no").where("response = key")
    return statistics(counts, _by_side(right.join(some, by)), config, one)


def item_statistics_of_sheets(scored: DataFrame, key: DataFrame, config: ScoringConfig, counts: DataFrame | None = None) -> DataFrame:
    """The same of each item in ``key``, from sheets scored with their items array, or from their joint counts if these are at hand.

    ``scored`` is read for the counts and for the ties at the borders: store it first.
    """
    counts = joint_counts(scored, config) if counts is None else counts
    one = borders(counts)
    return statistics(counts, tied_rights(scored, one), config, one).join(F.broadcast(key.select("item_no")), "item_no", "left_semi")


def distribution(stats: DataFrame, config: ScoringConfig) -> DataFrame:
    """(item_no, distribution map<string, long>): counts by letter, other letters and blanks."""
    pairs = [x for c in config.options for x in (F.lit(c), F.col(f"n_{c.lower()}"))]
    return stats.select("item_no", F.create_map(*pairs, F.lit(OTHER), F.col("n_other"), F.lit(BLANK), F.col("n_blank")).alias("distribution"))


def kr20(stats: DataFrame) -> DataFrame:
    """One row (k, sum_pq, kr20, interpretation) from item statistics; null with fewer than 2 keyed items or no spread."""
    agg = stats.agg(F.count("key").alias("k"), F.sum(F.when(F.col("key").isNotNull(), F.col("p") * (1 - F.col("p")))).alias("sum_pq"), F.max("total_sd").alias("sd"))
    variance = F.col("sd") * F.col("sd")
    value = F.when((F.col("k") > 1) & (variance > 0), F.col("k") / F.nullif(F.col("k") - 1, F.lit(0)) * (1 - F.try_divide(F.col("sum_pq"), variance)))
    return agg.withColumn("kr20", value).select("k", "sum_pq", "kr20", reliability_grade(F.col("kr20")).alias("interpretation"))


def flagged(stats: DataFrame) -> DataFrame:
    """Keyed items whose verdict is not Layak."""
    return stats.where("key is not null and verdict <> 'Layak'")
