"""From bubble darkness to answers: plain columns, so thresholds can change without reading an image again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.config import CALIBRATION_BOUNDS, OmrOptions
from quillmark.functions.scalars import clamp


def calibrated(settings: DataFrame) -> DataFrame:
    """``settings`` with each decision parameter among its columns clamped to the range in which it may be set; null stays."""
    return settings.withColumns({c: clamp(F.col(c), *bounds) for c, bounds in CALIBRATION_BOUNDS.items() if c in settings.columns})


def with_net(samples: DataFrame, by: str = "sheet_ord") -> DataFrame:
    """Samples with baseline, the median darkness of all bubbles of the sheet, and net, the darkness above it.

    One shuffle by sheet, whose bubbles are few; windows by sheet and item need no other.
    """
    sheet = Window.partitionBy(by)
    return samples.withColumn("baseline", F.percentile("fill", 0.5).over(sheet)).withColumn("net", F.col("fill") - F.col("baseline"))


def decisions(samples: DataFrame, options: OmrOptions, by: str = "sheet_ord", keep_option: bool = False) -> DataFrame:
    """(by, no, response, flag, best_net, margin) of every item from samples with net, and with ``keep_option`` the darkest option whatever is decided.

    The darkest option is the answer if it is dark enough and ahead of the
    second by a margin; else the response is null and the flag says ganda
    (several marks) or kosong (none). Of equal ones the earlier option counts as
    the darker.
    """
    dark = Window.partitionBy(by, "no").orderBy(F.col("net").desc(), "option_index")
    ranked = samples.withColumn("i", F.row_number().over(dark)).withColumn("second", F.lead("net").over(dark)).where("i = 1")
    margin = F.col("net") - F.coalesce("second", F.lit(0.0))
    enough = F.col("net") >= F.lit(options.fill_threshold)
    sure = enough & (F.col("margin") >= F.lit(options.margin_threshold))
    out = ranked.withColumn("margin", margin)
    flag = F.when(~sure, F.when(enough, "ganda").otherwise("kosong"))
    return out.select(by, "no", F.when(sure, F.col("option")).alias("response"), flag.alias("flag"), F.col("net").alias("best_net"), "margin", *(["option"] if keep_option else []))


def sweep(best: DataFrame, fills: list[float], margins: list[float]) -> DataFrame:
    """(fill_threshold, margin_threshold, answered, ganda, kosong, right) for each pair of thresholds, from one pass.

    ``best`` holds best_net and margin of every item, option (the darkest) and
    key. An item is answered at all thresholds that are not above its values,
    so it is counted once, at the highest of both that it reaches; sums over
    these counts, of which there are as many as pairs, give every pair.
    """
    steps = [sorted(set(fills)), sorted(set(margins))]
    reached = lambda c, values: F.size(F.filter(F.array(*map(F.lit, values)), lambda t: t <= F.col(c)))
    hit = F.coalesce(F.col("option") == F.col("key"), F.lit(False))
    counts = best.where("best_net is not null").groupBy(reached("best_net", steps[0]).alias("i"), reached("margin", steps[1]).alias("j")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    pairs = best.sparkSession.createDataFrame([(i + 1, j + 1, f, m) for i, f in enumerate(steps[0]) for j, m in enumerate(steps[1])], "fi int, mj int, fill_threshold double, margin_threshold double")
    # Pairs and counts are a few hundred rows each; the lowest pair of indices meets all counts, the highest few.
    met = pairs.join(F.broadcast(counts), F.lit(True), "left")
    dark, ahead = F.col("i") >= F.col("fi"), F.col("j") >= F.col("mj")
    total = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    return met.groupBy("fill_threshold", "margin_threshold").agg(total(dark & ahead, "n").alias("answered"), total(dark & ~ahead, "n").alias("ganda"), total(~dark, "n").alias("kosong"), total(dark & ahead, "hits").alias("right"))


def fill_rates(decided: DataFrame, by: str = "sheet_ord") -> DataFrame:
    """(by, marked, items, fill_rate): the share of items that got an answer."""
    out = decided.groupBy(by).agg(F.count("response").alias("marked"), F.count("*").alias("items"))
    return out.withColumn("fill_rate", F.try_divide("marked", "items"))


def flags(decided: DataFrame, by: str = "sheet_ord") -> DataFrame:
    """(by, no, reason) of the items that got no answer."""
    return decided.where("flag is not null").select(by, "no", F.col("flag").alias("reason"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it and wherever the planner puts it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def decide_scans(scans: DataFrame, options: OmrOptions) -> DataFrame:
    """Scans with baseline, answers array<struct<no, response, flag>>, marked and fill_rate; nothing is shuffled.

    A failed scan has null answers.
    """
    fills = F.sort_array(F.transform("samples", lambda s: s["fill"]))
    middle = _let(fills, lambda f: (F.get(f, F.floor((F.size(f) - 1) / 2).cast("int")) + F.get(f, F.floor(F.size(f) / 2).cast("int"))) / 2)
    out = scans.withColumn("baseline", F.when(F.col("ok"), middle))

    def answer(x):
        net = -x["m"]
        margin = net + F.coalesce(x["second"], F.lit(0.0))
        enough = net >= F.lit(options.fill_threshold)
        sure = enough & (margin >= F.lit(options.margin_threshold))
        return F.struct(x["no"].alias("no"), F.when(sure, x["o"]).alias("response"), F.when(~sure, F.when(enough, "ganda").otherwise("kosong")).alias("flag"))

    def answers(ranked):
        # By item, then by falling net, then option: what stands first of an item is its darkest.
        first = F.filter(F.transform(ranked, lambda x, i: F.struct(x["no"].alias("no"), x["m"].alias("m"), x["o"].alias("o"), i.alias("at"))), lambda x: ~F.get(ranked, x["at"] - 1)["no"].eqNullSafe(x["no"]))
        after = lambda x: F.get(ranked, x["at"] + 1)
        return F.transform(first, lambda x: answer({"no": x["no"], "m": x["m"], "o": x["o"], "second": F.when(after(x)["no"] == x["no"], after(x)["m"])}))

    by_item = lambda base: F.sort_array(F.transform("samples", lambda s: F.struct(s["no"].alias("no"), (base - s["fill"]).alias("m"), s["option_index"].alias("i"), s["option"].alias("o"))))
    out = out.withColumn("answers", F.when(F.col("ok"), _let(F.col("baseline"), lambda base: _let(by_item(base), answers))))
    marked = F.when(F.col("ok"), F.size(F.filter("answers", lambda a: a["response"].isNotNull())))
    return out.withColumn("marked", marked).withColumn("fill_rate", F.try_divide(F.col("marked"), F.size("answers")))


def otsu(levels: DataFrame, by: str) -> DataFrame:
    """(by, threshold) from (by, level, n), counts of grey levels 0 to 255: the first level of greatest variance between classes, 128 if there is none."""
    upto = Window.partitionBy(by).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    v = levels.withColumn("w", F.sum("n").over(upto)).withColumn("s", F.sum(F.col("n") * F.col("level")).over(upto))
    v = v.withColumn("all", F.sum("n").over(whole)).withColumn("sum", F.sum(F.col("n") * F.col("level")).over(whole))
    gap = F.try_divide(F.col("s"), F.col("w")) - F.try_divide(F.col("sum") - F.col("s"), F.col("all") - F.col("w"))
    between = F.col("w").cast("double") * (F.col("all") - F.col("w")).cast("double") * gap * gap
    v = v.withColumn("between", F.when((F.col("w") > 0) & (F.col("w") < F.col("all")), between))
    best = F.max(F.when(F.col("between") > 0, F.struct("between", (-F.col("level")).alias("neg"))))
    return v.groupBy(by).agg(best.alias("b")).select(by, F.coalesce(-F.col("b.neg"), F.lit(128)).cast("int").alias("threshold"))
