"""A whole assessment: from sheets and a key to every table of its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.config import ScoringConfig
from quillmark.operators import items, merging, norms, reports, scoring
from quillmark.sources.workspace import stored, work_folder


@dataclass(frozen=True)
class Assessment:
    """Frames of one test; ``scored`` and ``counts`` are stored tables, so the others don't score again."""

    config: ScoringConfig
    members: DataFrame
    scored: DataFrame
    counts: DataFrame
    normed: DataFrame
    item_stats: DataFrame
    reliability: DataFrame
    basis: DataFrame

    def report(self) -> dict[str, DataFrame]:
        return reports.report(self.scored.sparkSession, self.normed, self.item_stats, self.reliability, self.basis, self.config)


def merged_sheets(sheets: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(sheet_id, sheet_ord, name, answers, conflict_count) of participants: each is described by its first sheet."""
    long = scoring.responses_of(sheets, n)
    merged = merging.merged_responses(long, members)
    answers = scoring.answer_maps(merged, n, "participant_id").join(merging.conflict_counts(merged), "participant_id")
    people = merging.merged_participants(sheets).join(answers, "participant_id")
    filled = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.try_element_at("answers", i))
    return people.select(F.col("participant_id").alias("sheet_id"), "sheet_ord", "name", filled.alias("answers"), "conflict_count")


def assess(sheets: DataFrame, key: DataFrame, config: ScoringConfig, work: str | None = None) -> Assessment:
    """Score the finished ``sheets`` against ``key``. Scores and joint counts are stored under ``work``, by default a
    folder of this application, and read again, so the sheets are scanned once whatever is asked."""
    spark, n = sheets.sparkSession, config.num_questions
    done = sheets.where("status = 'done'")
    members = merging.memberships(done, config.merge_by_name)
    units = merged_sheets(done, members, n) if config.merge_by_name else done.select("sheet_id", "sheet_ord", "name", "answers", F.lit(0).cast("long").alias("conflict_count"))
    return _assessed(scoring.score_sheets(units, key, config), members, key, config, (work or work_folder(spark, "assessment")).rstrip("/"))


def _assessed(scored: DataFrame, members: DataFrame, key: DataFrame, config: ScoringConfig, work: str, counts: DataFrame | None = None) -> Assessment:
    scored = stored(scored, f"{work}/scored")
    counts = stored(items.joint_counts(scored, config) if counts is None else counts, f"{work}/counts")
    stats = items.item_statistics_of_sheets(scored, key, config, counts)
    return Assessment(config, members, scored, counts, norms.with_norms(scored, config), stats, items.kr20(stats), norms.norm_basis(scored, config))


def reassess(last: Assessment, key: DataFrame, changes: DataFrame, work: str | None = None) -> Assessment:
    """``last`` after ``changes`` (sheet_id, sheet_ord, name, answers, removed) of units that it scored or of new ones.

    Only the changed units are scored: their former scores are taken off the
    joint counts and their new ones added. The others' scores are copied, not
    computed; item statistics then read the counts, and of the scores the ties
    at the two borders.
    """
    spark, config = last.scored.sparkSession, last.config
    folder = (work or work_folder(spark, "assessment")).rstrip("/")
    ids = changes.select("sheet_id").distinct()
    before = last.scored.join(ids, "sheet_id", "left_semi")
    fresh = changes.where("not removed").select("sheet_id", "sheet_ord", "name", "answers", F.lit(0).cast("long").alias("conflict_count"))
    after = stored(scoring.score_sheets(fresh, key, config), f"{folder}/after")
    counts = items.changed_counts(last.counts, before, after, config)
    scored = last.scored.join(ids, "sheet_id", "left_anti").unionByName(after)
    return _assessed(scored, last.members, key, config, folder, counts)
