"""Pages and sheets that land in a folder are read once."""

from __future__ import annotations

from quillmark.config import ScoringConfig
from quillmark.operators import scoring
from quillmark.plans import drawing
from quillmark.plans.queries import LAYOUTS
from quillmark.sources import sheets, sinks
from quillmark.streaming import landing
from tests.test_scanning import png, truth


def test_new_images_are_read_once(spark, tmp_path):
    layout = LAYOUTS["L30"]
    inbox, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(drawing.draw_page(layout, *truth(layout))))
    landing.read_landing(spark, inbox, out, state, layout).awaitTermination()
    assert [r.ok for r in spark.read.parquet(out).collect()] == [True]
    (tmp_path / "in" / "b.png").write_bytes(b"broken")
    landing.read_landing(spark, inbox, out, state, layout).awaitTermination()
    landing.read_landing(spark, inbox, out, state, layout).awaitTermination()
    assert sorted(r.ok for r in spark.read.parquet(out).collect()) == [False, True]


def test_landed_sheets_are_scored_as_in_a_batch(spark, sf, tmp_path):
    from quillmark.plans.fixtures import ITEMS, key_of, r_matrix

    s = sheets.from_responses(r_matrix(spark, sf), ITEMS)
    config = ScoringConfig(num_questions=ITEMS)
    sinks.write_sheets(s, str(tmp_path / "in"))
    landing.score_landing(spark, str(tmp_path / "in"), key_of(spark), config, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("sheet_ord", "correct", "wrong", "blank", "scaled_score")
    want = scoring.score_sheets(s, key_of(spark), config).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_running_tally(spark, sf, tmp_path):
    from quillmark.plans.fixtures import ITEMS, r_matrix

    sinks.write_sheets(sheets.from_responses(r_matrix(spark, sf), ITEMS), str(tmp_path / "in"))
    stream = landing.running_tally(landing.landing_sheets(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("tally").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("tally").collect()] == [("done", 10)]


def test_stalled_pages_wait_again_and_fail_at_last(spark, tmp_path):
    """One page is read, one errs twice, one's reader never comes back; the tally comes from what the stream put out."""
    import json
    import time

    from quillmark.operators.reports import outcome_counts
    from quillmark.streaming import queue

    inbox = tmp_path / "in"
    inbox.mkdir()

    def put(name: str, rows: list[tuple]) -> None:
        (tmp_path / name).write_text("\n".join(json.dumps(dict(zip(("sheet_id", "seq", "event"), r, strict=True))) for r in rows))
        (tmp_path / name).rename(inbox / f"{name}.json")

    changes: list[tuple] = []

    def until(done, seconds: int = 60) -> None:
        end = time.time() + seconds
        while not done() and time.time() < end:
            assert stream.exception() is None
            time.sleep(0.2)
        assert done(), changes

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = spark.readStream.schema("sheet_id string, seq long, event string").json(str(inbox))
        out = queue.attempted(events, patience_seconds=1, most=2).writeStream.outputMode("update")
        stream = out.foreachBatch(lambda df, i: changes.extend((i, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
        put("1", [("a", 2, "claimed"), ("a", 1, "queued"), ("b", 1, "queued"), ("b", 2, "claimed"), ("b", 3, "error"), ("c", 1, "claimed"), ("c", 2, "done"), ("c", 3, "queued"), (None, 1, "queued"), ("d", 1, "nonsense")])
        until(lambda: any(c[1] == "a" and c[4] == "stalled" for c in changes))
        put("2", [("a", 3, "claimed"), ("b", 4, "claimed"), ("b", 5, "error")])
        until(lambda: {c[1] for c in changes if c[2] == "failed"} == {"a", "b"})
        stream.stop()
    finally:
        spark.conf.set(provider, before)
    last = queue.last_states(spark.createDataFrame(changes, "batch long, sheet_id string, status string, attempts int, reason string"))
    assert {r.sheet_id: (r.status, r.attempts) for r in last.collect()} == {"a": ("failed", 2), "b": ("failed", 2), "c": ("done", 1)}
    assert {tuple(r) for r in outcome_counts(last).collect()} == {("failed", 2), ("done", 1)}
    assert [c[2:4] for c in changes if c[1] == "a"] == [("pending", 0), ("processing", 1), ("pending", 1), ("processing", 2), ("failed", 2)]
