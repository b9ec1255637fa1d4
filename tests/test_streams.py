"""Streams over several micro-batches, with late and repeated events."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from landgrid.streaming import streams as S

START = datetime(2024, 1, 1)


def stream(spark, tmp_path, schema, *batches):
    """One file and so one micro-batch for each list of rows."""
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_batches_are_told_once(spark, tmp_path):
    schema = "batch_id long, item string, outcome string"
    items = stream(
        spark, tmp_path, schema,
        [(1, "a", "completed"), (2, "a", "failed"), (1, "a", "completed")], [(1, "b", "failed"), (3, "a", "other")],
        [(2, "a", "failed"), (2, "b", "completed"), (1, "a", "failed"), (1, "c", "completed")], [(3, "b", "completed"), (1, "c", "completed"), (1, "d", "completed")],
    )
    totals = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "batch_id long, total long")
    run = lambda: sorted((r.batch_id, r.processed, r.failed) for r in S.run_to_end(S.batch_progress_stream(items, totals), str(tmp_path / "run")).collect())
    assert run() == [(1, 2, 1), (2, 0, 1)]
    stream(spark, tmp_path, schema, [(1, "b", "failed"), (2, "c", "completed"), (3, "a", "failed")])  # after a restart
    assert run() == [(1, 2, 1), (2, 0, 1), (3, 1, 1)]


def test_workflow_takes_late_events_in_their_order(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    events = stream(
        spark, tmp_path, "claim string, event_id long, ts timestamp, outcome string",
        [("c", 1, at(0), "completed"), ("c", 4, at(9), "failed")],
        [("c", 3, at(6), "completed"), ("c", 4, at(9), "failed"), ("x", 50, at(8), "completed")],  # late, repeated
        [("c", 2, at(3), "failed"), ("c", 5, at(30), "completed")],
        [("c", 6, at(2), "failed"), ("x", 51, at(40), "completed")],  # too late
        [("z", 99, at(60 * 24 * 20), "completed")],
    )
    out = S.run_to_end(S.workflow_stream(events), str(tmp_path / "run"), "update")
    got = {r.claim: (r.steps_done, r.status, r.attempts, r.overdue) for r in S.newest(out, "claim").collect()}
    assert got == {"c": (3, "in_progress", 5, True), "x": (2, "in_progress", 2, True)}  # that of z waits for the watermark
    assert out.where("claim = 'c' and overdue").count() == 1


def test_retries_over_batches(spark, tmp_path):
    items = stream(
        spark, tmp_path, "document_id long, event string, outcome string",
        [(1, "a", "failed"), (2, "a", "failed")], [(1, "b", "failed"), (1, "c", "failed"), (2, "b", "completed"), (2, "a", "failed")], [(1, "d", "failed"), (1, "a", "failed")], [(1, "e", "failed")],
    )
    out = S.run_to_end(S.retry_stream(items), str(tmp_path / "run"), "update")
    assert {r.document_id: (r.attempts, r.state) for r in S.newest(out, "document_id").collect()} == {1: (4, "failed"), 2: (1, "queued")}
    assert out.where("state = 'failed'").count() == 1


def _calls(monkeypatch, processor, folder):
    """Leaves a file in `folder` for each call of the processor."""
    inner = processor.handleInputRows

    def noted(self, key, rows, timer_values):
        import os
        import uuid
        os.makedirs(folder, exist_ok=True)
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        yield from inner(self, key, rows, timer_values)

    monkeypatch.setattr(processor, "handleInputRows", noted)


def test_streams_call_python_per_group_of_keys(spark, tmp_path, monkeypatch):
    _calls(monkeypatch, S.BatchProgress, str(tmp_path / "batch-calls"))
    _calls(monkeypatch, S.Retries, str(tmp_path / "retry-calls"))
    spark.range(6000).selectExpr("id % 2000 AS batch_id", "CAST(id AS STRING) AS item", "CASE WHEN id % 3 = 0 THEN 'failed' WHEN id % 2000 < 9 THEN 'other' ELSE 'completed' END AS outcome").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    items = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    totals = rows.groupBy("batch_id").agg(F.count("item").alias("total"))
    told = S.run_to_end(S.batch_progress_stream(items, totals), str(tmp_path / "batches"))
    want = {(b, sum(i % 3 != 0 for i in (b, b + 2000, b + 4000)), sum(i % 3 == 0 for i in (b, b + 2000, b + 4000))) for b in range(9, 2000)}
    assert {tuple(r) for r in told.drop("_batch").collect()} == want
    keyed = items.select(F.when(F.col("batch_id") != 5, F.col("batch_id")).alias("document_id"), F.col("item").alias("event"), "outcome")
    tried = S.newest(S.run_to_end(S.retry_stream(keyed), str(tmp_path / "retries"), "update"), "document_id")
    fails = pd.Series([None if i % 2000 == 5 else i % 2000 for i in range(0, 6000, 3)], dtype="Int64").value_counts(dropna=False)
    got = {r.document_id: (r.attempts, r.state) for r in tried.collect()}
    assert got == {None if pd.isna(d) else d: (min(n, 4), "failed" if n > 3 else "queued") for d, n in fails.items()} and None in got
    for folder in ("batch-calls", "retry-calls"):
        assert 0 < len(list((tmp_path / folder).iterdir())) <= 1025


def test_idle_batches_are_forgotten_within_their_group(spark, tmp_path, monkeypatch):
    schema = "batch_id long, item string, outcome string"
    items = stream(spark, tmp_path, schema, [(1, "a", "completed"), (2, "a", "completed"), (2, "b", "completed")], [(9, "a", "failed")], [(9, "b", "failed")], [(1, "b", "completed"), (2, "a", "completed")])
    totals = spark.createDataFrame([(1, 2), (2, 2), (9, 5)], "batch_id long, total long")
    run = lambda name, **k: sorted((r.batch_id, r.processed) for r in S.run_to_end(S.batch_progress_stream(items, totals, groups=1, **k), str(tmp_path / name)).drop("_batch").collect())
    assert run("kept") == [(1, 2), (2, 2)]
    assert run("idle", idle="1 ms") == [(2, 2)]  # the first item of batch 1 is forgotten before the second comes, batch 2 is still known as told
