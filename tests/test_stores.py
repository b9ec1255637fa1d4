"""Stores, documents of many parts, the queue's replay and deep pages against plain versions."""

import contextlib
import glob
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from landgrid.operators import relational as R
from landgrid.operators import workflow as W
from landgrid.sources import sinks, tables


def test_saving_some_claims_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "recs")
    save = lambda rows: sinks.save_recommendations(spark.createDataFrame(rows, "id string, scheme string, score int"), path, buckets=4)
    read = lambda: sorted(tuple(r) for r in sinks.read_recommendations(spark, path).select("id", "scheme", "score").collect())
    assert sinks.read_recommendations(spark, path) is None
    first = [(str(i), s, i) for i in range(40) for s in ("a", "b")]
    save([*first, *first])
    assert read() == sorted(first)
    save([("7", "c", 1), ("99", "a", 2)])
    second = sorted([r for r in first if r[0] != "7"] + [("7", "c", 1), ("99", "a", 2)])
    assert read() == second
    save([])
    assert read() == second
    save([("7", "c", 3)])
    assert read() == sorted([r for r in second if r[0] != "7"] + [("7", "c", 3)])


@contextlib.contextmanager
def small_partitions(spark):
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    yield
    for name in sizes:
        spark.conf.unset(name)


def test_a_large_day_is_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "audit")
    with small_partitions(spark):
        days = F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(7).cast("int")
        entries = spark.range(0, 60_000, 1, 8).select("id", F.xxhash64("id").cast("string").alias("note"), F.timestamp_add("DAY", days, F.lit(datetime(2024, 1, 1))).alias("ts"))
        sinks.append_audit(entries, path)
        sinks.append_audit(entries.limit(10), path)
    assert len(glob.glob(f"{path}/day=2024-01-08/*.parquet")) > 3
    assert spark.read.parquet(path).count() == 60_010


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_geojson_is_one_valid_document(spark, tmp_path, n):
    path = str(tmp_path / "doc")
    c = F.col
    rows = spark.range(n).select(F.format_string("%05d", "id").alias("id"), (c("id") / 100 - 20).alias("lat"), (c("id") / 50 - 40).alias("lng"))
    features = rows.select("id", sinks.geojson_feature(c("lat"), c("lng"), id=c("id"), name=F.lit('a "quoted", name')).alias("feature")).repartition(7)
    with small_partitions(spark):
        sinks.write_geojson(features, path)
    parts = sorted(glob.glob(f"{path}/part-*"))
    document = json.loads("".join(open(p).read() for p in parts))
    assert document["type"] == "FeatureCollection" and [f["properties"]["id"] for f in document["features"]] == [f"{i:05}" for i in range(n)]
    assert n < 5000 or max(sum(1 for _ in open(p)) for p in parts) < n / 2  # no task holds all features
    assert sinks.read_geojson(spark, path).count() == n


def plain_queue(events):
    """The queue as a list, sorted by priority after each event with a sort that keeps the order of equals."""
    rank, queue, tries, own = {"high": 0, "normal": 1, "low": 2}, [], {}, {}
    for job, kind, priority, *_ in sorted(events, key=lambda e: e[3:]):
        queue = [j for j in queue if j != job]
        if kind in ("batch", "single"):
            own[job] = priority or ("high" if kind == "single" else "normal")
            queue = [job, *queue] if kind == "single" else [*queue, job]
        elif kind == "failed":
            tries[job] = tries.get(job, 0) + 1
            if tries[job] <= W.MAX_RETRIES:
                own[job] = "low"
                queue = [*queue, job]
        queue.sort(key=lambda j: rank[own[j]])
    return [(j, own[j], tries.get(j, 0)) for j in queue]


def test_queue_replay_equals_a_plain_queue(spark):
    r, events = random.Random(5), []
    for seq in range(600):
        events.append((f"j{r.randrange(90)}", r.choice(["batch", "single", "started", "failed", "failed"]), r.choice([None, "high", "normal", "low"]), seq // 2, str(seq % 2)))
    got = W.queue_replay(spark.createDataFrame(events, "job string, kind string, priority string, seq long, tiebreak string").repartition(4)).orderBy("position").collect()
    assert [(x.job, x.priority, x.attempts) for x in got] == plain_queue(events) and [x.position for x in got] == list(range(1, len(got) + 1))
    assert {x.entry for x in got} == {"batch", "single", "retry"}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_deep_pages_equal_a_sort(spark, monkeypatch, kind):
    monkeypatch.setattr(R, "NEAR", 5)
    monkeypatch.setattr(R, "CELLS", 4)
    r, start = random.Random(2), datetime(1969, 12, 20)
    rows = [(f"{r.randrange(400):x}", r.choice([None, start, start + timedelta(days=r.randrange(30), seconds=r.randrange(3))])) for _ in range(300)]
    df = spark.createDataFrame(rows, "id string, created_at timestamp").withColumn("created_at", F.col("created_at").cast(kind)).repartition(3).cache()
    times = [(x.id, x.created_at) for x in df.collect()]
    want = sorted(times, key=lambda x: x[0])
    want = [x for x in want if x[1] is None] + sorted((x for x in want if x[1] is not None), key=lambda x: x[1], reverse=True)
    for number in (1, 2, 3, 9, 11, 12, 20, 29, 30, 31, 40):
        assert [(x.id, x.created_at) for x in R.page(df, number).collect()] == want[number * 10 - 10 : number * 10], number
    assert R.page(df.limit(0), 9).count() == 0


def test_entities_from_json(spark):
    rows = [('{"names": ["A", null], "dates": []}',), ('{"names": "A"}',), ("{bad",), (None,), ("{}",)]
    got = [r.e for r in spark.createDataFrame(rows, "j string").select(tables.decode_entities(F.col("j")).alias("e")).collect()]
    assert got[0].names == ["A", None] and got[0].dates == [] and got[0].areas is None and got[0]._corrupt is None
    assert got[1]._corrupt == '{"names": "A"}' and got[2]._corrupt == "{bad" and got[3] is None and got[4]._corrupt is None


def test_assignments_and_their_entries(spark):
    flows = spark.createDataFrame([("1",), ("2",)], "id string")
    asked = spark.createDataFrame([("1", "u", "a", datetime(2024, 1, 1), 1), ("1", "u", "b", datetime(2024, 1, 1), 2), ("9", "u", "c", datetime(2024, 1, 1), 3)], "id string, user_id string, assignee string, ts timestamp, event long")
    state, entries = W.assign_workflows(flows, asked)
    assert {r.id: (r.assignee, r.assignments) for r in state.collect()} == {"1": ("b", 2), "2": (None, 0)}
    assert sorted((r.entity_id, r.action, r.new_values) for r in entries.collect()) == [("1", "workflow_assigned", '{"assignedTo":"a"}'), ("1", "workflow_assigned", '{"assignedTo":"b"}')]
