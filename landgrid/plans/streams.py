"""Streaming queries, run over all that is available; SQL gives the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as T
from .sources import folder
from .workflow import WF

OUTCOME = "CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'other' END"


def _events(s, d):
    return T.read_events(s, f"{d}/events.parquet")


LINE = "concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_suppkey AS STRING), '/', CAST(l_quantity AS STRING), '/', CAST(l_extendedprice AS STRING))"


def _items(s, d):
    lines = T.read_events(s, f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("batch_id"), F.col("l_partkey").alias("document_id"), F.expr(LINE).alias("item"), F.expr(OUTCOME).alias("outcome"))
    return lines.unionAll(lines.where("batch_id % 3 = 0"))  # some are told twice


def _audit(s, d):
    entries = _events(s, d).select("event_id", "ts", "event_type")
    sent = entries.unionAll(entries.where("event_id % 7 < 3"))  # some come twice
    out = T.run_to_end(T.audit_stream(sent), folder(s, "audit-stream"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("event_id").alias("ids"))


def _rates(slide=None):
    def run(s, d):
        out = T.run_to_end(T.processing_rates(_events(s, d), slide=slide), folder(s, "rates"))
        return out.select(F.col("window.start").cast("string").alias("begin"), "event_type", "events", F.round("total", 2).alias("total"))
    return run


def _batches(s, d):
    totals = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.count(F.lit(1)).alias("total"))
    return T.run_to_end(T.batch_progress_stream(_items(s, d).select("batch_id", "item", "outcome"), totals), folder(s, "batches")).drop("_batch")


def _workflow(s, d):
    e = _events(s, d).select("event_id", "ts", F.col("user_id").cast("string").alias("claim"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("outcome"))
    return T.newest(T.run_to_end(T.workflow_stream(e), folder(s, "workflows"), "update"), "claim")


def _retries(s, d):
    return T.newest(T.run_to_end(T.retry_stream(_items(s, d).select("document_id", F.col("item").alias("event"), "outcome")), folder(s, "retries"), "update"), "document_id")


CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
SEEN = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"
PAIRS = {
    "audit_stream": (_audit, "SELECT event_type, count(*) AS entries, count(DISTINCT event_id) AS ids FROM events GROUP BY 1"),
    "processing_rates": (_rates(), f"SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS begin, event_type, count(*) AS events, round(sum(value), 2) AS total FROM (SELECT *, date_trunc('hour', ts) AS b FROM events) WHERE b + INTERVAL 1 HOUR <= {CLOSED} GROUP BY ALL"),
    "processing_rates_sliding": (_rates("30 minutes"), f"SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS begin, event_type, count(*) AS events, round(sum(value), 2) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS b FROM events) WHERE b + INTERVAL 1 HOUR <= {CLOSED} GROUP BY ALL"),
    "batch_progress_stream": (_batches, f"SELECT batch_id, processed, failed FROM (SELECT l_orderkey AS batch_id, count(*) AS total, count(*) FILTER ({OUTCOME} = 'completed') AS processed, count(*) FILTER ({OUTCOME} = 'failed') AS failed FROM lineitem GROUP BY 1) WHERE processed + failed >= total"),
    "workflow_stream": (_workflow, WF.replace("FROM audit)", f"FROM audit WHERE ts <= {SEEN})") + f"SELECT claim, steps_done, status, attempts, status <> 'completed' AND last_ts + INTERVAL 14 DAY <= {SEEN} AS overdue FROM wfs"),
    "retry_stream": (_retries, f"SELECT l_partkey AS document_id, CAST(least(count(*), 4) AS INT) AS attempts, CASE WHEN count(*) > 3 THEN 'failed' ELSE 'queued' END AS state FROM lineitem WHERE {OUTCOME} = 'failed' GROUP BY 1"),
}
