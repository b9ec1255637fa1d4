"""Queries over workflows, audit events and processing queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workflow as W
from ..sources import sinks
from .sources import folder
from .spatial import LINKED, _links
from .views import load, with_views

A = with_views("audit")
LIVE = "ev AS (SELECT *, entity_id AS claim, coalesce(count(*) FILTER (outcome = 'completed') OVER (PARTITION BY entity_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM audit), wf AS (SELECT claim, CAST(count(*) FILTER (outcome = 'completed') AS INT) AS steps_done, max_by(outcome, (ts, id)) AS last, count(*) AS attempts, max(ts) AS last_ts FROM ev WHERE before < 8 GROUP BY claim), wfs AS (SELECT claim, steps_done, ['document_upload', 'ocr_processing', 'ner_extraction', 'spatial_validation', 'field_verification', 'technical_review', 'dss_analysis', 'final_approval'][steps_done + 1] AS step, CASE WHEN steps_done >= 8 THEN 'completed' WHEN last = 'failed' THEN 'on_hold' ELSE 'in_progress' END AS status, attempts, last_ts, steps_done >= 8 AS approved FROM wf)"
WF = A.rstrip() + ", " + LIVE + "\n"
PRIORITY = "CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'urgent' END"
DUE = f"CAST(created_at AS DATE) + CAST(CASE {PRIORITY} WHEN 'urgent' THEN 3 WHEN 'high' THEN 7 WHEN 'medium' THEN 14 ELSE 21 END AS INT)"
Q = with_views("queue")
BATCHES = "b AS (SELECT batch_id, count(*) AS total, count(*) FILTER (outcome = 'completed') AS processed, count(*) FILTER (outcome = 'failed') AS failed, max(ts) FILTER (outcome IN ('completed', 'failed')) AS last FROM queue GROUP BY batch_id), bp AS (SELECT batch_id, total, processed, failed, processed + failed >= total AS completed, CASE WHEN processed + failed >= total THEN last END AS completed_at FROM b)"


def events(s, d):
    """Only some claims have events; a workflow's events are those of its entity."""
    return load(s, d, "audit").withColumnRenamed("entity_id", "claim")


def workflows(s, d):
    return W.advance(events(s, d))


def _linked_sql(rest):
    return LINKED.replace("WITH ", A.rstrip() + ", ", 1).rstrip() + ", " + LIVE + " " + rest


REVIEW = "r AS (SELECT c.id, steps_done >= 4 AS documented, coalesce(k.confidence > 7e-1, false) AS placed, claimant_name IS NOT NULL AND area IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AS consistent, coalesce(claim_type IN ('IFR', 'CFR', 'CR'), false) AS compliant FROM claims c JOIN wfs ON c.id = claim LEFT JOIN links k ON c.id = k.id)"
FLOOR_SECONDS = "coalesce(CAST(floor((epoch_us(ts) - epoch_us(prev)) / 1000000) AS BIGINT), -1)"


#: A job's events: the lines of an order, in their order.
KIND = "CASE outcome WHEN 'failed' THEN 'failed' WHEN 'queued' THEN CASE WHEN item % 4 = 1 THEN 'single' ELSE 'batch' END ELSE 'started' END"
ASKED = "CASE WHEN item % 5 <> 2 THEN priority END"
REPLAY = (
    Q.rstrip() + f", e AS (SELECT batch_id AS job, {KIND} AS kind, {ASKED} AS asked, seq, tiebreak FROM queue), "
    "j AS (SELECT job, max_by(kind, (seq, tiebreak)) AS kind, max_by(seq, (seq, tiebreak)) AS seq, max_by(tiebreak, (seq, tiebreak)) AS tiebreak, count(*) FILTER (kind = 'failed') AS attempts, "
    "max_by(coalesce(asked, CASE kind WHEN 'single' THEN 'high' ELSE 'normal' END), (seq, tiebreak)) FILTER (kind IN ('batch', 'single')) AS asked FROM e GROUP BY job), "
    "i AS (SELECT job, CASE kind WHEN 'failed' THEN 'low' ELSE asked END AS priority, CASE kind WHEN 'failed' THEN 'retry' ELSE kind END AS entry, attempts, seq, tiebreak FROM j WHERE kind IN ('batch', 'single') OR kind = 'failed' AND attempts <= 3) "
    "SELECT job, priority, entry, attempts, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, CASE entry WHEN 'single' THEN 0 ELSE 1 END, CASE entry WHEN 'single' THEN -seq ELSE seq END, CASE entry WHEN 'single' THEN tiebreak END DESC, tiebreak) AS position FROM i"
)


def _replay(s, d):
    return W.queue_replay(load(s, d, "queue").select(F.col("batch_id").alias("job"), F.expr(KIND).alias("kind"), F.expr(ASKED).alias("priority"), "seq", "tiebreak"))


def _assigned(s, d):
    a = load(s, d, "audit").where("entity_type <> 'recommendation'").select(F.col("entity_id").alias("id"), "user_id", F.col("user_id").alias("assignee"), "ts", F.col("id").alias("event"))
    return W.assign_workflows(load(s, d, "claims").select("id"), a)


def _workflow_audit(s, d):
    """Entries of started and of assigned workflows, in one store."""
    path = folder(s, "workflow-audit")
    sinks.append_audit(W.start_workflows(load(s, d, "claims"))[1], path)
    sinks.append_audit(_assigned(s, d)[1], path)
    return s.read.parquet(path).select("entity_id", "action", "user_id", F.col("day").cast("string").alias("day"), "new_values")


PAIRS = {
    "queue_replay": (_replay, REPLAY),
    "assign_workflows": (lambda s, d: _assigned(s, d)[0], with_views("claims", "audit").rstrip() + ", l AS (SELECT entity_id, max_by(user_id, (ts, id)) AS assignee, count(*) AS assignments FROM audit WHERE entity_type <> 'recommendation' GROUP BY 1) SELECT id, assignee, coalesce(assignments, 0) AS assignments FROM claims LEFT JOIN l ON id = entity_id"),
    "workflow_audit": (_workflow_audit, with_views("claims", "audit") + "SELECT id AS entity_id, 'workflow_initialized' AS action, 'system' AS user_id, CAST(CAST(created_at AS DATE) AS STRING) AS day, concat('{\"priority\":\"medium\",\"estimatedCompletion\":\"', CAST(CAST(created_at AS DATE) + 14 AS STRING), '\"}') AS new_values FROM claims UNION ALL SELECT entity_id, 'workflow_assigned', user_id, CAST(CAST(ts AS DATE) AS STRING), concat('{\"assignedTo\":\"', user_id, '\"}') FROM audit WHERE entity_type <> 'recommendation' AND entity_id IN (SELECT id FROM claims)"),
    "workflow_steps": (lambda s, d: W.step_load(workflows(s, d)), WF.rstrip() + ", st(ord, step, required) AS (VALUES (1, 'document_upload', true), (2, 'ocr_processing', true), (3, 'ner_extraction', true), (4, 'spatial_validation', true), (5, 'field_verification', true), (6, 'technical_review', true), (7, 'dss_analysis', false), (8, 'final_approval', true)) SELECT ord, st.step, required, count(wfs.step) AS workflows FROM st LEFT JOIN wfs ON st.step = wfs.step GROUP BY ALL"),
    "init_workflows": (lambda s, d: W.init_workflows(load(s, d, "claims")).select("id", "ord", "step", "required", "status", "priority", F.col("due").cast("string").alias("due")), with_views("claims").rstrip() + ", st AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {str(r).lower()})" for i, (n, r) in enumerate(W.STEPS, 1)) + ") t(ord, step, required)) SELECT id, ord, step, required, 'pending' AS status, 'medium' AS priority, CAST(CAST(created_at AS DATE) + 14 AS STRING) AS due FROM claims, st"),
    "eta_by_priority": (lambda s, d: load(s, d, "claims").select("id", W.eta(F.col("created_at"), F.expr(PRIORITY)).cast("string").alias("due")), with_views("claims") + f"SELECT id, CAST({DUE} AS STRING) AS due FROM claims"),
    "advance_workflow": (workflows, WF + "SELECT * FROM wfs"),
    "escalate": (lambda s, d: load(s, d, "claims").select("id", W.escalate(F.expr(PRIORITY), F.expr("CAST(id AS BIGINT) % 3")).alias("priority")), with_views("claims") + "SELECT id, ['low', 'medium', 'high', 'urgent'][least(4, CAST(id AS BIGINT) % 4 + 1 + CAST(id AS BIGINT) % 3)] AS priority FROM claims"),
    "assign": (lambda s, d: events(s, d).where("action = 'signup'").groupBy("claim").agg(F.max_by("user_id", F.struct("ts", "id")).alias("assignee"), F.count(F.lit(1)).alias("assignments")), A + "SELECT entity_id AS claim, max_by(user_id, (ts, id)) AS assignee, count(*) AS assignments FROM audit WHERE action = 'signup' GROUP BY 1"),
    "field_visit_schedule": (lambda s, d: load(s, d, "audit").where("action = 'view'").select("id", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("visit_due")), A + "SELECT id, ts + INTERVAL 7 DAY AS visit_due FROM audit WHERE action = 'view'"),
    "technical_review": (lambda s, d: W.technical_review(load(s, d, "claims"), workflows(s, d), _links(s, d)), _linked_sql("") .rstrip() + ", " + REVIEW + " SELECT *, documented AND placed AND consistent AND compliant AS passed FROM r"),
    "final_approval": (lambda s, d: W.final_approval(workflows(s, d), _links(s, d)), _linked_sql("SELECT claim AS id, steps_done, CASE WHEN steps_done >= 6 AND linked_village IS NOT NULL THEN 'approved' ELSE 'rejected' END AS decision FROM wfs LEFT JOIN links ON links.id = claim")),
    "overdue_workflows": (lambda s, d: W.overdue(load(s, d, "claims"), workflows(s, d), F.expr(PRIORITY), "1998-01-01").withColumn("due", F.col("due").cast("string")), with_views("claims", "audit").rstrip() + ", " + LIVE + f", u AS (SELECT id, {DUE} AS due FROM claims) SELECT id, CAST(due AS STRING) AS due, coalesce(status, 'pending') AS status FROM u LEFT JOIN wfs ON claim = id WHERE coalesce(status, 'pending') <> 'completed' AND due < DATE '1998-01-01'"),
    "queue_order": (lambda s, d: W.queue_order(load(s, d, "queue")).select("batch_id", "item", "tiebreak", "position"), Q + "SELECT batch_id, item, tiebreak, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, seq, tiebreak) AS position FROM queue WHERE outcome = 'queued'"),
    "retry_classification": (lambda s, d: W.retries(load(s, d, "queue")), Q.rstrip() + ", f AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts, tiebreak) AS attempt FROM queue WHERE outcome = 'failed'), l AS (SELECT document_id, CAST(max(attempt) AS INT) AS attempts, max_by(error, attempt) AS error FROM f WHERE attempt <= 4 GROUP BY 1) SELECT document_id, attempts, CASE WHEN attempts > 3 THEN 'failed' ELSE 'queued' END AS state, CASE WHEN attempts <= 3 THEN 'low' END AS priority, CASE WHEN attempts > 3 THEN error END AS error FROM l"),
    "workflow_current_step": (lambda s, d: W.current_step(events(s, d)), A.rstrip() + f", e AS (SELECT *, lag(ts) OVER w AS prev, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, id DESC) AS n FROM audit WINDOW w AS (PARTITION BY entity_id ORDER BY ts, id)) SELECT entity_id AS claim, id AS event, action, outcome, {FLOOR_SECONDS} AS seconds FROM e WHERE n = 1"),
    "audit_timeline": (lambda s, d: W.timeline(load(s, d, "audit")), A.rstrip() + f", e AS (SELECT *, lag(ts) OVER w AS prev, lag(new_values) OVER w AS old_values FROM audit WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY ts, id)) SELECT id, entity_type, entity_id, action, old_values, new_values, {FLOOR_SECONDS} AS seconds FROM e"),
    "batch_progress": (lambda s, d: W.batch_progress(load(s, d, "queue")), Q.rstrip() + f", {BATCHES} SELECT * FROM bp"),
    "queue_stats": (lambda s, d: W.queue_stats(load(s, d, "queue")), Q.rstrip() + f", {BATCHES} SELECT (SELECT count(*) FROM queue WHERE outcome = 'queued') AS queued, (SELECT count(*) FROM queue WHERE outcome = 'processing') AS processing, (SELECT count(*) FROM queue WHERE outcome = 'completed') AS completed, (SELECT count(*) FROM queue WHERE outcome = 'failed') AS failed, (SELECT count(*) FROM bp WHERE NOT completed) AS active_batches, (SELECT count(*) FROM bp WHERE completed) AS completed_batches"),
    "document_completeness": (lambda s, d: W.document_completeness(load(s, d, "claims"), load(s, d, "papers")), with_views("claims", "papers") + "SELECT c.id AS claim_id, count(p.id) AS documents, coalesce(string_agg(DISTINCT document_type, ',' ORDER BY document_type), '') AS types, coalesce(bool_and(file_size > 0), false) AS complete FROM claims c LEFT JOIN papers p ON p.claim_id = c.id GROUP BY c.id"),
    "ocr_claim_summary": (lambda s, d: load(s, d, "papers").groupBy("claim_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg(F.coalesce("ocr_confidence", F.lit(0.0))), 6).alias("mean_confidence")), with_views("papers") + "SELECT claim_id, count(*) AS documents, round(avg(coalesce(ocr_confidence, 0)), 6) AS mean_confidence FROM papers GROUP BY 1"),
    "ocr_stats": (lambda s, d: W.ocr_stats(load(s, d, "papers")).withColumn("languages", F.array_join(F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")), with_views("papers") + "SELECT (SELECT count(*) FROM papers WHERE processed) AS total_processed, (SELECT round(avg(processing_time), 6) FROM papers) AS mean_time, (SELECT round(avg(ocr_confidence), 6) FROM papers) AS mean_confidence, (SELECT string_agg(concat(ocr_language, '=', n), ',' ORDER BY ocr_language) FROM (SELECT ocr_language, count(*) AS n FROM papers GROUP BY 1)) AS languages"),
}
