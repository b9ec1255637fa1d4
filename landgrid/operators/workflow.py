"""Verification workflows, audit history, queues and batches over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Fixed values: (step, required), in order.
STEPS = (("document_upload", True), ("ocr_processing", True), ("ner_extraction", True), ("spatial_validation", True), ("field_verification", True), ("technical_review", True), ("dss_analysis", False), ("final_approval", True))
PRIORITIES = ("low", "medium", "high", "urgent")
DAYS = {"urgent": 3, "high": 7, "medium": 14, "low": 21}
MAX_RETRIES = 3
QUEUE_RANK = {"high": 0, "normal": 1, "low": 2}


def _steps() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("step"), F.lit(r).alias("required")) for i, (n, r) in enumerate(STEPS, 1)])


def step_load(workflows: DataFrame) -> DataFrame:
    """(ord, step, required, workflows): all steps in order, with the number of workflows that stand at each."""
    at = workflows.where("step is not null").groupBy("step").agg(F.count(F.lit(1)).alias("workflows"))
    steps = workflows.sparkSession.range(1).select(F.explode(_steps()).alias("s")).select("s.*")
    return F.broadcast(steps).join(at, "step", "left").select("ord", "step", "required", F.coalesce("workflows", F.lit(0).cast("long")).alias("workflows"))


def init_workflows(claims: DataFrame, priority: str = "medium") -> DataFrame:
    """One pending row per claim and step; no shuffle."""
    return claims.select("id", "created_at", F.explode(_steps()).alias("s")).select("id", "s.ord", "s.step", "s.required", F.lit("pending").alias("status"), F.lit(priority).alias("priority"), eta(F.col("created_at"), F.lit(priority)).alias("due"))


def audit_entries(changes: DataFrame, action: str, by: Column, at: Column, **values: Column) -> DataFrame:
    """(entity_type, entity_id, action, user_id, ts, new_values) for each changed workflow of `changes` (id): entries of the audit store."""
    return changes.select(F.lit("claim").alias("entity_type"), F.col("id").alias("entity_id"), F.lit(action).alias("action"), by.alias("user_id"), at.cast("timestamp_ntz").alias("ts"), F.to_json(F.struct(*[c.alias(n) for n, c in values.items()])).alias("new_values"))


def start_workflows(claims: DataFrame, priority: str = "medium") -> tuple[DataFrame, DataFrame]:
    """(step rows of init_workflows, an audit entry for each claim)."""
    due = eta(F.col("created_at"), F.lit(priority)).cast("string")
    entries = audit_entries(claims, "workflow_initialized", F.lit("system"), F.col("created_at"), priority=F.lit(priority), estimatedCompletion=due)
    return init_workflows(claims, priority), entries


def assign_workflows(workflows: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`workflows` (id, ...) with assignee and assignments, an audit entry for each assignment (id, user_id, assignee, ts, event)).

    The last assignment of a workflow counts; those of unknown workflows are left out.
    """
    known = assignments.join(workflows.select("id").hint("merge"), "id", "left_semi")
    last = assignments.groupBy("id").agg(F.max_by("assignee", F.struct("ts", "event")).alias("assignee"), F.count(F.lit(1)).alias("assignments"))
    state = workflows.join(last.hint("merge"), "id", "left").withColumn("assignments", F.coalesce("assignments", F.lit(0)))
    return state, audit_entries(known, "workflow_assigned", F.col("user_id"), F.col("ts"), assignedTo=F.col("assignee"))


def eta(start: Column, priority: Column) -> Column:
    """Start plus the days of the priority, as a date."""
    days = F.lit(DAYS["medium"])
    for name, n in DAYS.items():
        days = F.when(priority == name, n).otherwise(days)
    return F.date_add(start.cast("date"), days)


def escalate(priority: Column, times: Column) -> Column:
    """So many levels up, urgent at most; unknown levels stay."""
    levels = F.array(*[F.lit(p) for p in PRIORITIES])
    at = F.array_position(levels, priority)
    return F.when(at > 0, F.element_at(levels, F.least(at + times, F.lit(len(PRIORITIES))).cast("int"))).otherwise(priority)


def advance(events: DataFrame) -> DataFrame:
    """State per claim after its events (claim, outcome, ts, id): steps done, step now, status, attempts.

    A completed event moves on by a step, a failed one puts the workflow on hold at its
    step; after the last step nothing counts any more. Events are ordered by time,
    then id. The fold is a running count, so no history is gathered in one row.
    """
    order = Window.partitionBy("claim").orderBy("ts", "id")
    done = F.count_if(F.col("outcome") == "completed").over(order.rowsBetween(Window.unboundedPreceding, -1))
    live = events.withColumn("before", F.coalesce(done, F.lit(0))).where(F.col("before") < len(STEPS))
    steps = live.groupBy("claim").agg(F.count_if(F.col("outcome") == "completed").alias("steps_done"), F.max_by("outcome", F.struct("ts", "id")).alias("last"), F.count(F.lit(1)).alias("attempts"), F.max("ts").alias("last_ts"))
    names = F.array(*[F.lit(n) for n, _ in STEPS])
    status = F.when(F.col("steps_done") >= len(STEPS), "completed").when(F.col("last") == "failed", "on_hold").otherwise("in_progress")
    return steps.select("claim", F.col("steps_done").cast("int"), F.get(names, F.col("steps_done").cast("int")).alias("step"), status.alias("status"), "attempts", "last_ts", (F.col("steps_done") >= len(STEPS)).alias("approved"))


def current_step(events: DataFrame) -> DataFrame:
    """Latest event per claim with the seconds since the one before."""
    order = Window.partitionBy("claim").orderBy("ts", "id")
    e = events.withColumn("before", F.lag("ts").over(order))
    last = e.groupBy("claim").agg(F.max_by(F.struct("action", "outcome", "ts", "before", "id"), F.struct("ts", "id")).alias("l"))
    return last.select("claim", F.col("l.id").alias("event"), "l.action", "l.outcome", _seconds("l.before", "l.ts").alias("seconds"))


def _seconds(begin: str, end: str) -> Column:
    """Whole seconds between two times; -1 where there is no earlier one."""
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in (begin, end)]
    return F.coalesce(F.floor((micros[1] - micros[0]) / 1_000_000), F.lit(-1))


def timeline(audit: DataFrame) -> DataFrame:
    """History per entity with the old values and the seconds spent in them."""
    order = Window.partitionBy("entity_type", "entity_id").orderBy("ts", "id")
    a = audit.withColumns({"old_values": F.lag("new_values").over(order), "_before": F.lag("ts").over(order)})
    return a.select("id", "entity_type", "entity_id", "action", "old_values", "new_values", _seconds("_before", "ts").alias("seconds"))


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """`df` with position (from 1) in the total order, without gathering it in one partition.

    Rows are range-partitioned, sorted and kept; a row's position is its place within
    its partition plus the rows of earlier partitions.
    """
    kept = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    kept = kept.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at") % (1 << 33)})
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return kept.join(F.broadcast(starts), "_part").withColumn("position", F.col("_start") + F.col("_row") + 1).drop("_at", "_part", "_row", "_start")


def _rank(priority: Column) -> Column:
    rank = F.lit(len(QUEUE_RANK))
    for name, n in QUEUE_RANK.items():
        rank = F.when(priority == name, n).otherwise(rank)
    return rank


def queue_order(queue: DataFrame) -> DataFrame:
    """Queued items by priority, then arrival."""
    items = queue.where("outcome = 'queued'").select("batch_id", "item", "priority", "seq", "tiebreak", _rank(F.col("priority")).alias("rank"))
    return global_rank(items, F.col("rank"), F.col("seq"), F.col("tiebreak")).drop("rank")


def queue_replay(events: DataFrame) -> DataFrame:
    """The queue after all events (job, kind, priority, seq, tiebreak): job, priority, entry, attempts and position of each job in it.

    Kinds: `batch` enters at the back, `single` at the front, high unless it says otherwise;
    `started` takes a job out; `failed` puts it in again, low and at the back, up to
    three times. The queue is sorted by priority after each event, and that sort keeps the
    order of equals: so of one priority the fronts stand first, the newest leading, then
    the backs as they came. Only a job's last event and its number of failures matter.
    """
    at = F.struct("seq", "tiebreak")
    entered = F.col("kind").isin("batch", "single")
    asked = F.when(entered, F.coalesce("priority", F.when(F.col("kind") == "single", "high").otherwise("normal")))
    jobs = events.groupBy("job").agg(F.max_by(F.struct("kind", "seq", "tiebreak"), at).alias("last"), F.max_by(asked, F.when(entered, at)).alias("asked"), F.count_if(F.col("kind") == "failed").alias("attempts"))
    again = F.col("last.kind") == "failed"
    waiting = jobs.where(F.col("last.kind").isin("batch", "single") | again & (F.col("attempts") <= MAX_RETRIES))
    items = waiting.select("job", F.when(again, "low").otherwise(F.col("asked")).alias("priority"), F.when(again, "retry").otherwise(F.col("last.kind")).alias("entry"), "attempts", "last.seq", "last.tiebreak")
    front = F.col("entry") == "single"
    order = [_rank(F.col("priority")), ~front, F.when(front, -F.col("seq")).otherwise(F.col("seq")), F.desc(F.when(front, F.col("tiebreak"))), F.col("tiebreak")]
    named = items.withColumns({f"_o{i}": c for i, c in enumerate(order) if i != 3}).withColumn("_o3", F.when(front, F.col("tiebreak")))
    placed = global_rank(named, F.col("_o0"), F.col("_o1"), F.col("_o2"), F.col("_o3").desc(), F.col("_o4"))
    return placed.select("job", "priority", "entry", "attempts", "position")


def retries(queue: DataFrame) -> DataFrame:
    """Per document its failures: up to three are queued again as low, the fourth is final with its error."""
    order = Window.partitionBy("document_id").orderBy("ts", "tiebreak")
    f = queue.where("outcome = 'failed'").withColumn("attempt", F.row_number().over(order)).where(F.col("attempt") <= MAX_RETRIES + 1)
    last = f.groupBy("document_id").agg(F.max("attempt").alias("attempts"), F.max_by("error", "attempt").alias("error"))
    final = F.col("attempts") > MAX_RETRIES
    return last.select("document_id", "attempts", F.when(final, "failed").otherwise("queued").alias("state"), F.when(~final, F.lit("low")).alias("priority"), F.when(final, F.col("error")).alias("error"))


def batch_progress(queue: DataFrame) -> DataFrame:
    done = F.col("outcome").isin("completed", "failed")
    b = queue.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "completed").alias("processed"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.max(F.when(done, F.col("ts"))).alias("last"))
    full = F.col("processed") + F.col("failed") >= F.col("total")
    return b.select("batch_id", "total", "processed", "failed", full.alias("completed"), F.when(full, F.col("last")).alias("completed_at"))


def queue_stats(queue: DataFrame) -> DataFrame:
    """One row: items by state, and batches, from one pass over batches."""
    per = batch_progress(queue).agg(F.count_if(~F.col("completed")).alias("active_batches"), F.count_if("completed").alias("completed_batches"))
    items = queue.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("queued", "processing", "completed", "failed")])
    return items.crossJoin(per)  # one row each


def document_completeness(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """Per claim: documents, their types, whether all have content; without documents the step fails."""
    p = papers.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("document_type")), ",").alias("types"), F.bool_and(F.col("file_size") > 0).alias("filled"))
    c = claims.select(F.col("id").alias("claim_id")).join(p.hint("merge"), "claim_id", "left")
    return c.select("claim_id", F.coalesce("n", F.lit(0)).alias("documents"), F.coalesce("types", F.lit("")).alias("types"), F.coalesce("filled", F.lit(False)).alias("complete"))


def ocr_stats(papers: DataFrame) -> DataFrame:
    """One row: processed documents, mean time and confidence, and documents per language as a map."""
    by = papers.groupBy("ocr_language").agg(F.count(F.lit(1)).alias("n"), F.count_if("processed").alias("p"), F.sum("processing_time").alias("t"), F.count("processing_time").alias("tn"), F.sum("ocr_confidence").alias("c"), F.count("ocr_confidence").alias("cn"))
    return by.agg(F.sum("p").alias("total_processed"), F.round(F.sum("t") / F.sum("tn"), 6).alias("mean_time"), F.round(F.sum("c") / F.sum("cn"), 6).alias("mean_confidence"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ocr_language", "n")))).alias("languages"))


def technical_review(claims: DataFrame, workflows: DataFrame, links: DataFrame) -> DataFrame:
    """The four checks of a review, and whether all hold; claims without workflow are left out."""
    j = claims.join(workflows.select(F.col("claim").alias("id"), "steps_done").hint("merge"), "id").join(links.select("id", F.col("confidence").alias("spatial")).hint("merge"), "id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    j = j.select("id", (F.col("steps_done") >= 4).alias("documented"), yes(F.col("spatial") > 0.7).alias("placed"), (F.col("claimant_name").isNotNull() & F.col("area").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("consistent"), yes(F.col("claim_type").isin("IFR", "CFR", "CR")).alias("compliant"))
    return j.withColumn("passed", F.col("documented") & F.col("placed") & F.col("consistent") & F.col("compliant"))


def final_approval(workflows: DataFrame, links: DataFrame) -> DataFrame:
    """approved if all required steps but the last are done, the claim is linked and the review step is done."""
    required = sum(r for _, r in STEPS)
    review = [n for n, _ in STEPS].index("technical_review") + 1
    j = workflows.select(F.col("claim").alias("id"), "steps_done").join(links.select("id", "linked_village").hint("merge"), "id", "left")
    ok = (F.col("steps_done") >= required - 1) & F.col("linked_village").isNotNull() & (F.col("steps_done") >= review)
    return j.select("id", "steps_done", F.when(ok, "approved").otherwise("rejected").alias("decision"))


def overdue(claims: DataFrame, workflows: DataFrame, priority: Column, as_of: str) -> DataFrame:
    """Claims whose workflow is not completed by the date its priority sets."""
    due = claims.select("id", eta(F.col("created_at"), priority).alias("due"))
    j = due.join(workflows.select(F.col("claim").alias("id"), "status"), "id", "left")
    return j.where((F.coalesce("status", F.lit("pending")) != "completed") & (F.col("due") < F.lit(as_of).cast("date"))).select("id", "due", F.coalesce("status", F.lit("pending")).alias("status"))
