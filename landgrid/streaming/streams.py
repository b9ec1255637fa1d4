"""Structured Streaming over event tables, each with the batch result it must equal."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.workflow import MAX_RETRIES, STEPS


#: Named states need this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet file or files at `path`; ts becomes a zoned time, which watermarks need."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern it may name a single file
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.fieldNames() else stream


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is available now, written to `folder` (shared by all executors) and read back.

    Output of later micro-batches is kept beside earlier ones; each batch's folder is
    overwritten if the batch is run again, so a restart leaves no duplicates.
    """
    out, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    spark.conf.set(*STATE_STORE)
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def newest(df: DataFrame, *keys: str) -> DataFrame:
    """Of updates for the same keys, the one of the last micro-batch."""
    values = [c for c in df.columns if c not in (*keys, "_batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")


def audit_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Entries once each: repeats of an event_id within the delay are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def processing_rates(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events per window and action; late rows beyond the delay are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))


def _group(key: str, groups: int) -> Column:
    """Keys are dealt over so many groups with one state each, so Python is called per group and not per key; those without key are group -1."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups))).cast("int")


def _held(state, columns: dict[str, str]) -> pd.DataFrame:
    """The rows that a value state holds as Arrow bytes."""
    if not state.exists():
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})
    with pa.ipc.open_stream(bytes(state.get()[0])) as reader:
        return reader.read_pandas()


def _hold(state, rows: pd.DataFrame) -> None:
    if rows.empty:
        state.clear()
        return
    sink, table = pa.BufferOutputStream(), pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))


class BatchProgress(StatefulProcessor):
    """Counts the items of a group's batches, each once, and tells a batch when it is full: one time, whatever comes later."""

    ITEMS, TOLD = {"batch_id": "int64", "item": "object", "outcome": "object", "last": "int64"}, {"batch_id": "int64", "at": "int64"}

    def __init__(self, idle: int, keep: int):
        self.idle, self.keep = idle, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getValueState("items", "rows binary")
        self.told = handle.getValueState("told", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows), ignore_index=True)
        told, before, now = _held(self.told, self.TOLD), _held(self.items, self.ITEMS), int(frames["arrived_ms"].max())
        ended = frames[~frames["batch_id"].isin(told["batch_id"])]
        both = pd.concat([before, ended[["batch_id", "item", "outcome"]].assign(last=now)], ignore_index=True)
        new = pd.Series(both.index >= len(before))
        once = ~both.duplicated(["batch_id", "item"])  # the first end of an item counts
        both, new = both[once], new[once]
        if not new.any():
            return
        touched = both["batch_id"].isin(both["batch_id"][new])
        both.loc[touched, "last"] = now
        counts = both[touched].assign(processed=both["outcome"] == "completed", failed=both["outcome"] == "failed").groupby("batch_id", as_index=False)[["processed", "failed"]].sum()
        totals = ended.drop_duplicates("batch_id").set_index("batch_id")["total"]
        full = counts[counts["processed"] + counts["failed"] >= counts["batch_id"].map(totals)]
        _hold(self.items, both[~both["batch_id"].isin(full["batch_id"])])
        if len(full) < len(counts):
            self.handle.registerTimer(now + self.idle)
        if full.empty:
            return
        _hold(self.told, pd.concat([told, full[["batch_id"]].assign(at=now)], ignore_index=True))
        self.handle.registerTimer(now + self.keep)
        yield full

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, told, items = expiredTimerInfo.getExpiryTimeInMs(), _held(self.told, self.TOLD), _held(self.items, self.ITEMS)
        _hold(self.told, told[told["at"] + self.keep > now])
        _hold(self.items, items[items["last"] + self.idle > now])  # else something came since
        return iter(())

    def close(self) -> None:
        pass


def batch_progress_stream(items: DataFrame, totals: DataFrame, idle: str = "7 days", keep: str = "365 days", groups: int = 1024) -> DataFrame:
    """(batch_id, processed, failed): one row per batch, once, when all its items are done.

    `items` is a stream (batch_id, item string, outcome); `totals` a table (batch_id, total).
    Items that have not ended count for nothing; of one item its first end counts. Items
    and counts are forgotten when nothing new came for `idle`; that a batch was told is
    known for `keep`, so no later or repeated item begins it anew, in a restart either.
    A micro-batch reads and writes the states of the `groups` that its batches are in.
    """
    ended = items.where(F.col("outcome").isin("completed", "failed"))
    states = _arriving(ended).join(totals, "batch_id").withColumn("_group", _group("batch_id", groups)).groupBy("_group")
    return states.transformWithStateInPandas(BatchProgress(_millis(idle), _millis(keep)), "batch_id long, processed long, failed long", "Append", "EventTime")


def _arriving(items: DataFrame) -> DataFrame:
    """`items` with the time of their micro-batch as event time, so that idle states can end and no item is late."""
    return items.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds").withColumn("arrived_ms", F.unix_millis("arrived"))


class Retries(StatefulProcessor):
    """Counts the failures of a group's documents, and keeps which of their events were counted."""

    EVENTS = {"document_id": "int64", "event": "object", "last": "int64"}

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getValueState("events", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows), ignore_index=True)
        before, now = _held(self.events, self.EVENTS), int(frames["arrived_ms"].max())
        both = pd.concat([before, frames[["document_id", "event"]].assign(last=now)], ignore_index=True)
        new = pd.Series(both.index >= len(before))
        both = both[~both.duplicated(["document_id", "event"])]
        both = both[both.groupby("document_id").cumcount() <= MAX_RETRIES]  # what comes after the last failure changes nothing
        new = new[both.index]
        if not new.any():
            return
        touched = both["document_id"].isin(both["document_id"][new])
        both.loc[touched, "last"] = now
        _hold(self.events, both)
        self.handle.registerTimer(now + self.idle)
        out = both[touched].groupby("document_id").size().astype("int32").rename("attempts").reset_index()
        out["state"] = (out["attempts"] > MAX_RETRIES).map({True: "failed", False: "queued"})
        yield out.astype({"document_id": "object"}).assign(document_id=None) if key[0] < 0 else out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = _held(self.events, self.EVENTS)
        _hold(self.events, events[events["last"] + self.idle > expiredTimerInfo.getExpiryTimeInMs()])
        return iter(())

    def close(self) -> None:
        pass


def workflow_stream(events: DataFrame, delay: str = "10 minutes", due: str = "14 days", keep: str = "365 days") -> DataFrame:
    """State per claim: (claim, steps_done, status, attempts, overdue), whenever it changes.

    Events (claim, event_id, ts, outcome) wait until the watermark, `delay` behind the
    newest one, has passed them, and are taken in order of time, then id, whatever
    micro-batch brought them; repeats of a waiting event_id count once; later ones than
    the watermark are dropped. A claim that is not completed `due` after its last event is
    told once more, as overdue. The state of a claim ends `keep` after its last event.
    """
    n, wait, held = len(STEPS), _millis(due), _millis(keep)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, status, attempts, last, told, times, ids, outcomes = state.get if state.exists else (0, "pending", 0, 0, False, [], [], [])
        now = state.getCurrentWatermarkMs()
        waiting = {i: (t, i, o) for t, i, o in zip(times, ids, outcomes, strict=True)}
        for f in () if state.hasTimedOut else frames:
            waiting |= {i: (t, i, o) for t, i, o in zip(f["micros"].tolist(), f["event_id"].tolist(), f["outcome"].tolist(), strict=True) if t > now * 1000}
        ready, rest = sorted(w for w in waiting.values() if w[0] <= now * 1000), sorted(w for w in waiting.values() if w[0] > now * 1000)
        for t, _, outcome in ready:
            last, told = max(last, t), False
            if done < n:
                attempts += 1
                done += outcome == "completed"
                status = "completed" if done >= n else "on_hold" if outcome == "failed" else "in_progress"
        overdue = bool(not rest and last and not told and done < n and now >= last // 1000 + wait)
        told = told or overdue
        if ready or overdue:
            yield pd.DataFrame({"claim": [key[0]], "steps_done": [int(done)], "status": [status], "attempts": [attempts], "overdue": [overdue]})
        if not rest and (not last or now >= last // 1000 + held):
            if state.exists:
                state.remove()
            return
        state.update((int(done), status, attempts, last, told, [w[0] for w in rest], [w[1] for w in rest], [w[2] for w in rest]))
        timer = -(-rest[0][0] // 1000) if rest else last // 1000 + (held if told or done >= n else wait)
        state.setTimeoutTimestamp(max(timer, now + 1))

    kept = "steps_done int, status string, attempts long, last long, told boolean, times array<long>, ids array<long>, outcomes array<string>"
    timed = events.withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))  # the same in any session's time zone
    return timed.groupBy("claim").applyInPandasWithState(fold, "claim string, steps_done int, status string, attempts long, overdue boolean", kept, "update", GroupStateTimeout.EventTimeTimeout)


def retry_stream(items: DataFrame, idle: str = "7 days", groups: int = 1024) -> DataFrame:
    """(document_id, attempts, state) after each micro-batch that changes it; a failure beyond the retries is final.

    `items` is a stream (document_id, event string, outcome). Failures told twice count once. A document's count ends
    when it has not failed for `idle`. A micro-batch reads and writes the states of the `groups` that its documents are in.
    """
    failed = _arriving(items.where("outcome = 'failed'")).withColumn("_group", _group("document_id", groups)).withColumn("document_id", F.coalesce("document_id", F.lit(0))).groupBy("_group")
    return failed.transformWithStateInPandas(Retries(_millis(idle)), "document_id long, attempts int, state string", "Update", "EventTime")


def _millis(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def new_folder(base: str, name: str) -> str:
    return f"{base}/{name}-{uuid.uuid4().hex}"
