"""Running status of jobs from a stream of their events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "seen long, id long, status string"


def latest(events: DataFrame, job: str, ts: str, event_id: str, status: str) -> DataFrame:
    """(job, ts, id, status, n): each job's latest event, by time and then id, and its number of events.

    For a table or a stream: both are merges of partial maxima, so late and out-of-order events, and any split in
    micro-batches, give the same state. Events without a job or a time are left out; a null id is before all others.
    """
    rows = events.where(F.col(job).isNotNull() & F.col(ts).isNotNull())
    newest = F.max(F.struct(F.col(ts).alias("ts"), F.coalesce(F.col(event_id), F.lit(-(2**63))).alias("id"), F.col(status).alias("status"))).alias("m")
    known = F.when(F.col("m.id") > -(2**63), F.col("m.id"))
    return rows.groupBy(F.col(job).alias("job")).agg(newest, F.count("*").alias("n")).select("job", "m.ts", known.alias("id"), "m.status", "n")


def running(stream: DataFrame, job: str, ts: str, event_id: str, status: str, finished: tuple[str, ...], late: str, keep_ms: int) -> DataFrame:
    """(job, ts, id, status, open): the same latest event as keyed state, for streams without an end, in update mode.

    Events may come in any order as long as they are less than `late` behind the newest one; older ones are ignored. A
    job whose latest status is one of `finished` is dropped from the state by a timer, keep_ms of event time after it
    finished, and reported once more with open false; so the state holds unfinished and lately finished jobs alone. A
    later event opens the job anew. An event with the time and id of the state changes nothing, so repeated deliveries
    are harmless. job may be of any type that groups, ids are whole numbers.
    """
    event = F.coalesce(F.col(event_id).cast("long"), F.lit(-(2**63)))
    rows = stream.where(F.col(job).isNotNull() & F.col(ts).isNotNull()).select(F.col(job).alias("job"), F.col(ts).cast("timestamp").alias("ts"), event.alias("id"), F.col(status).alias("status"))
    rows = rows.withWatermark("ts", late).withColumn("seen", F.unix_micros("ts"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "seen": [known[0]], "id": [known[1]], "status": [known[2]], "open": [False]})
            return
        mark = state.getCurrentWatermarkMs() * 1000
        best = known
        for batch in batches:
            batch = batch[batch["seen"] >= mark]
            if len(batch):
                row = batch.sort_values(["seen", "id"], kind="stable").iloc[-1]
                said = None if pd.isna(row["status"]) else str(row["status"])
                if best is None or (int(row["seen"]), int(row["id"])) > (best[0], best[1]):
                    best = (int(row["seen"]), int(row["id"]), said)
        if best is None:
            return
        state.update(best)
        if best[2] in finished:
            state.setTimeoutTimestamp(max(best[0] // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        if best != known:
            yield pd.DataFrame({"job": [key[0]], "seen": [best[0]], "id": [best[1]], "status": [best[2]], "open": [True]})

    kind = rows.schema["job"].dataType.simpleString()
    out = rows.groupBy("job").applyInPandasWithState(update, f"job {kind}, seen long, id long, status string, open boolean", STATE, "update", GroupStateTimeout.EventTimeTimeout)
    known = F.when(F.col("id") > -(2**63), F.col("id"))
    return out.select("job", F.timestamp_micros("seen").cast(stream.schema[ts].dataType).alias("ts"), known.alias("id"), "status", "open")
