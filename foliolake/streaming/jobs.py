"""The job state machine over a stream of events.

Each job's state is folded from its events in order: enqueue, start, pause,
resume, cancel, finish, fail. A queued job that is cancelled ends at once; a
running one ends when it says so.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

OUT = "job_id long, status string, events int"
STATE = "status string, cancel boolean, events int"

# fixed values: (event, status before) -> status after
MOVES = {
    ("enqueue", ""): "queued", ("start", "queued"): "running", ("pause", "running"): "paused", ("pause", "queued"): "paused", ("resume", "paused"): "queued",
    ("cancel", "queued"): "cancelled", ("cancel", "paused"): "cancelled", ("finish", "running"): "complete", ("fail", "running"): "failed",
}


def step(status: str, cancel: bool, event: str) -> tuple[str, bool]:
    """Status and whether a stop is asked for, after an event; events that don't apply change nothing."""
    if event == "cancel" and status == "running":
        return status, True
    to = MOVES.get((event, status), status)
    if cancel and event in ("finish", "pause") and status == "running":
        return "cancelled", False
    return to, cancel


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, cancel, n = state.get if state.exists else ("", False, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"])  # the new events of one job
    for event in rows["event"]:
        status, cancel = step(status, bool(cancel), event)
        n += 1
    state.update((status, cancel, n))
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "events": [n]})


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, events) of a stream (job_id, ts, seq, event), a row for each job that changed in a batch."""
    return events.groupBy("job_id").applyInPandasWithState(fold, OUT, STATE, "update", "NoTimeout")


def idle_models(uses: DataFrame, gap: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """(model_id, start, end, uses): spans of use that end when a model has been idle for ``gap``, from a stream (model_id, ts)."""
    return uses.withWatermark("ts", late).groupBy("model_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("uses")).select("model_id", "w.start", "w.end", "uses")


def activity(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value): events by window, from a stream (ts, event_type, value)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
