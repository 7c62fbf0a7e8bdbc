"""The append logs as streams. Watermarks are the retention time: rows older than it would be deleted anyway."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import stored as St
from ..operators.reconcile import relation_rows, statistic_rows
from ..plans.stage import staged

CALL = "call_id string, tool string, status string, started_at timestamp, completed_at timestamp, duration_ms double"


class LastRow(StatefulProcessor):
    """Keeps the last row of a key, by its order and then its text, and hands it on when it is new. A row that was seen before, or is older, changes nothing."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "place long, body string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        newest = max((r.place, r.body) for r in rows)
        if not self.last.exists() or newest > tuple(self.last.get()):
            self.last.update(newest)
            yield Row(name=key[0], place=newest[0], body=newest[1])

    def close(self) -> None:
        pass


def stream_pages(pages: DataFrame, key: str, order: str, retention: str | None = None) -> DataFrame:
    """The rows of typed pages, with their arrays of links, that change what was known of their key: the last row by the number `order` wins, and a replay of pages gives none. Rows
    without a key are left out. State is one row a key, which with a retention is given up that long after its last change; that needs a trigger by time, as
    Spark then runs batches without data. Needs the RocksDB state store."""
    schema = pages.drop(order).schema
    body = F.to_json(F.struct(*[f.name for f in schema]), {"ignoreNullFields": "false"})
    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("name"), F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 62))).alias("place"), body.alias("body"))
    ttl = None if retention is None else int(pd.Timedelta(retention).total_seconds() * 1000)
    changed = rows.groupBy("name").transformWithState(LastRow(ttl), "name string, place long, body string", "Update", "None" if ttl is None else "ProcessingTime")
    return changed.select(F.from_json("body", schema).alias("r")).select("r.*")


def write_pages(changes: DataFrame, tables: dict[str, str], refresh_id: str, relations: dict[str, tuple[str, str]] | None = None, statistics: str | None = None):
    """A writer of changed track rows into stored tables (see operators.stored): `tables` names tracks and, by the array column they come from, the tables of links. relations gives of
    such a column (link table's owner, target) and statistics the column of (source, ...) structs. A batch that runs again gives the same tables."""
    relations = relations or {}

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = staged(batch)
        if batch.isEmpty():
            return
        own = batch.drop(*relations, *([statistics] if statistics else []))
        for column, (owner, target) in relations.items():
            St.replace_owned(spark, tables[column], batch.select(F.col("source_id").alias(owner)), relation_rows(batch, owner, column, target), owner)
        if statistics:
            St.replace_owned(spark, tables[statistics], batch.select(F.col("source_id").alias("track_id")), statistic_rows(batch, "track_id", statistics), "track_id")
        St.upsert_table(spark, tables["tracks"], own, "source_id", refresh_id)

    return changes.writeStream.foreachBatch(apply).outputMode("update")


def _calls(timeout_ms: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State is the start of a call. The first completion of a started call ends it; later events of the call are ignored."""
    done, tool, start = state.get if state.exists else (False, None, None)
    if state.hasTimedOut:
        if not done and start is not None:
            yield pd.DataFrame([(key[0], tool, "Interrupted", pd.Timestamp(start, unit="us"), pd.NaT, float("nan"))], columns=["call_id", "tool", "status", "started_at", "completed_at", "duration_ms"])
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values(["at", "event"], ascending=[True, False])
    out, known = [], start
    starts = rows["event"] == "started"
    if start is None and starts.any():
        first = rows[starts].iloc[0]
        tool, start = first["tool"], first["at"].value // 1000
    # The first completion that stands after the start, in the order of times.
    ends = rows[~starts & (starts.cumsum() > 0)] if known is None else rows[~starts]
    if start is not None and not done and len(ends):
        done, began, end = True, pd.Timestamp(start, unit="us"), ends.iloc[0]
        at = end["at"].tz_localize(None)
        out.append((key[0], tool, end["event"].capitalize(), began, at, max(0.0, (at - began).total_seconds() * 1000)))
    state.update((done, tool, start))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(rows["at"].max().value // 1_000_000) + timeout_ms))
    yield pd.DataFrame(out, columns=["call_id", "tool", "status", "started_at", "completed_at", "duration_ms"])


def stream_tool_calls(events: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """events (call_id, tool, event: started, completed or failed, at) as one row per finished call; a call without an end by the timeout is Interrupted."""
    timeout_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def calls(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _calls(timeout_ms, key, batches, state)

    return events.withWatermark("at", timeout).groupBy("call_id").applyInPandasWithState(calls, CALL, "done boolean, tool string, start long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_selections(candidates: DataFrame, selections: DataFrame, retention: str = "90 days") -> DataFrame:
    """(correlation_id, observation_id, position, selected_at): the first selection of each candidate that came before it."""
    shown = candidates.withWatermark("shown_at", retention)
    chosen = selections.withWatermark("selected_at", retention).dropDuplicatesWithinWatermark(["correlation_id"]).withColumnRenamed("correlation_id", "_id")
    both = shown.join(chosen, F.expr(f"correlation_id = _id and selected_at >= shown_at and selected_at <= shown_at + interval {retention}"))
    return both.select("correlation_id", "observation_id", "position", "selected_at")


def stream_errors(events: DataFrame, retention: str = "90 days") -> DataFrame:
    """Errors with a report id, each id once, and all errors without one."""
    timed = events.withWatermark("at", retention)
    return timed.where("report_id is not null").dropDuplicatesWithinWatermark(["report_id"]).unionByName(timed.where("report_id is null"))
