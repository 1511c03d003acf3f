"""Assembling streamed answers: one state per request, finished by the end mark, an error or one of two timers."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lectern.functions import text as t
from lectern.operators.responses import event_error, event_piece

OUTPUT = "request_id long, content string, error_kind string, detail string"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Stream lines (request_id, seq, line, ts) -> request_id, seq, piece, error, done, ts, and whether the line ``counts`` as an event."""
    data = t.trim_ws(F.regexp_replace("line", r"\Adata:", ""))
    held = F.coalesce(F.startswith("line", F.lit("data:")) & (F.col("_data") != ""), F.lit(False))
    events = (
        lines.withColumn("_data", data).withColumn("done", held & (F.col("_data") == "[DONE]"))
        .withColumn("_event", F.when(held & ~F.col("done"), t.strict_json("_data")))
        .withColumn("counts", F.col("done") | F.col("_event").isNotNull())
    )
    return events.select(
        "request_id", "seq", F.when(F.col("done"), "").otherwise(event_piece(F.col("_event"))).alias("piece"),
        event_error(F.col("_event")).alias("error"), "done", "ts", "counts")


PIECES = "seq bigint, piece string"
PROGRESS = "end bigint, first bigint, latest bigint, idle_at bigint, told boolean, closed boolean"
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AnswerProcessor(StatefulProcessor):
    """One request: its lines as a list state that batches are appended to, a small record of its progress, two timers.

    The idle timer moves with each event, the overall timer stands from the first one. Whichever passes first ends an
    unfinished request. After the end only the record stays, so that later lines are dropped, until the idle time is over.
    """

    def __init__(self, idle_ms: int, overall_ms: int, numbered: bool):
        self.idle_ms, self.overall_ms, self.numbered = idle_ms, overall_ms, numbered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # pieces: null for a line that is no event
        self.pieces = handle.getListState("pieces", PIECES)
        self.progress = handle.getValueState("progress", PROGRESS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.progress.get()
        # told: an event has arrived; a request of comments alone never answers
        end, first, latest, idle_at, told, closed = held or (None, None, None, None, False, False)
        rows = pd.concat(rows).sort_values("seq")
        stamps = rows["ts"].map(lambda t: int(t.timestamp() * 1000))
        if closed:
            self._remember(timerValues, first, max(latest, *stamps))
            return
        started = min([int(stamps.min()), *([] if first is None else [first])])
        in_time = stamps <= started + self.overall_ms
        rows, stamps = rows[in_time], stamps[in_time]
        events = rows[rows["counts"].astype(bool)]
        ends = [int(n) for n in events.loc[events["done"].astype(bool), "seq"]]
        end = min([*ends, *([] if end is None else [end])], default=None)
        errors = [(int(n), e) for n, e in zip(events["seq"], events["error"], strict=True) if e is not None and (end is None or n < end)]
        fresh = [(int(n), (p or "") if c else None) for n, p, c in zip(rows["seq"], rows["piece"], rows["counts"], strict=True)]
        told = told or len(events) > 0
        if not errors and end is not None:
            lines = dict(reversed([*(tuple(r) for r in self.pieces.get()), *fresh]))  # of a repeated line the first counts
            before = {n: p for n, p in lines.items() if n < end}
            if not self.numbered or sum(n >= 0 for n in before) >= end:
                content = "".join(before[n] for n in sorted(before) if before[n] is not None)
                yield self._close(key, timerValues, started, max([latest or 0, *stamps]), content or None, None if content else "empty", None)
                return
        if errors:
            yield self._close(key, timerValues, started, max([latest or 0, *stamps]), None, "http", min(errors)[1])
            return
        if fresh:
            self.pieces.appendList(fresh)
        seen = stamps[events.index] if len(events) else stamps
        latest = max([int(n) for n in seen] + ([] if latest is None else [latest]), default=started)
        if first != started:
            if first is not None:
                self.handle.deleteTimer(first + self.overall_ms)
            self.handle.registerTimer(started + self.overall_ms)
        idle_at = self._moved(idle_at, max(latest, timerValues.getCurrentWatermarkInMs() + 1) + self.idle_ms, started)
        self.progress.update((end, started, latest, idle_at, told, False))

    def _moved(self, old: int | None, new: int, started: int) -> int:
        """Replaces the idle timer; a timer that the overall one coincides with is left to it."""
        if old is not None and old not in (new, started + self.overall_ms):
            self.handle.deleteTimer(old)
        if old != new:
            self.handle.registerTimer(new)
        return new

    def _close(self, key, timerValues, started, latest, content, kind, detail) -> pd.DataFrame:
        self.pieces.clear()
        self._remember(timerValues, started, latest)
        return pd.DataFrame([{"request_id": key[0], "content": content, "error_kind": kind, "detail": detail}])

    def _remember(self, timerValues, started: int, latest: int) -> None:
        """Marks the request as closed until no line has come for the idle time."""
        self._drop_timers()
        over = max(latest, timerValues.getCurrentWatermarkInMs() + 1) + self.idle_ms
        self.handle.registerTimer(over)
        self.progress.update((None, started, latest, over, True, True))

    def _drop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.progress.get()
        _, started, latest, over, told, closed = held or (None, None, None, None, False, True)
        if closed:  # a timer that was due together with the one that closed the request is no end of its memory
            if held is not None and expiredTimerInfo.getExpiryTimeInMs() >= over:
                self.progress.clear()
        elif told:
            yield self._close(key, timerValues, started, latest, None, "timeout", None)
        else:
            self.pieces.clear()
            self.progress.clear()
            self._drop_timers()

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which list states and timers need; the setting is put back."""
    before = spark.conf.get(STORE_SETTING, None)
    spark.conf.set(STORE_SETTING, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE_SETTING)
        else:
            spark.conf.set(STORE_SETTING, before)


def assemble(lines: DataFrame, idle_ms: int, overall_ms: int, delay: str = "0 seconds", numbered: bool = True) -> DataFrame:
    """Answers from a stream of response lines.

    A request is answered once its end mark and all lines before it are there, in whatever order and batches they
    arrive; ``seq`` numbers all lines of a request, events or not, from 0 without gaps, so the end mark's number tells
    whether one is missing. It fails at an error event before the end mark. It fails with ``timeout`` when nothing ended it, or a
    line before its end mark stayed away, for ``idle_ms`` of event time since its last event or ``overall_ms`` since its first
    line, whichever is first; lines after that are left out, so a stream that dribbles on ends too. Lines after the end mark are left out, of repeated
    lines one counts. A request of comment lines alone gives no row. Spark drops lines that are later than ``delay``. Where
    ``seq`` only orders the lines (not ``numbered``) a missing line can't be told: the answer is what has arrived with
    the end mark's batch. State per request is one answer. Start the stream inside ``state_store``.
    """
    return (
        parse_lines(lines).withWatermark("ts", delay).groupBy("request_id")
        .transformWithStateInPandas(AnswerProcessor(idle_ms, overall_ms, numbered), OUTPUT, "Append", "EventTime")
    )


def write_answers(lines: DataFrame, out: str, progress: str, idle_ms: int, overall_ms: int, delay: str = "0 seconds") -> StreamingQuery:
    """Answers of all lines that are available, appended to a folder of Parquet files."""
    with state_store(lines.sparkSession):
        return (assemble(lines, idle_ms, overall_ms, delay).writeStream.format("parquet").outputMode("append").option("path", out)
                .option("checkpointLocation", progress).trigger(availableNow=True).start())
