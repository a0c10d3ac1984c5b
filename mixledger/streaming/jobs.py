"""Structured Streaming jobs over recognition windows, histories and catalog additions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.timeline import BRIDGE_SECONDS, WINDOW, strength

# How many failing windows in a row stop a listen.
FAILING_IN_A_ROW = 10


def deduplicate(probes: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """Each window of a recognizer once. probes[set_id, provider, ts, ...] with an event time."""
    return probes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["set_id", "provider", "ts"])


def heard_sessions(probes: DataFrame, *, gap: str = "240 seconds", delay: str = "10 minutes") -> DataFrame:
    """Plays of a song per set while listening: windows of one song less than ``gap`` apart.

    probes[set_id, song, ts]; silent windows do not extend a session.
    """
    heard = probes.where(F.col("song").isNotNull()).withWatermark("ts", delay)
    sessions = heard.groupBy("set_id", "song", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("hits"), F.min("ts").alias("start"), F.max("ts").alias("last")
    )
    return sessions.select("set_id", "song", "start", "last", "hits", strength(F.col("hits")).alias("strength"))


RUNS = "set_id string, song string, start double, end double, hits long"


def _placed(runs: list[list[float]], at: float, bridge: float) -> list[list[float]]:
    """Open runs [start, last, hits] of one song with one more hit; runs that it connects become one.

    A hit may come late and lie before, inside or between runs: it joins every run within ``bridge``.
    """
    near = [r for r in runs if r[0] - bridge <= at <= r[1] + bridge]
    far = [r for r in runs if r not in near]
    joined = [min([at, *(r[0] for r in near)]), max([at, *(r[1] for r in near)]), 1 + sum(r[2] for r in near)]
    return sorted([*far, joined])


OPEN = "starts array<double>, lasts array<double>, hits array<bigint>"


def _stored(runs: list[list[float]]) -> tuple:
    return [float(r[0]) for r in runs], [float(r[1]) for r in runs], [int(r[2]) for r in runs]


class RunTracker(StatefulProcessor):
    """The open runs of a song in a set, closed when the watermark is past their last hit and a gap.

    Other songs in between do not end a run, as in the batch rule, so state is kept for each song. It
    holds the runs of the last ``delay`` and gap, whatever their length.
    """

    def __init__(self, bridge: float = BRIDGE_SECONDS, window: float = WINDOW):
        self.bridge, self.window = bridge, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", OPEN)

    def _open(self) -> list[list[float]]:
        return [list(r) for r in zip(*self.runs.get())] if self.runs.exists() else []

    def _keep(self, runs: list[list[float]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if runs:
            self.runs.update(_stored(runs))
            self.handle.registerTimer(int((min(r[1] for r in runs) + self.bridge) * 1000))
        else:
            self.runs.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = self._open()
        for at in pd.concat(list(rows))["at"].dropna().sort_values():
            runs = _placed(runs, float(at), self.bridge)
        self._keep(runs)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() / 1000
        runs = self._open()
        closed = [r for r in runs if r[1] + self.bridge <= due]
        self._keep([r for r in runs if r[1] + self.bridge > due])
        if closed:
            yield _runs_of(key, closed, self.window)

    def close(self) -> None:
        pass


def _runs_of(key: tuple, closed: list[list[float]], window: float) -> pd.DataFrame:
    rows = [(key[0], key[1], float(r[0]), float(r[1]) + window, int(r[2])) for r in closed]
    return pd.DataFrame(rows, columns=["set_id", "song", "start", "end", "hits"])


def closed_runs(probes: DataFrame, *, delay: str = "10 minutes", bridge: float = BRIDGE_SECONDS, window: float = WINDOW) -> DataFrame:
    """Runs of one song per set, each once it is over. probes[set_id, song, at, ts]; ``ts`` is the
    event time of ``at`` (seconds of the epoch)."""
    return (
        probes.where(F.col("song").isNotNull())
        .withWatermark("ts", delay)
        .groupBy("set_id", "song")
        .transformWithStateInPandas(
            statefulProcessor=RunTracker(bridge, window), outputStructType=RUNS, outputMode="Append", timeMode="EventTime", eventTimeColumnName=""
        )
    )


def _open_runs(bridge: float, window: float):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = [list(r) for r in zip(*state.get)] if state.exists else []
        for at in [] if state.hasTimedOut else pd.concat(list(batches))["at"].dropna().sort_values():
            runs = _placed(runs, float(at), bridge)
        seen = state.getCurrentWatermarkMs() / 1000
        closed = [r for r in runs if state.hasTimedOut and r[1] + bridge <= seen]
        left = [r for r in runs if r not in closed]
        if left:
            state.update(_stored(left))
            due = int((min(r[1] for r in left) + bridge) * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield _runs_of(key, closed, window)

    return step


def live_runs(probes: DataFrame, *, delay: str = "10 minutes", bridge: float = BRIDGE_SECONDS, window: float = WINDOW) -> DataFrame:
    """``closed_runs`` for state stores without timers of their own: one state row per song of a set."""
    return (
        probes.where(F.col("song").isNotNull())
        .withWatermark("ts", delay)
        .groupBy("set_id", "song")
        .applyInPandasWithState(_open_runs(bridge, window), RUNS, OPEN, "append", GroupStateTimeout.EventTimeTimeout)
    )


def _failing(limit: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        worst = streak
        for row in pd.concat(list(batches)).sort_values("at").itertuples():
            streak = streak + 1 if row.error is not None and row.error == row.error else 0
            worst = max(worst, streak)
        state.update((int(streak),))
        yield pd.DataFrame({"set_id": [key[0]], "recognizer": [key[1]], "streak": [int(streak)], "failing": [worst >= limit]})

    return step


def failing_services(probes: DataFrame, *, limit: int = FAILING_IN_A_ROW) -> DataFrame:
    """Per listen (a set and a recognizer) the failures in a row so far, and whether ``limit`` was
    reached. State is one counter per listen."""
    return probes.groupBy("set_id", "recognizer").applyInPandasWithState(
        _failing(limit), "set_id string, recognizer string, streak long, failing boolean", "streak long", "update", GroupStateTimeout.NoTimeout
    )


def rates(probes: DataFrame, *, window: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Windows and errors per sliding interval and recognizer."""
    return (
        probes.withWatermark("ts", delay)
        .groupBy("recognizer", F.window("ts", window, slide))
        .agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    )


def unanswered(planned: DataFrame, answered: DataFrame) -> DataFrame:
    """Planned windows of each set that no probe has answered yet."""
    done = answered.where(F.col("error").isNull()).select("set_id", F.round("at", 3).alias("at")).distinct()
    return planned.withColumn("at", F.round("at", 3)).join(done, ["set_id", "at"], "left_anti")


def changed_files(now: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose time or size is not what the last sync read."""
    return now.join(seen.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def event_tail(events: DataFrame, after: int) -> DataFrame:
    """Events past a cursor (batch or stream)."""
    return events.where(F.col("event_id") > after)


def recheck_items(additions: DataFrame, items: DataFrame) -> DataFrame:
    """Stream of catalog additions against waiting list items: what to check again.

    additions[label_key, recording_id] (a stream), items[list_id, item_id, label_key, state] (static).
    """
    waiting = items.where(F.col("state").isin("missing", "unavailable"))
    return additions.join(waiting, "label_key").select("list_id", "item_id", "label_key", "recording_id")


def import_new(records: DataFrame, path: str, checkpoint: str):
    """Append each listening record once, however late it comes; returns the query.

    What was imported is remembered for every record, in state keyed by user and record: a mark of time
    would lose what one device delivers days after another.
    """
    fresh = records.dropDuplicates(["user_id", "title", "artist", "shazamed_at"])
    return (
        fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start()
    )
