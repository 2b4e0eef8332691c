"""Structured Streaming jobs over requests, status messages, points and area changes.

All use event time with a watermark, or state with a bound; every one ends under availableNow and gives what the batch
operators give on the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tilework.functions import grid
from tilework.functions.paths import parse_tile_path
from tilework.operators.tables import written
from tilework.operators.tiling import KEY


def recent_tiles(stream: DataFrame, ttl: str = "300 seconds", key: tuple[str, ...] = ("layer", *KEY, "format")) -> DataFrame:
    """Tiles (ts, key...) that weren't seen within the time to live."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(list(key))


#: Neighbouring process ids whose messages are one value of state: a call for state costs more than the messages of some processes.
PIDS = 16


def _newest(message: tuple) -> tuple:
    """The order of messages (time, text): by time, then by text; one without a time or text is older."""
    us, text = message
    return us is not None, us or 0, text is not None, text or ""


class _Last(StatefulProcessor):
    """The newest n messages of each of up to PIDS processes as one value of state, read and written once a batch."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "pids array<bigint>, us array<bigint>, messages array<string>")

    def handleInputRows(self, key, rows, timerValues):
        of, fresh = {}, set()
        for pid, us, message in zip(*(self.kept.get() or ((), (), ())), strict=True):
            of.setdefault(pid, []).append((us, message))
        for _, pid, us, message in rows:
            of.setdefault(pid, []).append((us, message))
            fresh.add(pid)
        for pid in fresh:
            of[pid] = sorted(of[pid], key=_newest, reverse=True)[: self.n]
        flat = [(pid, *m) for pid, items in of.items() for m in items]
        self.kept.update(tuple(map(list, zip(*flat, strict=True))))
        for pid in fresh:
            for i, (us, message) in enumerate(of[pid], 1):
                yield Row(pid=pid, rn=i, us=us, message=message)

    def close(self) -> None:
        pass


def status_feed(stream: DataFrame, n: int = 21) -> DataFrame:
    """After each batch, the last n messages of each process in it: pid, rn, ts, message (the later row of a pid and rn
    replaces the earlier). Needs the RocksDB state store. Times are whole microseconds in the state and in Python."""
    rows = stream.select(F.floor(F.col("pid") / PIDS).alias("pids"), "pid", F.unix_micros("ts").alias("us"), "message")
    last = rows.groupBy("pids").transformWithState(
        statefulProcessor=_Last(n), outputStructType="pid long, rn int, us long, message string", outputMode="Update", timeMode="None"
    )
    return last.select("pid", "rn", F.timestamp_micros("us").alias("ts"), "message")


def idle_processes(stream: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Spans of activity of each process: pid, first, last, n; a span ends when nothing came for the gap."""
    spans = stream.withWatermark("ts", delay).groupBy("pid", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return spans.select("pid", F.col("w.start").alias("first"), (F.col("w.end") - F.expr(f"INTERVAL {gap}")).alias("last"), "n")


#: What a process is once nothing has come from it for so many minutes.
IDLE = {"hidden": 10, "expired": 60, "dropped": 360}


class _Silence(StatefulProcessor):
    """A process's newest message as value state, with an event-time timer for each kind of silence after it."""

    def __init__(self, spans: dict[str, int]):
        self.spans = sorted((minutes * 60_000, name) for name, minutes in spans.items())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, message string")

    def _row(self, key, ms: int, message: str, state: str) -> pd.DataFrame:
        return pd.DataFrame({"pid": [key[0]], "ms": [ms], "message": [message], "state": [state]})

    def handleInputRows(self, key, rows, timerValues):
        have = tuple(self.last.get()) if self.last.exists() else None
        new = have
        for pdf in rows:
            for found in pdf[["ms", "message"]].itertuples(index=False, name=None):
                new = found if new is None else max(new, found)
        if new != have:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            # a message exactly so old is not yet silent, hence the millisecond
            for span, _ in self.spans:
                self.handle.registerTimer(int(new[0]) + span + 1)
            self.last.update((int(new[0]), new[1]))
            yield self._row(key, int(new[0]), new[1], "shown")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ms, message = self.last.get()
        idle = expiredTimerInfo.getExpiryTimeInMs() - ms
        state = [name for span, name in self.spans if span < idle][-1]
        if state == self.spans[-1][1]:
            self.last.clear()
        yield self._row(key, ms, message, state)

    def close(self) -> None:
        pass


def silent_processes(stream: DataFrame, delay: str = "1 minute", spans: dict[str, int] | None = None) -> DataFrame:
    """T03 as a stream: pid, last, message, state. A row whenever a process's newest message changes (shown) and, without any message of
    its own, when event time shows that it has been silent for longer than 10 minutes (hidden), an hour (expired) and 6 hours
    (dropped, and its state is gone). Each row replaces the pid's earlier one. Event time is that of all processes' messages,
    less the delay. Needs the RocksDB state store."""
    rows = stream.withWatermark("ts", delay).select("pid", "ts", F.unix_millis("ts").alias("ms"), "message")
    out = rows.groupBy("pid").transformWithStateInPandas(
        statefulProcessor=_Silence(spans or IDLE), outputStructType="pid long, ms long, message string, state string", outputMode="Update", timeMode="EventTime"
    )
    return out.select("pid", F.timestamp_millis("ms").alias("last"), "message", "state")


def process_states(messages: DataFrame, now, hide: str = "10 minutes", expire: str = "1 hour", drop: str = "6 hours") -> DataFrame:
    """Pid, last, message (the newest one) and state of each process at a time: shown, hidden once idle for longer than
    hide, expired once its messages are older than expire, dropped once idle for longer than drop. Messages after now don't
    count; ties take the greater message. On a stream, in update mode, each row replaces the pid's earlier one."""
    at = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    last = messages.where(F.col("ts") <= at).groupBy("pid").agg(F.max(F.struct("ts", "message")).alias("m"))
    older = lambda span: F.col("m.ts") < at - F.expr(f"INTERVAL {span}")
    state = F.when(older(drop), "dropped").when(older(expire), "expired").when(older(hide), "hidden").otherwise("shown")
    return last.select("pid", F.col("m.ts").alias("last"), F.col("m.message").alias("message"), state.alias("state"))


def request_hits(stream: DataFrame, tiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests (ts, path) with outcome: bad path, unknown layer, out of bounds, hit or miss, against the stored tiles
    (layer, z, x, y, format) and the catalog."""
    p = stream.withColumn("p", parse_tile_path("path"))
    rows = p.select(*stream.columns, "p.layer", "p.z", "p.x", "p.y", F.col("p.ext").alias("format"))
    known = catalog.select("layer", "north", "west", "south", "east", "low", "high").withColumn("_known", F.lit(True))
    rows = rows.join(known, "layer", "left")
    stored = tiles.select("layer", *KEY, F.lower("format").alias("format")).distinct().withColumn("_hit", F.lit(True))
    rows = rows.join(stored, ["layer", *KEY, "format"], "left")
    ul, lr = grid.lonlat_to_tile("west", "north", "z"), grid.lonlat_to_tile("east", "south", "z")
    outside = ~F.col("z").between(F.col("low"), F.col("high")) | (F.col("x") > lr["x"]) | (F.col("y") > lr["y"]) | (F.col("x") + 1 < ul["x"]) | (F.col("y") + 1 < ul["y"])
    outcome = F.when(F.col("z").isNull(), "bad path").when(F.col("_known").isNull(), "unknown layer").when(outside, "out of bounds").when(F.col("_hit"), "hit").otherwise("miss")
    return rows.select(*stream.columns, "layer", *KEY, "format", outcome.alias("outcome"))


def tile_counts_stream(stream: DataFrame, zoom: int, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Points (ts, lon, lat) per tile and tumbling window; rows later than the delay are dropped."""
    key = [F.lit(zoom).alias("z"), grid.tile_x("lon", F.lit(zoom)).alias("x"), grid.tile_y("lat", F.lit(zoom)).alias("y")]
    out = stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), *key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *KEY, "n")


def seed_batch(tiles: DataFrame, render: Callable[[DataFrame, int], DataFrame], attempts: int = 3, keep: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """T07's step: (made, failed). render(tiles, attempt) adds body and error; tiles with an error are tried again.

    Every attempt's rows are written, by keep(rendered, attempt), which returns what it has written, or else to a table in the shared
    folder. So nothing is rendered twice, and a maker that answers differently from time to time can't put a tile on both
    sides or on neither."""
    keep = keep or (lambda df, n: written(df, f"attempt-{n}"))
    made, todo = None, tiles.select(*KEY)
    failed = None
    for attempt in range(1, attempts + 1):
        out = keep(render(todo, attempt).withColumn("attempt", F.lit(attempt)), attempt)
        good, failed = out.where("error IS NULL"), out.where("error IS NOT NULL")
        made = good if made is None else made.unionByName(good)
        todo = failed.select(*KEY)
    return made, failed


def seed_stream(stream: DataFrame, render, save: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, attempts: int = 3):
    """A stream of tiles rendered a batch at a time; save gets what was made, what failed for good, and the batch's number."""

    def step(df: DataFrame, n: int) -> None:
        made, failed = seed_batch(df, render, attempts)
        save(made, failed, n)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_timing(started: DataFrame, finished: DataFrame, limit: str = "10 minutes") -> DataFrame:
    """Pairs of a start and the finishes (ts, pid, path) of the same process and path within the limit: pid, path,
    started, seconds."""
    a = started.select(F.col("pid").alias("pid"), F.col("path").alias("path"), F.col("ts").alias("started")).withWatermark("started", limit)
    b = finished.select(F.col("pid").alias("_pid"), F.col("path").alias("_path"), F.col("ts").alias("ended")).withWatermark("ended", limit)
    near = F.expr(f"pid = _pid AND path = _path AND ended >= started AND ended <= started + INTERVAL {limit}")
    return a.join(b, near).select("pid", "path", "started", (F.unix_micros("ended") - F.unix_micros("started")).alias("micros"))
