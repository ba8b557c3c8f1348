"""Structured Streaming twins of the batch operators: same rows, once the watermark has passed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trafficlens.operators import health as rules
from trafficlens.operators import metrics, policy
from trafficlens.sources import requests


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of event files; `files_per_trigger` bounds what one batch takes in."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def traffic(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The request log of a stream, with rows that come later than `late` left out."""
    return requests.from_events(events.withWatermark("ts", late))


def windowed_counters(log: DataFrame, width: str) -> DataFrame:
    """Counters per window, where the outcome follows from the request alone: errors, and all others as misses."""
    return metrics.counters(log.withColumn("outcome", F.when(F.col("status") >= 500, "error").otherwise("miss")), width)


def frequencies(log: DataFrame, width: str = "1 minute") -> DataFrame:
    """How often each key came in each window."""
    return policy.window_frequency(log, width)


def error_windows(log: DataFrame, width: str) -> DataFrame:
    return rules.error_windows(log, width)


class HealthProcessor(StatefulProcessor):
    """The state machine of operators.health for one backend, with its state kept between batches.

    Each batch's events are applied in order of time, windows before probes; every move gives a row.
    """

    FIELDS = "state string, throttles int, suc int, err int, sicked bigint, killed bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.FIELDS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        now = list(self.state.get()) if self.state.exists() else ["healthy", 0, 0, 0, 0, 0]
        frame = pd.concat(list(rows), ignore_index=True)
        frame["turn"] = (frame["kind"] != "window").astype(int)
        moves = []
        for e in frame.sort_values(["at", "turn", "kind"], kind="stable").itertuples(index=False):
            move = advance(now, int(e.at), e.kind, bool(e.ok) if e.kind == "probe" else False, int(e.total), float(e.err_rate))
            if move:
                moves.append((key[0], int(e.at), move, now[0], now[1]))
        self.state.update(tuple(now))
        if moves:
            yield pd.DataFrame(moves, columns=["backend", "at", "move", "state", "throttles"])

    def close(self) -> None:
        pass


def advance(now: list, at: int, kind: str, ok: bool, total: int, rate: float) -> str | None:
    """Apply one event to [state, throttles, suc, err, sicked, killed] in place; the move it makes, if any."""
    state, throttles, suc, err, sicked, killed = now
    if state == "buried":
        return None
    move = None
    if kind == "probe":
        if state == "healthy" and total > 0:
            return None  # judged by its error rate, not probed
        suc, err = (suc + 1, 0) if ok else (0, err + 1)
        if state == "healthy" and err > rules.PROBES_IN_ROW:
            move = "quarantine"
        elif state == "sick" and suc > rules.PROBES_IN_ROW:
            move = "cure"
        elif state == "sick" and err > rules.PROBES_IN_ROW and at - sicked > rules.KILL_SECONDS:
            move = "kill"
        elif state == "dead" and suc > rules.PROBES_IN_ROW:
            move = "resurrect"
        elif state == "dead" and err > rules.PROBES_IN_ROW and at - killed > rules.BURY_SECONDS:
            move = "bury"
    elif state == "healthy" and total > rules.IDLE_REQUESTS:
        if rate >= rules.MAX_ERROR_RATE:
            move = "quarantine"
        elif rate > rules.MIN_ERROR_RATE and throttles < rules.MAX_THROTTLES:
            move = "throttle"
        elif rate >= rules.MIN_ERROR_RATE:
            move = "quarantine"
        elif throttles > 0:
            move = "unthrottle"
    state = {"quarantine": "sick", "resurrect": "sick", "cure": "healthy", "kill": "dead", "bury": "buried"}.get(move, state)
    throttles = {"cure": rules.MAX_THROTTLES - 1, "throttle": throttles + 1, "unthrottle": throttles - 1}.get(move, throttles)
    if move in ("quarantine", "cure", "throttle", "unthrottle", "resurrect"):
        suc = err = 0
    sicked = at if move in ("quarantine", "resurrect") else 0 if move == "cure" else sicked
    killed = at if move == "kill" else 0 if move in ("quarantine", "resurrect", "cure") else killed
    now[:] = [state, throttles, suc, err, sicked, killed]
    return move


def health_moves(ticks: DataFrame) -> DataFrame:
    """(backend, at, move, state, throttles) for each move. Columns of ticks: backend, at, kind, ok, total, err_rate.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    return ticks.groupBy("backend").transformWithStateInPandas(
        HealthProcessor(), "backend string, at bigint, move string, state string, throttles int", "Append", "None"
    )


def to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and return what it gave."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return df.sparkSession.table(name)


def to_versions(df: DataFrame, path: str, checkpoint: str):
    """Write each batch of metrics as Parquet below `path`; a batch that runs again replaces its own files."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("append")
