"""An action-chunk broker with a state that ends: for each episode the actions at hand, until it has been quiet for a while.

Needs the RocksDB state store (`use_state_store`), as Spark's transformWithState does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, step long, offset int, action double, event string"


def use_state_store(spark: SparkSession) -> None:
    from .. import ship

    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Broker(StatefulProcessor):
    """State: the chunk, an action an element; how many of its actions have been given; when the episode ends if nothing comes."""

    def __init__(self, horizon: int, quiet_ms: int):
        self.horizon, self.quiet = horizon, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunk = handle.getListState("chunk", "action double")
        self.used = handle.getValueState("used", "used int")
        self.ends = handle.getValueState("ends", "at long")

    def _hold(self, chunk: list[float], used: int) -> None:
        if chunk:
            self.chunk.put([(x,) for x in chunk])
        else:
            self.chunk.clear()
        self.used.update((used,))

    def _held(self) -> tuple[list[float], int]:
        chunk = [float(r[0]) for r in self.chunk.get()] if self.chunk.exists() else []
        return chunk, int(self.used.get()[0]) if self.used.exists() else 0

    def _wait(self, until: int) -> None:
        old = int(self.ends.get()[0]) if self.ends.exists() else None
        if old is not None and old >= until:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until)
        self.ends.update((until,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("step")
        chunk, used = self._held()
        out = []
        for r in frame.itertuples():
            if r.reset or used >= min(self.horizon, len(chunk)):
                chunk, used = [float(x) for x in (r.chunk if r.chunk is not None else ())], 0
            given = used < len(chunk)
            out.append((key[0], int(r.step), used, chunk[used] if given else None, "given" if given else "none"))
            used += given
        self._hold(chunk, used)
        self._wait(int(frame["at"].max()) + self.quiet)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.chunk, self.used, self.ends):
            state.clear()
        yield _frame([(key[0], None, None, None, "ended")])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Episodes that are under way when the stream begins: chunk and used, and at, when they were heard of last."""
        for r in initialState.itertuples():
            self._hold([float(x) for x in (r.chunk if r.chunk is not None else ())], int(r.used))
            self._wait(int(r.at) + self.quiet)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "step", "offset", "action", "event"])
    return out.astype({"step": "Int64", "offset": "Int32", "action": "Float64"})


def broker_with_timers(requests: DataFrame, horizon: int, quiet_s: float, key: str, step: str, chunk: str, ts: str, reset: str | None = None, late: str = "0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """(key, step, offset, action, event) of a stream of requests, by time ts (a timestamp).

    An episode takes the chunk of its request when it has no action left, or at a reset, and gives one action a request
    (event "given"). An empty or null chunk gives none (event "none": offset 0, no action), and the next request asks again.
    After quiet_s seconds of event time without a request the state ends: a row "ended" says so, and a later request begins
    anew. A request later than `late` after the newest one is dropped. initial: key, chunk, used, at (ms) of episodes under way.
    """
    rows = requests.select(
        F.col(key).cast("string").alias("key"), F.col(step).cast("long").alias("step"), F.col(chunk).cast("array<double>").alias("chunk"), (F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)).alias("reset"),
        F.col(ts).cast("timestamp").alias("ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"),
    ).withWatermark("ts", late)
    begun = initial.select(F.col("key").cast("string").alias("key"), "chunk", "used", "at").groupBy("key") if initial is not None else None
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Broker(horizon, int(quiet_s * 1000)), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime", initialState=begun)
