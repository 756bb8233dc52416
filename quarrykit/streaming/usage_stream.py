"""Usage scores kept up to date from a stream of uses (seq, path, ts), without a watermark: late uses count.

Each key's state is (path, score, count, last). A stream may start from a stored table of such states (``store.read_usage``)
and goes on from its checkpoint after that. Uses of one micro-batch are taken in order of seq. A timer is set for when
the score will have decayed below the limit that saving applies; a key that nobody uses until then is forgotten, count
and all, and its next use begins anew. Time is the clock of the engine. The states can be read back as a table at any
time. Keyed states of this kind need Spark's RocksDB provider in ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrykit.functions.text import normalize_key

LIMIT = 0.001
OUT = "key string, path string, score double, count long, last long"
STATE = "path string, score double, count long, last long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def expiry_seconds(score: float, last: int, half_life_days: float = 30.0, below: float = LIMIT) -> float:
    """When a score will have decayed below the limit, in unix seconds."""
    return last + half_life_days * 86400 * math.log2(score / below)


class Keeper(StatefulProcessor):
    """One key's usage: its stored state first, then uses, and a timer for when it is forgotten."""

    def __init__(self, half_life_days: float, below: float):
        self.days, self.below = max(half_life_days, 0.001), below

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.usage = handle, handle.getValueState("usage", STATE)

    def keep(self, path: str, score: float, count: int, last: int, now_ms: int) -> None:
        self.usage.update((path, score, count, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        at = 1000 * int(expiry_seconds(score, last, self.days, self.below))
        self.handle.registerTimer(min(max(at, now_ms + 1000), 2**53))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for row in initialState.to_dict("records"):
            self.keep(row["path"], float(row["score"]), int(row["count"]), int(row["last"]), timerValues.getCurrentProcessingTimeInMs())

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        path, score, count, last = self.usage.get() if self.usage.exists() else ("", 0.0, 0, None)
        uses = pd.concat(list(rows)).sort_values("seq")
        for at, name in zip(uses["ts"].tolist(), uses["path"].tolist()):
            if last is not None and at > last:
                score *= 0.5 ** ((at - last) / (self.days * 86400))
            last = at if last is None else max(last, at)
            score, count, path = score + 1, count + 1, name
        self.keep(path, score, count, last, timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame({"key": [key[0]], "path": [path], "score": [score], "count": [count], "last": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.usage.clear()
        yield from ()

    def close(self) -> None:
        pass


def live_usage(stream: DataFrame, half_life_days: float = 30.0, below: float = LIMIT, stored: DataFrame | None = None) -> DataFrame:
    """One row for each key that a micro-batch has touched, with its new state; ``stored`` (key, path, score, count,
    last) is where a new stream begins. A stream that has a checkpoint goes on from that instead."""
    keyed = stream.select(normalize_key(F.col("path")).alias("key"), "path", "seq", F.col("ts").cast("long").alias("ts"))
    begin = None if stored is None else stored.select("key", "path", "score", "count", "last").groupBy("key")
    return keyed.groupBy("key").transformWithStateInPandas(Keeper(half_life_days, below), OUT, "update", "processingTime", initialState=begin)


def states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, path, score, count, last) of the last finished micro-batch, as ``store.write_usage`` takes them."""
    rows = spark.read.format("statestore").option("stateVarName", "usage").load(checkpoint)
    return rows.select("key.key", "value.path", "value.score", "value.count", "value.last")
