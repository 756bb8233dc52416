"""Usage scores from an append-only log (seq, path, ts), and operations on the folded state.

The state of a key is (key, path, score, count, last). The sequential rule is: a use adds 1; if it is later than the
last one, the score decays to its time first; a use that arrives late adds its 1 undecayed and moves nothing. With
the running maximum m of the times so far, every use is worth 0.5 ** ((last - m) / h) at the end, which needs
a window and an aggregation instead of a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions.text import decayed, normalize_key

PRUNE_BELOW = 0.001
#: What counts as one use of a file, beside opening it.
USES = ["open", "copy", "download"]


def log_of(actions: DataFrame, uses: list[str] = USES) -> DataFrame:
    """The log of uses (seq, path, ts) in a record of actions (seq, path, ts, action): copying a path or downloading a
    file is a use as opening it is, looking at a list is none."""
    return actions.filter(F.col("action").isin(uses)).select("seq", "path", "ts")


def fold(log: DataFrame, half_life_days: float = 30.0, fold_case: bool = False, chunk: int = 1 << 20) -> DataFrame:
    """The state of every key.

    A key's log is cut into chunks of seq, so that one that holds much of the log is many groups: only the chunks'
    latest times are put in order as a whole.
    """
    keyed = log.select(normalize_key(F.col("path"), fold_case).alias("key"), "path", "seq", F.col("ts").cast("long").alias("ts"), F.floor(F.col("seq") / chunk).alias("chunk"))
    tops = keyed.groupBy("key", "chunk").agg(F.max("ts").alias("top"))
    whole = Window.partitionBy("key")
    earlier = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("key").alias("_key"), F.col("chunk").alias("_chunk"), F.max("top").over(earlier).alias("before"), F.max("top").over(whole).alias("last"))
    rows = keyed.join(tops, (F.col("key") == F.col("_key")) & (F.col("chunk") == F.col("_chunk")))
    so_far = Window.partitionBy("key", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.greatest(F.max("ts").over(so_far), F.col("before")))
    return rows.groupBy("key").agg(
        F.max_by("path", "seq").alias("path"),
        F.sum(decayed(F.lit(1.0), F.col("last") - F.col("at"), half_life_days)).alias("score"),
        F.count("*").alias("count"),
        F.max("last").alias("last"),
    )


def scored(state: DataFrame, now: int, half_life_days: float = 30.0) -> DataFrame:
    """The state with its scores decayed to ``now``."""
    return state.withColumn("score", decayed(F.col("score"), F.lit(now) - F.col("last"), half_life_days))


def top(state: DataFrame, n: int, now: int, half_life_days: float = 30.0) -> DataFrame:
    """The n most used paths (0: all), by decayed score, then path."""
    out = scored(state, now, half_life_days).orderBy(F.desc("score"), "path").select("path", "score", "count", "last")
    return out.limit(n) if n else out


def saved(state: DataFrame, now: int, half_life_days: float = 30.0) -> DataFrame:
    """What saving keeps: keys whose decayed score is not below 0.001. A dropped key loses its count too."""
    return state.filter(decayed(F.col("score"), F.lit(now) - F.col("last"), half_life_days) >= PRUNE_BELOW)


def indexed(state: DataFrame, files: DataFrame, fold_case: bool = False) -> DataFrame:
    """The keys that the index (folders and roots included) still has."""
    return state.join(files.select(normalize_key(F.col("path"), fold_case).alias("key")), "key", "left_semi")


def vanished(state: DataFrame, files: DataFrame, fold_case: bool = False) -> DataFrame:
    """The keys that pruning removes."""
    return state.join(files.select(normalize_key(F.col("path"), fold_case).alias("key")), "key", "left_anti")


def reconfigure(state: DataFrame, now: int, half_life_days: float) -> DataFrame:
    """A new half-life: score and count become the count, 1000 at most, and what has decayed by then goes."""
    count = F.least(F.col("count"), F.lit(1000).cast("long"))
    return saved(state.withColumns({"score": count.cast("double"), "count": count}), now, half_life_days)


def merge(old: DataFrame, new: DataFrame, half_life_days: float = 30.0) -> DataFrame:
    """Two states of consecutive pieces of a log as the state of the whole log.

    Uses in the newer piece that are older than the old state's last count undecayed at that time; pieces that are
    folded where times only grow, or compared at their last time, merge exactly.
    """
    both = old.withColumn("piece", F.lit(0)).unionByName(new.withColumn("piece", F.lit(1)))
    last = F.max("last").over(Window.partitionBy("key"))
    both = both.withColumn("at", last)
    return both.groupBy("key").agg(
        F.max_by("path", "piece").alias("path"),
        F.sum(F.when((F.col("piece") == 1) & (F.col("last") < F.col("at")), F.col("score")).otherwise(decayed(F.col("score"), F.col("at") - F.col("last"), half_life_days))).alias("score"),
        F.sum("count").alias("count"),
        F.max("at").alias("last"),
    )
