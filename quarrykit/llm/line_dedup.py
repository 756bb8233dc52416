"""Line dedup that can be undone: sharded cuckoo filters backed by an exact table of reference counts.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased, held as its 128-bit
hash. ``LineStore`` counts in how many documents each key occurs. ``insert`` and ``delete`` add and subtract the
counts of a batch of documents; keys that cross the threshold enter or leave their shard's cuckoo filter, so
deleting a batch brings back the state from before its insertion. ``drop_lines`` takes every line to the filter of its
shard, a shard with many lines in several parts that each get the filter; only lines that pass are confirmed against
the exact table, so a filter's false positives never drop a line.

Defined cases: a null or empty text is one empty line; empty keys are never dropped; each row counts as one
document, a key once per row; rows with a null or repeated doc_id are treated like others (what is dropped
depends on the key alone); deleting what was never inserted takes a count to 0 at least; very long texts count whole;
an empty table gives an empty result. Other columns stay as they are.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.llm.common import cut, scratch, slices, small_batches, tidy

SLOTS = 4
#: The share of its slots that a filter fills before it is made larger.
FULL = 0.9
#: Lines that meet a filter together; a shard with more is dealt out.
TOGETHER = 100_000
#: Distinct keys that a task holds before it hands on their counts.
HELD_KEYS = 100_000


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line, empty for empty lines."""
    return [xxhash.xxh3_128_digest(k) if (k := line.strip().lower()) else b"" for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def text_key(keys: list[bytes]) -> bytes:
    """A hash of a text's line keys in order; seeded, so that it is no line's key."""
    return xxhash.xxh3_128_digest(b"".join(k or bytes(16) for k in keys), seed=1)


class CuckooFilter:
    """Set of 128-bit keys with 16-bit fingerprints in buckets of four; what finds no slot is kept whole in a stash."""

    def __init__(self, buckets: int, table: bytes | None = None, stash: set[bytes] | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy()
        self.stash = set(stash or ())

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(1 << max(2, math.ceil(math.log2(max(1, n) / (SLOTS * 0.6)))))

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and both buckets."""
        halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        print_ = (halves[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint64)
        first = halves[:, 0] & np.uint64(self.buckets - 1)
        return print_.astype(np.uint16), first.astype(np.int64), self.other(first.astype(np.int64), print_)

    def other(self, bucket, print_):
        return bucket ^ ((np.asarray(print_).astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def insert(self, keys: list[bytes]) -> None:
        if not keys:
            return
        rng = np.random.default_rng(7)
        for key, p, a, b in zip(keys, *(x.tolist() for x in self.places(keys))):
            moved = []
            for _ in range(200):
                row = next((r for r in (a, b) if (self.table[r] == 0).any()), None)
                if row is not None:
                    self.table[row, int(np.argmax(self.table[row] == 0))] = p
                    break
                slot = int(rng.integers(SLOTS))
                moved.append((b, slot, p))
                p, self.table[b, slot] = int(self.table[b, slot]), p
                a, b = b, int(self.other(b, p))
            else:
                for row, slot, mine in reversed(moved):
                    p, self.table[row, slot] = mine, p
                self.stash.add(key)

    def delete(self, keys: list[bytes]) -> None:
        if not keys:
            return
        for key, p, a, b in zip(keys, *(x.tolist() for x in self.places(keys))):
            if key in self.stash:
                self.stash.discard(key)
                continue
            for row in (a, b):
                if (at := np.flatnonzero(self.table[row] == p)).size:
                    self.table[row, at[0]] = 0
                    break

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        p, a, b = self.places(keys)
        found = (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)
        return found | np.array([k in self.stash for k in keys]) if self.stash else found


def count_keys(docs: DataFrame) -> DataFrame:
    """(key, n): in how many documents each key occurs; every task sums up before it hands on."""

    def count(batches):
        held: Counter = Counter()

        def drain():
            held.pop(b"", None)
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["key", "n"])
            held.clear()
            return out

        for batch in slices(batches):
            for text in batch["text"].to_pylist():
                held.update(set(line_keys(text)))
            if len(held) > HELD_KEYS:
                yield drain()
        yield drain()

    return small_batches(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(tidy(count), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def count_keys_once(docs: DataFrame) -> DataFrame:
    """(key, n): in how many documents with different lists of line keys each key occurs."""

    def pairs(batches):
        held: set[tuple[bytes, bytes]] = set()

        def drain():
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.binary()) for k in (0, 1)], names=["key", "whole"])
            held.clear()
            return out

        for batch in slices(batches):
            for text in batch["text"].to_pylist():
                keys = line_keys(text)
                whole = text_key(keys)
                held.update((k, whole) for k in keys if k)
                if len(held) > HELD_KEYS:
                    yield drain()
        yield drain()

    each = small_batches(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(tidy(pairs), "key binary, whole binary").distinct()
    return each.groupBy("key").agg(F.count("*").alias("n"))


class LineStore:
    """Reference counts and filters, each state written whole to the shared folder; ``version`` names the newest."""

    FILTERS = "shard int, buckets long, cells binary, stash array<binary>"

    def __init__(self, spark: SparkSession, threshold: int, shards: int, path: str | None = None):
        self.spark, self.threshold, self.shards = spark, threshold, shards
        self.path, self.version = path or scratch(spark, "lines"), 0

    def counts(self) -> DataFrame:
        """(shard, key, before, n): n is the count now, before the one of the last version."""
        if not self.version:
            return self.spark.createDataFrame([], "shard int, key binary, before long, n long")
        return self.spark.read.parquet(f"{self.path}/counts-{self.version}")

    def filters(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], self.FILTERS)
        return self.spark.read.parquet(f"{self.path}/filters-{self.version}")

    def insert(self, docs: DataFrame) -> LineStore:
        return self._apply(count_keys(docs), 1)

    def insert_once(self, docs: DataFrame) -> LineStore:
        """Inserts ``docs`` with all copies (rows with the same line keys in the same order) counted as one document.

        Copies are only known within ``docs``, so this is for a store that is filled once.
        """
        return self._apply(count_keys_once(docs), 1)

    def delete(self, docs: DataFrame) -> LineStore:
        """Takes back documents that were inserted before."""
        return self._apply(count_keys(docs), -1)

    def _apply(self, counted: DataFrame, sign: int) -> LineStore:
        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
        change = counted.select(shard.alias("shard"), "key", F.lit(0).cast("long").alias("before"), (sign * F.col("n")).alias("n"))
        now = change
        if self.version:
            old = self.counts().filter("n > 0").select("shard", "key", F.col("n").alias("before"), "n")
            now = old.unionByName(change).groupBy("shard", "key").agg(F.sum("before").alias("before"), F.greatest(F.sum("n"), F.lit(0)).alias("n"))
        now.write.parquet(f"{self.path}/counts-{self.version + 1}")
        filters, limit = self.filters(), self.threshold
        self.version += 1
        crossed = self.counts().filter(f"(before >= {limit}) != (n >= {limit})").select("shard", "key", (F.col("n") >= limit).alias("enters"))

        def update(_, moves, old):
            import pandas as pd

            shard = int((moves if len(moves) else old)["shard"].iloc[0])
            enters = [bytes(k) for k in moves["key"][moves["enters"]]]
            if len(old):
                row = old.iloc[0]
                made = CuckooFilter(int(row["buckets"]), bytes(row["cells"]), {bytes(k) for k in row["stash"]})
            else:
                made = CuckooFilter.for_keys(len(enters))
            made.delete([bytes(k) for k in moves["key"][~moves["enters"]]])
            made.insert(enters)
            return pd.DataFrame({"shard": [shard], "buckets": [made.buckets], "cells": [made.table.tobytes()], "stash": [sorted(made.stash)]})

        # a filter that would be too full is made anew, in a fitting size, from the exact table
        size = self.counts().filter(F.col("n") >= limit).groupBy("shard").agg(F.count("*").alias("size"))
        full = F.col("size") > FULL * SLOTS * F.col("buckets")
        outgrown = cut(filters.select("shard", "buckets").join(size, "shard").filter(full).select("shard"))
        moves, old = (x.join(outgrown, "shard", "left_anti") for x in (crossed, filters))
        updated = moves.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(update, self.FILTERS)
        updated.unionByName(self._built(outgrown)).write.parquet(f"{self.path}/filters-{self.version}")
        return self

    def _built(self, of: DataFrame | None = None) -> DataFrame:
        """Filters of fitting size from the exact table, for the shards ``of`` or for all."""
        kept = self.counts().filter(F.col("n") >= self.threshold).select("shard", "key")
        kept = kept if of is None else kept.join(of, "shard", "left_semi")

        def build(pdf):
            import pandas as pd

            made = CuckooFilter.for_keys(len(pdf))
            made.insert([bytes(k) for k in pdf["key"]])
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "buckets": [made.buckets], "cells": [made.table.tobytes()], "stash": [sorted(made.stash)]})

        return kept.groupBy("shard").applyInPandas(build, self.FILTERS)

    def rebuild_filters(self) -> LineStore:
        """All filters anew, for instance after many documents were taken back; ``_apply`` lets them grow by itself."""
        self.counts().write.parquet(f"{self.path}/counts-{self.version + 1}")
        self._built().write.parquet(f"{self.path}/filters-{self.version + 1}")
        self.version += 1
        return self


def shards_for(docs: DataFrame) -> int:
    """Shards by the number of documents: each keeps some ten thousand frequent keys at most."""
    return max(8, math.ceil(docs.count() / 20_000))


def lines_of(docs: DataFrame) -> DataFrame:
    """(text_id, task, key): the distinct lines of each text, once for each task that has the text.

    A task remembers a bounded number of texts, so of the copies of one text next to nothing is shuffled.
    """

    def spread(batches):
        task, seen = TaskContext.get().partitionId(), set()
        for batch in slices(batches):
            if len(seen) > HELD_KEYS:
                seen.clear()
            ids, keys = [], []
            for text_id, text in zip(batch["text_id"].to_pylist(), batch["text"].to_pylist()):
                if text_id not in seen:
                    seen.add(text_id)
                    own = sorted({k for k in line_keys(text) if k})
                    ids += [text_id] * len(own)
                    keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([task] * len(ids), pa.int32()), pa.array(keys, pa.binary())], names=["text_id", "task", "key"])

    rows = docs.select(_text_id(docs).alias("text_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(tidy(spread), "text_id long, task int, key binary")


def suspects(docs: DataFrame, store: LineStore) -> DataFrame:
    """(text_id, key) of the lines that pass the filters, once for each text and task; text_id is a hash of the text.

    A shard's lines are dealt into parts by text and task, so that neither a line nor a text that many rows have meets
    in one part.
    """

    def probe(lines, filters):
        if not len(filters) or not len(lines):
            return lines.iloc[:0][["text_id", "key"]]
        row = filters.iloc[0]
        made = CuckooFilter(int(row["buckets"]), bytes(row["cells"]), {bytes(k) for k in row["stash"]})
        return lines[made.contains([bytes(k) for k in lines["key"]])][["text_id", "key"]]

    shard = F.pmod(F.xxhash64("key"), F.lit(store.shards)).cast("int")
    lines = lines_of(docs).withColumn("shard", shard)
    parts = store.counts().groupBy("shard").agg(F.ceil(F.sum("n") / TOGETHER).cast("int").alias("parts"))
    parts = F.broadcast(parts)  # a row of two numbers for each shard, that is for each 20,000 documents
    lines = lines.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("text_id", "task"), F.col("parts")).cast("int")).drop("parts", "task")
    each = store.filters().join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return lines.groupBy("shard", "part").cogroup(each.groupBy("shard", "part")).applyInPandas(probe, "text_id long, key binary")


def _text_id(docs: DataFrame):
    """Texts that share an id by chance share what is dropped from them, which for every key is decided by the key alone."""
    return F.xxhash64(F.lit(3), docs["text"].cast("string"))


def kept_lines(docs: DataFrame, store: LineStore) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text): each row as a struct of its columns, and the lines whose key is in fewer
    documents than the threshold."""
    frequent = store.counts().filter(F.col("n") >= store.threshold).select("key")
    # a line that a third of all documents hold makes one hot key here: a plain join, whose skew Spark splits
    confirmed = suspects(docs, store).join(frequent, "key")
    drops = confirmed.groupBy("text_id").agg(F.collect_set("key").alias("_drops")).withColumnRenamed("text_id", "_of")

    @F.pandas_udf(T.StructType().add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string"))
    def keep(texts, drops):
        import pandas as pd

        out = []
        for text, drop in zip(texts, drops):
            lines = (text or "").split("\n")
            kept = lines
            if drop is not None and len(drop):
                gone = {bytes(k) for k in drop}
                kept = [line for line, k in zip(lines, line_keys(text)) if k not in gone]
            out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_text"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _text_id(docs).alias("_id"), docs["text"].cast("string").alias("_text"))
    joined = rows.join(drops, F.col("_id") == F.col("_of"), "left")
    return joined.select("row", keep("_text", "_drops").alias("_kept")).select("row", "_kept.*")


def drop_lines(docs: DataFrame, store: LineStore) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row."""
    return kept_lines(docs, store).select("row.doc_id", "n_lines", "n_dropped", "kept_text")


def fill(docs: DataFrame, threshold: int) -> LineStore:
    """A fresh store with all of ``docs``."""
    return LineStore(docs.sparkSession, threshold, shards_for(docs)).insert(docs)


def fill_once(docs: DataFrame, threshold: int) -> LineStore:
    """A fresh store with all of ``docs``, copies counted as one document."""
    return LineStore(docs.sparkSession, threshold, shards_for(docs)).insert_once(docs)


def dedup(docs: DataFrame, threshold: int = 10) -> DataFrame:
    """Counts all of ``docs`` in a fresh store and drops their frequent lines."""
    return drop_lines(docs, fill(docs, threshold))
