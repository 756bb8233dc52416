"""The commands of a file index over one folder of stores: index, search, dup, hit, top, stats, prune, config.

A workspace keeps the index, the usage states, the hash cache and its settings as tables of versions below ``path``.
Every command reads what it needs and gives DataFrames; ``now`` (unix seconds) is always passed in. Commands that change
a store write a new version of it, so one that fails leaves all as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.functions.text import normalize_key
from quarrykit.operators import dup, search, tree, usage
from quarrykit.operators.hashing import PathContents
from quarrykit.operators.numbering import cut
from quarrykit.sources import listing, store
from quarrykit.sources.versions import Versions

SETTINGS = T.StructType().add("half_life_days", "double")


class Workspace:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    @property
    def half_life_days(self) -> float:
        row = Versions(self.spark, self.at("settings")).read(SETTINGS).first()
        return max(row["half_life_days"], 0.001) if row else 30.0

    def files(self) -> DataFrame:
        return store.read_index(self.spark, self.at("index"))

    def used(self) -> DataFrame:
        return store.read_usage(self.spark, self.at("usage"))

    def index(self, roots: list[str], exclude: list[str] | None = None, follow_links: bool = False) -> DataFrame:
        """Scans the roots into a new version of the index; (files, dirs, skipped, errors)."""
        rows = listing.scanned(self.spark, roots, exclude, follow_links)
        store.write_index(rows.filter("kind in ('file', 'dir')").drop("kind", "error"), self.at("index"))
        return listing.scan_counts(rows)

    def search(self, query: str, now: int, sort: str = "freq", limit: int = 50, mark_dups: bool = False) -> DataFrame:
        """What is found, in order; ``mark_dups`` adds the tags of duplicates among what is shown."""
        shown = search.search(self.files(), query, self.used(), PathContents(), sort, limit, now, self.half_life_days)
        return search.tagged(cut(shown), PathContents()) if mark_dups else shown

    def dup(self, query: str = "", now: int = 0, min_size: int = 1, include_hardlinks: bool = False) -> tuple[DataFrame, DataFrame]:
        """The groups of equal files among what the query finds, and their members; hashes of whole files are remembered."""
        files = search.dup_candidates(self.files(), query, self.used(), now)
        known = store.read_cache(self.spark, self.at("hashes"))
        second = dup.with_full(dup.same_prefix(dup.with_quick(dup.same_size(files, min_size), PathContents())), PathContents(), known)
        store.write_cache(known, dup.learned(second), self.at("hashes"))
        rows = dup.confirmed(second)
        groups = dup.groups(rows, include_hardlinks)
        return groups, dup.members(rows, groups)

    def hit(self, paths: list[str], now: int) -> DataFrame:
        """Counts a use of each path, one after the other; the states of these keys."""
        log = self.spark.createDataFrame([(k, p, now) for k, p in enumerate(paths)], "seq long, path string, ts long")
        new = usage.fold(log, self.half_life_days)
        merged = cut(usage.merge(self.used(), new, self.half_life_days))
        store.write_usage(merged, self.at("usage"), now, self.half_life_days)
        return merged.join(new.select("key"), "key", "left_semi")

    def top(self, n: int, now: int) -> DataFrame:
        return usage.top(self.used(), n, now, self.half_life_days)

    def stats(self) -> DataFrame:
        return tree.stats(self.files(), self.used(), store.read_cache(self.spark, self.at("hashes")))

    def prune(self, now: int) -> DataFrame:
        """Forgets the usage of what the index does not have; the keys that went."""
        state, files = self.used(), self.files()
        gone = cut(usage.vanished(state, files).select("key"))
        if gone.limit(1).count():
            store.write_usage(usage.indexed(state, files), self.at("usage"), now, self.half_life_days)
        return gone

    def config(self, half_life_days: float, now: int) -> DataFrame:
        """A new half-life: what is kept of each state then."""
        state = cut(usage.reconfigure(self.used(), now, half_life_days))
        Versions(self.spark, self.at("settings")).write(self.spark.createDataFrame([(float(half_life_days),)], SETTINGS))
        store.write_usage(state, self.at("usage"), now, half_life_days)
        return self.used()

    def open(self, path: str) -> DataFrame:
        """The index's row of a path, however its separators are written; launching it is not a matter of data."""
        return self.files().filter(normalize_key(F.col("path")) == normalize_key(F.lit(path)))
