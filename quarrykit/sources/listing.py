"""Reading real folders: through Spark's own listing, or with folders and file ids by a walk of its own.

The walk goes in rounds over a table of open folders. Each round deals them out; a task lists what it got, and what is
below, until it has met ``budget`` entries, and hands the folders that it did not get to back as open ones of the next
round. Entries never pass the driver, which only learns whether a folder is open.

Names come first: listing stats nothing (a folder is told by its directory entry; only where links are followed, links
and folders are looked at). ``filled`` looks up sizes, times and file ids afterwards, of the rows that are asked for.
"""

from __future__ import annotations

import os
import re
import stat

import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators.numbering import cut, scratch
from quarrykit.operators.tree import DEFAULT_EXCLUDES

ENTRY = "parent string, name string, is_dir boolean, path string, depth int, kind string, error string"
#: Entries that a task lists in the first round, and in later ones, before it hands open folders back.
FIRST_BUDGET, BUDGET = 1000, 50_000


def spark_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder, with the folders that hold them derived from the paths. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    path = F.regexp_replace("path", r"^file:/*", "/")
    files = found.select(path.alias("path"), F.lit(False).alias("is_dir"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    top = folder.rstrip("/")
    rest = F.split(F.substring("path", F.lit(len(top) + 2), F.length("path")), "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(rest) - 1), lambda k: F.array_join(F.concat(F.array(F.lit(top)), F.slice(rest, 1, k)), "/"))
    folders = files.select(F.explode(ups).alias("path")).distinct().select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))
    rows = files.unionByName(folders)
    parent = F.when(F.col("path") == top, F.lit(None)).otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    name = F.when(F.col("path") == top, F.col("path")).otherwise(F.regexp_extract("path", "([^/]*)$", 1))
    return rows.select(F.xxhash64("path").alias("idx"), parent.alias("parent"), name.alias("name"), "is_dir", "size", "mtime", F.lit(0).cast("long").alias("file_id"), "path")


def wildcard(pattern: str) -> re.Pattern:
    """``*`` and ``?`` as a regular expression over the whole text, without regard to case; nothing else is special."""
    parts = {"*": ".*", "?": "."}
    return re.compile("".join(parts.get(c, re.escape(c)) for c in pattern), re.DOTALL | re.IGNORECASE)


def excludes(patterns: list[str]):
    """A test of (name, path): patterns with a separator look at the path, others at the name."""
    made = [(p, wildcard(p), "/" in p or "\\" in p) for p in patterns if p]

    def test(name: str, path: str) -> bool:
        for p, glob, whole in made:
            if whole and (p in path or ("*" in p or "?" in p) and glob.fullmatch(path)) or not whole and glob.fullmatch(name):
                return True
        return False

    return test


def told(text: str | None) -> str | None:
    """A name as text; bytes that are no UTF-8 are replaced."""
    return text and text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class Lister:
    """Lists folders one after the other; rows leave in batches, whatever a folder's size."""

    def __init__(self, patterns: list[str], follow: bool, budget: int):
        self.excluded, self.follow, self.budget = excludes(patterns), follow, budget
        self.rows: list[tuple] = []

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 8
        self.rows = []
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
        names = [c.split()[0] for c in ENTRY.split(", ")] + ["above"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def add(self, parent, name, is_dir, path, depth, kind, error=None, above=None) -> None:
        self.rows.append((told(parent), told(name), is_dir, told(path), depth, kind, told(error), above))

    def identity(self, path: str) -> str:
        s = os.stat(path)
        return f"{s.st_dev}:{s.st_ino}"

    def root(self, path: str) -> list[tuple]:
        """A root's own row, or the error that it is not there; the folder to list."""
        try:
            is_dir = stat.S_ISDIR(os.stat(path).st_mode)
            above = [self.identity(path)] if self.follow and is_dir else []
        except (OSError, ValueError) as e:
            self.add(None, path, False, path, 0, "error", str(e))
            return []
        self.add(None, path, is_dir, path, 0, "dir" if is_dir else "file")
        return [(path, 0, above)] if is_dir else []

    def entry(self, e: os.DirEntry, folder: str, depth: int, above: list[str]) -> list[tuple]:
        if self.excluded(e.name, e.path):
            self.add(folder, e.name, False, e.path, depth, "skipped")
            return []
        try:
            is_dir = e.is_dir(follow_symlinks=self.follow)
            if self.follow and e.is_symlink():
                os.stat(e.path)  # a link that leads nowhere is an error
            own = [self.identity(e.path)] if self.follow and is_dir else []
        except OSError as x:
            self.add(folder, e.name, False, e.path, depth, "error", str(x))
            return []
        if own and own[0] in above:
            self.add(folder, e.name, True, e.path, depth, "error", f"{e.path}: leads back to a folder above")
            return []
        self.add(folder, e.name, is_dir, e.path, depth, "dir" if is_dir else "file")
        return [(e.path, depth, above + own)] if is_dir else []

    def __call__(self, batches):
        met = 0
        for batch in batches:
            for row in batch.to_pylist():
                todo = [(row["path"], row["depth"], row["above"] or [])] if row["kind"] == "open" else self.root(row["path"])
                while todo:
                    path, depth, above = todo.pop()
                    if met >= self.budget and told(path) == path:  # a name that is no text stays with this task
                        self.add(None, None, True, path, depth, "open", above=above)
                        continue
                    met += 1
                    try:
                        with os.scandir(path) as entries:
                            for e in entries:
                                met += 1
                                todo += self.entry(e, path, depth + 1, above)
                                if len(self.rows) >= 4096:
                                    yield self.drain()
                    except OSError as x:
                        self.add(path, "", True, path, depth, "error", str(x))
        yield self.drain()


def names(spark: SparkSession, roots: list[str], exclude: list[str] | None = None, follow_links: bool = False, first: int = FIRST_BUDGET, budget: int = BUDGET) -> DataFrame:
    """(parent, name, is_dir, path, depth, kind, error) of all entries of a scan, without sizes and times.

    ``kind`` is file, dir, skipped (excluded; what is below is not visited) or error: a root that is not there, a folder
    that cannot be read (beside its own row), and where links are followed one that leads nowhere or to a folder above.
    Roots are not compared with each other. Without ``exclude``, ``tree.DEFAULT_EXCLUDES`` are left out; ``[]`` takes all.
    """
    exclude = DEFAULT_EXCLUDES if exclude is None else exclude
    at, turn = scratch(spark, "names"), 0
    open_ = spark.createDataFrame([(r, 0, "root", []) for r in roots], "path string, depth int, kind string, above array<string>")
    tasks = 4 * spark.sparkContext.defaultParallelism
    while True:
        lister = Lister(list(exclude), follow_links, budget if turn else first)
        found = open_.select("path", "depth", "kind", "above").repartition(tasks).mapInArrow(lister, ENTRY + ", above array<string>")
        found.write.parquet(f"{at}/round={turn}")
        open_ = spark.read.parquet(f"{at}/round={turn}").filter("kind = 'open'")
        turn += 1
        if not open_.limit(1).count():
            break
    return spark.read.parquet(at).filter("kind != 'open'").drop("above", "round")


def filled(rows: DataFrame, follow_links: bool = False, looked_up: Accumulator | None = None) -> DataFrame:
    """``rows`` of ``names`` with idx, size, mtime and file_id; a row whose metadata cannot be read stays, with an error.

    Rows are dealt out evenly, so a large folder is shared by many tasks; each task goes through its rows by folder.
    ``looked_up`` counts the look-ups.
    """

    def run(batches):
        for batch in batches:
            out = []
            for path, kind in zip(batch["path"].to_pylist(), batch["kind"].to_pylist()):
                size, mtime, ino, error = None, 0, 0, None
                if kind in ("file", "dir"):
                    if looked_up is not None:
                        looked_up.add(1)
                    try:
                        s = os.stat(path, follow_symlinks=follow_links)
                        size, mtime, ino = None if kind == "dir" else s.st_size, int(s.st_mtime), s.st_ino
                    except (OSError, ValueError) as e:
                        error = str(e)
                out.append((size, mtime, ino, error))
            columns = list(zip(*out)) or [()] * 4
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "size", "mtime", "file_id", "_failed"])

    plain = rows.drop("idx", "size", "mtime", "file_id")
    dealt = plain.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("parent")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", size long, mtime long, file_id long, _failed string"
    done = dealt.mapInArrow(run, schema).withColumn("error", F.coalesce("error", "_failed")).drop("_failed")
    return done.withColumn("idx", F.xxhash64("path"))


def scanned(spark: SparkSession, roots: list[str], exclude: list[str] | None = None, follow_links: bool = False) -> DataFrame:
    """All rows of a scan with their metadata, those of skipped entries and of errors too; looked up once."""
    return cut(filled(names(spark, roots, exclude, follow_links), follow_links))


def folders(spark: SparkSession, roots: list[str], exclude: list[str] | None = None, follow_links: bool = False) -> DataFrame:
    """Files and folders of a scan."""
    return scanned(spark, roots, exclude, follow_links).filter("kind in ('file', 'dir')").drop("kind", "error")


def scan_counts(rows: DataFrame) -> DataFrame:
    """One row: files, dirs (roots too), skipped, errors of ``scanned``: what could not be listed, and every row whose
    metadata could not be read. Of journal records, orphans are counted by ``tree.orphans``."""
    kinds = {"files": "file", "dirs": "dir", "skipped": "skipped"}
    return rows.agg(*(F.count_if(F.col("kind") == k).alias(name) for name, k in kinds.items()), F.count_if(F.col("error").isNotNull()).alias("errors"))


def contents(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(idx, content) of the given files only, opened by path where the task runs; what cannot be read has no row.

    For small files that are wanted as bytes; hashes of files of any size come from ``hashing.PathContents``.
    """

    def run(batches):
        for batch in batches:
            for idx, path in zip(batch["idx"].to_pylist(), batch["path"].to_pylist()):
                try:
                    with open(path, "rb") as f:
                        body = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([idx], pa.int64()), pa.array([body], pa.binary())], names=["idx", "content"])

    return rows.filter(~F.col("is_dir")).select("idx", "path").mapInArrow(run, "idx long, content binary")


def paper_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source, path, round) of a folder's papers: by round, nameless ones last; within a round PDF before HWP."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,hwp}").load(folder).select("path")
    source = F.regexp_extract("path", "([^/]*)$", 1)
    named = found.select(source.alias("source"), "path", F.regexp_extract(source, r"(?U)(\d+)\s*회", 1).try_cast("int").alias("round"))
    return named.orderBy(F.asc_nulls_last("round"), F.col("source").endswith(".hwp"), "source")
