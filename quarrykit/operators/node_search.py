"""Search over nodes (file_id, parent_id, name, ...) whose paths are not assembled: filter first, paths later.

Terms about names, extensions, sizes and kinds need no path. What they leave are the survivors; only the folders above
these are looked up, level by level and each once, and only their paths are put together. Terms about paths, usage and
duplicates then see whole rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.operators import search, tree
from quarrykit.operators.numbering import cut
from quarrykit.plans.compile import predicate
from quarrykit.plans.query import Query, parse

#: Kinds of terms that need a path, or what is known by path.
NEEDS_PATH = ("path", "runcount", "dup")


def first_rows(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """Of the rows with these ids one for each id, the same that ``tree.resolve`` takes: smallest parent, then name."""
    rest = [c for c in raw.columns if c not in ("file_id", "parent_id", "name", "is_dir")]
    row = F.struct("parent_id", "name", "is_dir", *rest)
    return raw.join(ids, "file_id", "left_semi").groupBy("file_id").agg(F.min(row).alias("r")).select("file_id", "r.*")


def survivors(raw: DataFrame, roots: DataFrame, query: Query) -> DataFrame:
    """The nodes that all terms without a path leave; a root's id is the root, which is never found."""
    early = query
    for kind in NEEDS_PATH:
        early = early.parted(kind)[1]
    test = predicate(early)
    ids = raw.filter(test).select("file_id").distinct().join(roots.select("file_id"), "file_id", "left_anti")
    return first_rows(raw, ids).filter(test)


def above(raw: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes on the ways from ``nodes`` up to their roots, each once; a level of folders is looked up at a time."""
    bare = raw.select("file_id", "parent_id", "name", "is_dir")
    tops = roots.select("file_id")
    next_ = cut(nodes.select(F.col("parent_id").alias("file_id")).distinct().join(tops, "file_id", "left_anti"))
    found, seen = bare.limit(0), next_
    while next_.limit(1).count():
        rows = cut(first_rows(bare, next_))
        found = found.unionByName(rows)
        up = rows.select(F.col("parent_id").alias("file_id")).distinct()
        next_ = cut(up.join(tops, "file_id", "left_anti").join(seen, "file_id", "left_anti"))  # a cycle ends here
        seen = seen.unionByName(next_)
    return found


def needed(raw: DataFrame, roots: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes whose paths a search has to assemble: what was found, and what is above."""
    columns = ["file_id", "parent_id", "name", "is_dir"]
    return found.select(*columns).unionByName(above(raw, roots, found)).dropDuplicates(["file_id"])


def search_nodes(raw: DataFrame, roots: DataFrame, query: Query | str, usage: DataFrame, content: DataFrame | None = None, sort: str = "freq", limit: int = 50, now: int = 0, half_life_days: float = 30.0) -> DataFrame:
    """What ``search.search`` finds in the index of these nodes, with paths for what needs one only.

    Nodes may have size and mtime; without, sizes are unknown. Those without a way to a root are never found.
    """
    query = parse(query) if isinstance(query, str) else query
    for name, unknown in (("size", F.lit(None).cast("long")), ("mtime", F.lit(0).cast("long"))):
        raw = raw if name in raw.columns else raw.withColumn(name, unknown)
    found = cut(survivors(raw, roots, query))
    placed = tree.resolve(needed(raw, roots, found), roots).select("file_id", "path", "depth")
    files = found.join(placed, "file_id").withColumns({"idx": F.col("file_id"), "parent": F.col("parent_id")})
    return search.search(files, query, usage, content, sort, limit, now, half_life_days)
