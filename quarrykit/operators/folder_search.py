"""Searching folders without an index: names first, metadata only where the query asks for it and for what is shown."""

from __future__ import annotations

from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators import search
from quarrykit.operators.hashing import PathContents
from quarrykit.plans.compile import predicate
from quarrykit.plans.query import Query, parse
from quarrykit.sources import listing


def find(spark: SparkSession, roots: list[str], query: Query | str, usage: DataFrame, sort: str = "freq", limit: int = 50, now: int = 0, exclude: list[str] | None = None, follow_links: bool = False, looked_up: Accumulator | None = None) -> DataFrame:
    """What ``search.search`` finds in a scan of ``roots``.

    Terms about names, paths and kinds see the listing alone. Only what they leave is looked up, and only if the query
    asks for sizes or duplicates, or the order is one of sizes or times; else just what is shown. Whatever the query, no
    entry is looked up twice.
    """
    query = parse(query) if isinstance(query, str) else query
    rows = listing.names(spark, roots, exclude, follow_links).filter("kind in ('file', 'dir')")
    late, early = query.without_dup().parted("size")
    counted, plain = early.parted("runcount")
    rows = search.with_usage(rows.filter(F.col("parent").isNotNull()).filter(predicate(plain)), usage, now).filter(predicate(counted))
    if late.clauses or query.needs_dup or sort in ("size", "date"):
        whole = listing.cut(listing.filled(rows, follow_links, looked_up)).drop("kind", "error", "score", "count")
        return search.search(whole, query, usage, PathContents(), sort, limit, now)
    first = rows.withColumn("idx", F.xxhash64("path")).orderBy(*search.order_by(sort))
    first = first.limit(limit) if limit else first
    shown = listing.cut(listing.filled(first, follow_links, looked_up)).drop("kind", "error")
    return shown.orderBy(*search.order_by(sort))
