"""Trees from parent references: placing nodes below roots, paths, orphans, and hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.operators.numbering import cut

#: Folders that a scan leaves out unless told otherwise.
DEFAULT_EXCLUDES = ["AppData", "Windows", "Program Files"]
MAX_ROUNDS = 40  # pointer doubling: 2**40 levels


def joined_path(root: Column, parts: Column) -> Column:
    """Root text and names below it, with the root's own kind of separator, never doubled."""
    sep = F.when(F.contains(root, F.lit("\\")), F.lit("\\")).otherwise(F.lit("/"))
    open_end = root.endswith("/") | root.endswith("\\")
    rest = F.array_join(parts, "\u0000")
    rest = F.when(sep == "\\", F.replace(rest, F.lit("\u0000"), F.lit("\\"))).otherwise(F.replace(rest, F.lit("\u0000"), F.lit("/")))
    return F.when(F.size(parts) == 0, root).when(open_end, F.concat(root, rest)).otherwise(F.concat(root, sep, rest))


def resolve(raw: DataFrame, roots: DataFrame) -> DataFrame:
    """(file_id, parent_id, name, is_dir, path, depth) of all nodes whose chain of parents reaches a root.

    raw: (file_id, parent_id, name, is_dir); roots: (file_id, path). Chains are halved in every round: each node
    knows the names up to some ancestor, and takes over what that ancestor knows. Cycles never reach a root and stay
    out. Of several rows with one id, one counts (the smallest parent and name); a root's id is the root.
    """
    one = raw.groupBy("file_id").agg(F.min(F.struct("parent_id", "name", "is_dir")).alias("r")).select("file_id", "r.*")
    nodes = one.join(roots.select("file_id"), "file_id", "left_anti")
    tops = roots.select(F.col("file_id").alias("top"), F.col("path").alias("top_path"))
    state = nodes.join(tops, F.col("parent_id") == F.col("top"), "left")
    # up: the ancestor that ``parts`` leads to; done once that is a root
    state = cut(state.select("file_id", "parent_id", "name", "is_dir", F.col("parent_id").alias("up"), F.array("name").alias("parts"), F.col("top_path").alias("root")))
    placed = state.filter("root is not null").count()
    for _ in range(MAX_ROUNDS):
        above = state.select(F.col("file_id").alias("_id"), F.col("up").alias("_up"), F.col("parts").alias("_parts"), F.col("root").alias("_root"))
        open_rows, done = state.filter("root is null"), state.filter("root is not null")
        if not open_rows.limit(1).count():
            break
        # a node whose ancestor is not there, or that meets itself again, never gets further
        stepped = open_rows.join(above, F.col("up") == F.col("_id")).filter((F.col("_up") != F.col("file_id")) & (F.col("up") != F.col("file_id")))
        moved = stepped.select("file_id", "parent_id", "name", "is_dir", F.col("_up").alias("up"), F.concat("_parts", "parts").alias("parts"), F.col("_root").alias("root"))
        state = cut(done.unionByName(moved))
        met = state.filter("root is not null").count()
        if met == placed:
            # no open chain has met a root in this round: with doubling, what is left has none
            break
        placed = met
    rooted = state.filter("root is not null")
    return rooted.select("file_id", "parent_id", "name", "is_dir", joined_path(F.col("root"), F.col("parts")).alias("path"), F.size("parts").cast("int").alias("depth"))


def orphans(raw: DataFrame, placed: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct ids without a chain to a root, cycles included."""
    return raw.select("file_id").distinct().join(placed.select("file_id"), "file_id", "left_anti").join(roots.select("file_id"), "file_id", "left_anti")


def orphan_reasons(raw: DataFrame, roots: DataFrame, deepest: int | None = None) -> DataFrame:
    """(file_id, reason, length, missing) of every node without a chain of parents to a root.

    reason ``missing``: the chain ends at a parent that is not there, ``missing``; length counts the nodes from this one
    to the last one that is. ``cycle``: the chain never ends; length and missing are null. With ``deepest`` also
    ``deep``: the chain has more than so many nodes, this one included, before its root.

    Each round doubles how far every open node sees. Above a node whose chain ends late are nodes whose chains end
    earlier, so once no chain ends in a round, what is open is on a cycle or leads to one.
    """
    one = raw.groupBy("file_id").agg(F.min(F.struct("parent_id", "name", "is_dir")).alias("r")).select("file_id", F.col("r.parent_id").alias("up"))
    nodes = one.join(roots.select("file_id"), "file_id", "left_anti")
    tops = roots.select(F.col("file_id").alias("_top"))
    known = nodes.select(F.col("file_id").alias("_known"))
    ends = nodes.join(tops, F.col("up") == F.col("_top"), "left").join(known, F.col("up") == F.col("_known"), "left")
    kind = F.when(F.col("_top").isNotNull(), "root").when(F.col("_known").isNull(), "missing")
    state = cut(ends.select("file_id", "up", kind.alias("end"), F.lit(1).cast("long").alias("length")))
    before, left = None, state.filter("end is null").count()
    while left and left != before:
        open_, done = state.filter("end is null"), state.filter("end is not null")
        step = state.select(F.col("file_id").alias("_id"), F.col("up").alias("_up"), F.col("end").alias("_end"), F.col("length").alias("_length"))
        moved = open_.join(step, F.col("up") == F.col("_id")).select("file_id", F.col("_up").alias("up"), F.col("_end").alias("end"), (F.col("length") + F.col("_length")).alias("length"))
        state = cut(done.unionByName(moved))
        before, left = left, state.filter("end is null").count()
    lost = F.col("end") == "missing"
    reason = F.when(lost, "missing").when(F.col("end").isNull(), "cycle")
    if deepest is not None:
        reason = reason.when(F.col("length") > deepest, "deep")
    out = state.select("file_id", reason.alias("reason"), F.when(F.col("end").isNotNull(), F.col("length")).alias("length"), F.when(lost, F.col("up")).alias("missing"))
    return out.filter("reason is not null")


def volumes(parts: list[DataFrame]) -> DataFrame:
    """Raw nodes of several volumes: ids get the volume's number (from 1) in their top byte."""
    out = None
    for k, nodes in enumerate(parts):
        tag = F.shiftleft(F.lit(k + 1).cast("long"), 56)
        one = nodes.withColumns({"file_id": F.col("file_id").bitwiseOR(tag), "parent_id": F.col("parent_id").bitwiseOR(tag)})
        out = one if out is None else out.unionByName(one)
    return out


def hydrate(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Sizes and times from a listing (parent, name, size, mtime), by folder and lower-cased name; folders stay unknown."""
    known = listing.groupBy(F.col("parent").alias("_parent"), F.lower("name").alias("_name")).agg(F.max(F.struct("size", "mtime")).alias("_m"))
    joined = files.join(known, (F.col("parent") == F.col("_parent")) & (F.lower("name") == F.col("_name")) & ~F.col("is_dir"), "left")
    return joined.withColumns({"size": F.coalesce("_m.size", "size"), "mtime": F.coalesce("_m.mtime", "mtime")}).drop("_parent", "_name", "_m")


def child(files: DataFrame, parent: int, name: str) -> DataFrame:
    return files.filter((F.col("parent") == parent) & (F.col("name") == name))


def excluded_by(patterns: list[str], name: Column, path: Column) -> Column:
    """Whether a name or path is excluded: patterns with a separator look at the path (as a glob, or as a plain part
    of it), others at the name (as a glob, or the whole name)."""
    from quarrykit.functions.text import ascii_fold, fold_text, glob_match

    out = F.lit(False)
    for p in patterns:
        if "/" in p or "\\" in p:
            out = out | glob_match(path, p) | F.contains(path, F.lit(p))
        elif "*" in p or "?" in p:
            out = out | glob_match(name, p)
        else:
            out = out | (ascii_fold(name) == fold_text(p))
    return out


def exclude_raw(raw: DataFrame, patterns: list[str]) -> DataFrame:
    """Raw nodes whose names the patterns do not exclude, before any path is known: patterns with a separator look at
    the bare name too, and what is below an excluded folder stays and becomes an orphan."""
    return raw.filter(~excluded_by(patterns, F.col("name"), F.col("name")))


def exclude(files: DataFrame, patterns: list[str], sep: str = "/") -> DataFrame:
    """``files`` without what the patterns exclude and without all below; roots stay (their parent is null).

    Every path is compared with its own ancestors, exploded, so that no path is matched with all excluded folders.
    """
    hit = excluded_by(patterns, F.col("name"), F.col("path")) & F.col("parent").isNotNull()
    gone = files.filter(hit).select(F.col("path").alias("_gone")).distinct()
    parts = F.split("path", "\\\\" if sep == "\\" else sep)
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), sep))
    below = files.select("idx", F.explode(ups).alias("_up")).join(gone, F.col("_up") == F.col("_gone")).select("idx").distinct()
    return files.join(below, "idx", "left_anti")


def skipped(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Where a scan would stop: excluded entries that no excluded folder holds."""
    hit = files.filter(excluded_by(patterns, F.col("name"), F.col("path")) & F.col("parent").isNotNull())
    inside = hit.select("path").withColumnRenamed("path", "_p")
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    held = hit.select("idx", F.explode(ups).alias("_up")).join(inside, F.col("_up") == F.col("_p")).select("idx").distinct()
    return hit.join(held, "idx", "left_anti")


def stats(files: DataFrame, usage: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """One row: entries, files, bytes of names, bytes of fixed records (36 each); with a usage state and a hash cache
    also how many paths and hashes these know."""
    out = files.agg(F.count("*").alias("entries"), F.count_if(~F.col("is_dir")).alias("files"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).cast("long").alias("name_bytes"), (36 * F.count("*")).alias("record_bytes"))
    for table, name in ((usage, "usage_paths"), (cache, "cached_hashes")):
        if table is not None:  # one row each
            out = out.withColumn("_one", F.lit(1)).join(table.agg(F.count("*").alias(name)).withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out
