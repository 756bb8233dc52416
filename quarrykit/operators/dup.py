"""Files of equal content, by a funnel: equal size, equal hash of the first 16 KiB, equal hash of all.

``files`` has idx, path, is_dir, size, mtime, file_id. ``contents`` is a table (idx, content) of bytes, or
``hashing.PathContents``, which opens files by their path. Bytes are hashed in the task that reads them, and only hashes
pass a shuffle: of every survivor of the first stage its first 16 KiB, and of those files all that two stages leave and
that the cache does not know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarrykit.functions.text import family_key, normalize_key
from quarrykit.operators.hashing import PREFIX, PathContents, TableContents, contents_of
from quarrykit.operators.numbering import cut, numbered

Contents = DataFrame | TableContents | PathContents


def same_size(files: DataFrame, min_size: int = 1) -> DataFrame:
    """Stage 1: files, not folders, whose known size occurs at least twice."""
    known = files.filter(~F.col("is_dir") & F.col("size").isNotNull() & (F.col("size") >= min_size))
    sizes = known.groupBy("size").agg(F.count("*").alias("n")).filter("n >= 2").select("size")
    return known.join(sizes, "size", "left_semi")


def watched(rows: DataFrame, by: Observation | None, hash_: str, n: str) -> DataFrame:
    """``rows``, which tell ``by`` when they are computed: files, bytes read, and errors."""
    if by is None:
        return rows
    return rows.observe(by, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(n), F.lit(0)).alias("bytes"), F.count_if(F.col(hash_).isNull()).alias("errors"))


def with_quick(survivors: DataFrame, contents: Contents, counted: Observation | None = None) -> DataFrame:
    """Survivors of stage 1 with ``quick``, null where the content cannot be read, the bytes read, and the error.

    ``counted`` learns from the same job how many files were hashed, the bytes read and the errors.
    """
    quick = contents_of(contents).quick(survivors)
    quick = quick.select(F.col("idx").alias("_idx"), F.col("hash").alias("quick"), F.col("bytes").alias("quick_bytes"), F.col("error").alias("quick_error"))
    rows = survivors.join(quick, F.col("idx") == F.col("_idx"), "left").drop("_idx")
    why = F.when(F.col("quick").isNull(), F.coalesce("quick_error", F.concat("path", F.lit(": no content"))))
    rows = rows.withColumns({"quick_bytes": F.coalesce("quick_bytes", F.lit(0)), "quick_error": why})
    return cut(watched(rows, counted, "quick", "quick_bytes"))


def same_prefix(quick: DataFrame) -> DataFrame:
    """Stage 2: readable files that share size and quick hash with another."""
    read = quick.filter(F.col("quick").isNotNull())
    keys = read.groupBy("size", "quick").agg(F.count("*").alias("n")).filter("n >= 2").select("size", "quick")
    return read.join(keys, ["size", "quick"], "left_semi")


def with_cache(survivors: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Survivors with ``cached``, the full hash kept for this key, size and mtime; a file of unknown time has none."""
    known = cache.select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("full").alias("cached"))
    same = (key == F.col("_key")) & (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")) & (F.col("mtime") != 0)
    return survivors.join(known, same, "left").drop("_key", "_size", "_mtime")


def with_full(second: DataFrame, contents: Contents, cache: DataFrame | None = None, counted: Observation | None = None) -> DataFrame:
    """Survivors of stage 2 with ``cached`` and ``hash``, and of those hashed whole the bytes read and the error.

    Up to 16 KiB the quick hash has seen all. Of larger files the cache is asked first; what it does not know is
    hashed whole.
    """
    if cache is None:
        rows = second.withColumn("cached", F.lit(None).cast("string"))
    else:
        rows = with_cache(second, cache, normalize_key(F.col("path")))
    rows = cut(rows.withColumn("cached", F.when(F.col("size") > PREFIX, F.col("cached"))))
    wanted = rows.filter((F.col("size") > PREFIX) & F.col("cached").isNull())
    full = watched(contents_of(contents).whole(wanted), counted, "hash", "bytes")
    full = full.select(F.col("idx").alias("_idx"), F.col("hash").alias("_full"), F.col("bytes").alias("full_bytes"), F.col("error").alias("full_error"))
    known = rows.join(full, F.col("idx") == F.col("_idx"), "left").withColumn("full_bytes", F.coalesce("full_bytes", F.lit(0)))
    hash_ = F.when(F.col("size") <= PREFIX, F.col("quick")).otherwise(F.coalesce("cached", "_full"))
    why = F.when(hash_.isNull(), F.coalesce("full_error", F.concat("path", F.lit(": no content"))))
    return cut(known.withColumns({"hash": hash_, "full_error": why}).drop("_idx", "_full"))


def matched(files: DataFrame, contents: Contents, min_size: int = 1, cache: DataFrame | None = None) -> DataFrame:
    """Survivors of all three stages, one row for each file, with their ``hash``."""
    return confirmed(with_full(same_prefix(with_quick(same_size(files, min_size), contents)), contents, cache))


def confirmed(second: DataFrame) -> DataFrame:
    """Stage 3: of what ``with_full`` gives, the files that share size and hash with another."""
    rows = second.filter(F.col("hash").isNotNull())
    keys = rows.groupBy("size", "hash").agg(F.count("*").alias("_n")).filter("_n >= 2").select("size", "hash")
    return cut(rows.join(keys, ["size", "hash"], "left_semi"))


def groups(found: DataFrame, include_hardlinks: bool = False) -> DataFrame:
    """What ``matched`` found as groups: (group_no, hash, size, n, physical, all_hardlinked, wasted), most wasted first.

    Names of one file (equal non-zero file_id) count once; a group that is one file under several names is left out
    unless asked for. Members stand in ``members``, a row each, as a group may be as large as the table.
    """
    names = F.nullif(F.col("file_id"), F.lit(0).cast("long"))
    sets = found.groupBy("size", "hash").agg(F.count("*").alias("n"), (F.count_distinct(names) + F.count_if(names.isNull())).alias("physical"))
    sets = sets.withColumn("all_hardlinked", F.col("physical") <= 1)
    if not include_hardlinks:
        sets = sets.filter(~F.col("all_hardlinked"))
    sets = sets.withColumn("wasted", F.col("size") * (F.col("physical") - 1))
    out = numbered(sets, [F.desc("wasted"), F.desc("size"), F.asc("hash")], "group_no")
    return out.select("group_no", "hash", "size", "n", "physical", "all_hardlinked", "wasted")


def members(found: DataFrame, of: DataFrame) -> DataFrame:
    """(idx, path, mtime, group_no, hash, size, wasted) of the files of ``found`` that are in the groups ``of``."""
    return found.select("idx", "path", "mtime", "hash", "size").join(of.select("hash", "size", "group_no", "wasted"), ["size", "hash"])


def twins(found: DataFrame) -> DataFrame:
    """``idx`` of the files that have a copy which is not just another name; no group is numbered for that."""
    names = F.nullif(F.col("file_id"), F.lit(0).cast("long"))
    two = F.min(names), F.max(names), F.count_if(names.isNull())
    sets = found.groupBy("size", "hash").agg(*(c.alias(k) for c, k in zip(two, ("low", "high", "unknown"))))
    real = sets.filter(F.col("unknown") + F.when(F.col("low") < F.col("high"), 2).when(F.col("low").isNotNull(), 1).otherwise(0) >= 2)
    return found.join(real.select("size", "hash"), ["size", "hash"], "left_semi").select("idx")


def funnel(files: DataFrame, contents: Contents, min_size: int = 1, cache: DataFrame | None = None) -> DataFrame:
    """One row: survivors of each stage, groups, files hashed whole, files that could not be read, bytes read.

    A file whose hash the cache knows counts as neither hashed nor read beyond its first 16 KiB. One of more than
    16 KiB that cannot be read again is an error, and no survivor of the third stage.
    """
    quick = with_quick(same_size(files, min_size), contents)
    second = with_full(same_prefix(quick), contents, cache)
    third = second.filter(F.col("hash").isNotNull()).groupBy("size", "hash").agg(F.count("*").alias("n")).filter("n >= 2")
    whole = (F.col("size") > PREFIX) & F.col("cached").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    a = quick.agg(F.count("*").alias("stage1"), total("quick_bytes").alias("prefix_bytes"), F.count_if(F.col("quick").isNull()).alias("unread"))
    b = second.agg(F.count("*").alias("stage2"), F.count_if(whole).alias("hashed"), total("full_bytes").alias("full_bytes"), F.count_if(F.col("hash").isNull()).alias("lost"))
    c = third.agg(F.count("*").alias("groups"), total("n").alias("stage3"))
    one = [x.withColumn("_one", F.lit(1)) for x in (a, b, c)]  # single rows
    joined = one[0].join(one[1], "_one").join(one[2], "_one")
    return joined.select("stage1", "stage2", "stage3", "groups", "hashed", (F.col("unread") + F.col("lost")).alias("errors"), (F.col("prefix_bytes") + F.col("full_bytes")).alias("read_bytes"))


def errors(quick: DataFrame, second: DataFrame) -> DataFrame:
    """(path, error) of what ``with_quick`` and ``with_full`` could not read."""
    first, later = quick.filter("quick is null"), second.filter("hash is null")
    return first.select("path", F.col("quick_error").alias("error")).unionByName(later.select("path", F.col("full_error").alias("error")))


def learned(second: DataFrame) -> DataFrame:
    """(key, size, mtime, full) of what ``with_full`` or ``matched`` hashed whole, for ``store.merged_cache``; a file
    of unknown time is not remembered."""
    new = second.filter((F.col("size") > PREFIX) & F.col("cached").isNull() & F.col("hash").isNotNull() & (F.col("mtime") != 0))
    return new.select(normalize_key(F.col("path")).alias("key"), "size", "mtime", F.col("hash").alias("full"))


def keepers(rows: DataFrame, usage: DataFrame) -> DataFrame:
    """The plan for the groups whose ``members`` are given: which file stays and why, all others go.

    Most used first, then newest, then shortest path, then path; ``why`` names the first rule that set the file
    apart from the next one. The best file and the one after it are found by partial aggregation, so that no group
    is sorted in one task.
    """
    used = usage.select(F.col("key").alias("_key"), F.col("count").alias("_count"))
    rows = rows.join(used, normalize_key(F.col("path")) == F.col("_key"), "left").withColumn("uses", F.coalesce("_count", F.lit(0)).cast("long"))
    rank = F.struct((-F.col("uses")).alias("uses"), (-F.col("mtime")).alias("mtime"), F.length("path").alias("length"), F.col("path").alias("path"), F.col("idx").alias("idx"))
    rows = rows.withColumn("_rank", rank)
    best = rows.groupBy("group_no").agg(F.min("_rank").alias("_best"))
    rows = cut(rows.join(best, "group_no"))
    after = rows.filter(F.col("_rank") > F.col("_best")).groupBy("group_no").agg(F.min("_rank").alias("_next"))
    rows = rows.join(after, "group_no", "left")
    uses = F.when(F.col("uses") > 0, F.concat(F.lit("사용 "), F.col("uses").cast("string"), F.lit("회"))).otherwise(F.lit("사용 기록 없음"))
    stays = F.col("_rank") == F.col("_best")
    why = (
        F.when(~stays, uses)
        .when(F.col("uses") > F.coalesce(-F.col("_next.uses"), F.lit(0)), F.concat(uses, F.lit(" — 가장 많이 열었다")))
        .when(F.col("mtime") > F.coalesce(-F.col("_next.mtime"), F.lit(0)), F.lit("가장 최근에 수정했다"))
        .otherwise(F.lit("경로가 가장 짧다"))
    )
    action = F.when(stays, F.lit("남김")).otherwise(F.lit("정리"))
    return rows.select("group_no", action.alias("action"), "path", "size", "uses", why.alias("why"))


def families(files: DataFrame) -> DataFrame:
    """Probable versions of one document, by name alone: (family, n, path, idx), a row for each member of two or more."""
    keyed = files.filter(~F.col("is_dir")).select(family_key(F.col("name")).alias("family"), "path", "idx")
    several = keyed.groupBy("family").agg(F.count("*").alias("n")).filter("n >= 2")
    return keyed.join(several, "family").select("family", "n", "path", "idx")
