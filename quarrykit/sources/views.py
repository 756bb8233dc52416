"""The engine's input tables, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions.text import extension

NOW = 1706745600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's folder; sizes are UTF-8 bytes. The text itself is in ``content``."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return d.select(
        F.col("doc_id").alias("idx"),
        F.concat(F.lit("/"), F.col("source")).alias("parent"),
        name.alias("name"),
        F.lit(False).alias("is_dir"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(1704067200) + 60 * F.col("doc_id")).alias("mtime"),
        (F.col("doc_id") + 1).alias("file_id"),
        F.concat(F.lit("/"), F.col("source"), F.lit("/"), name).alias("path"),
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.encode("text", "UTF-8").alias("content"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` with their folders and the root, whose parent is null; folders have no size."""
    f = files(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    folders = sources.select(
        (-1 - F.abs(F.hash("source")).cast("long")).alias("idx"), F.lit("/").alias("parent"), F.col("source").alias("name"), F.lit(True).alias("is_dir"),
        F.lit(None).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("file_id"), F.concat(F.lit("/"), F.col("source")).alias("path"),
    )
    root = spark.range(1).select(
        F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("string").alias("parent"), F.lit("/").alias("name"), F.lit(True).alias("is_dir"),
        F.lit(None).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("file_id"), F.lit("/").alias("path"),
    )
    return f.unionByName(folders).unionByName(root)


def usage_log(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    """Events as uses of files, errors as uses of files that are gone; ``late`` shuffles their arrival."""
    e = table(spark, sf_dir, "events")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.concat(F.lit("/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("doc_path"))
    joined = e.join(d, F.col("user_id") == F.col("doc_id"), "left")
    path = F.when(F.col("event_type") == "error", F.concat(F.lit("/gone/u"), F.col("user_id").cast("string"))).otherwise(F.col("doc_path"))
    seq = (F.col("event_id") % 7) * F.lit(1000000000000) + F.col("event_id") if late else F.col("event_id")
    return joined.select(seq.alias("seq"), path.alias("path"), F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")).alias("ts"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: path without scheme, query and fragment."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", "^[^:]*://([^?#]*)", 1)
    rows = p.select(F.col("page_id").alias("idx"), path.alias("path"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return rows.select("idx", F.regexp_extract("path", "^([^/]*)", 1).alias("parent"), name.alias("name"), F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("file_id"), "path", extension(name).alias("ext"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, customers and suppliers as raw nodes; the kind is in the id's top byte. Every seventh supplier's
    nation is unknown."""
    n = table(spark, sf_dir, "nation").select(_tag(2, "n_nationkey"), _tag(1, "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"), F.lit(True).alias("is_dir"))
    c = table(spark, sf_dir, "customer").select(_tag(3, "c_custkey"), _tag(2, "c_nationkey").alias("parent_id"), F.col("c_name").alias("name"), F.lit(False).alias("is_dir"))
    away = F.when(F.col("s_suppkey") % 7 == 0, F.lit(999)).otherwise(F.col("s_nationkey"))
    s = table(spark, sf_dir, "supplier").withColumn("_n", away).select(_tag(4, "s_suppkey"), _tag(2, "_n").alias("parent_id"), F.col("s_name").alias("name"), F.lit(False).alias("is_dir"))
    return n.unionByName(c).unionByName(s)


def sized_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nodes``, the files among them with a size and a time."""
    key = F.col("file_id").bitwiseAND(F.lit((1 << 32) - 1))
    return nodes(spark, sf_dir).withColumns({"size": F.when(~F.col("is_dir"), key * 37 % 5000), "mtime": F.when(F.col("is_dir"), F.lit(0)).otherwise(NOW - key * 60)})


def broken_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nodes`` and the parts, ten in a row: each part's parent is the next one. The last of ten has its first one as
    parent (a cycle), one that is not there, or a nation, by turns."""
    key, row = F.col("p_partkey").cast("long"), F.floor(F.col("p_partkey") / 10)
    last = F.when(row % 3 == 0, _id(5, row * 10)).when(row % 3 == 1, _id(6, key)).otherwise(_id(2, row % 25))
    up = F.when(key % 10 < 9, _id(5, key + 1)).otherwise(last)
    parts = table(spark, sf_dir, "part").select(_id(5, key).alias("file_id"), up.alias("parent_id"), F.col("p_name").alias("name"), F.lit(False).alias("is_dir"))
    return nodes(spark, sf_dir).unionByName(parts)


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(_tag(1, "r_regionkey"), F.concat(F.lit("/"), F.col("r_name")).alias("path"))


def _id(kind: int, key: Column) -> Column:
    return key.cast("long").bitwiseOR(F.shiftleft(F.lit(kind).cast("long"), 56))


def _tag(kind: int, c: str):
    return F.col(c).cast("long").bitwiseOR(F.shiftleft(F.lit(kind).cast("long"), 56)).alias("file_id")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as papers: turns as numbered lines."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.regexp_replace("text", r"\s+", " "))
    lines = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return lines.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as whole papers: the turns stand once below the first notice and once below an essay notice."""
    t = numbered(spark, sf_dir)
    text = F.concat(F.lit("13문제 중 10문제\n"), F.col("text"), F.lit("\n6문제 중 4문제\n"), F.col("text"))
    source = F.concat(F.lit("제"), F.floor(F.col("conv_id") / 2).cast("string"), F.lit("회 (2020년)_"), F.col("conv_id").cast("string"), F.lit(".pdf"))
    return t.select("conv_id", source.alias("source"), text.alias("text"))


def full_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as papers of four periods, their turns used again and again as text.

    Every second paper has period marks. A number out of sequence follows the last short item; each essay item has
    two sub-items, of which the second goes on in a further line; every seventh paper lacks the last item of its last
    period; the third period has a specification, to which its fourth item refers.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    t = c.filter("text != ''").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("l"))

    def turn(k: Column) -> Column:
        return F.get("l", F.pmod(k, F.size("l")))

    def mark(period: int) -> list[Column]:
        return [F.when(F.col("conv_id") % 2 == 0, F.lit(f"제 {period} 교시"))]

    def item(period: int, no: int) -> list[Column]:
        stem = F.concat(F.lit(f"{no}. "), F.lit("아래 명세 참조 ") if (period, no) == (3, 4) else F.lit(""), turn(F.lit(period + no)))
        rows = [stem, F.concat(F.lit("가. "), turn(F.lit(no))), F.lit("나. 이어짐"), turn(F.lit(period))]
        return [F.when(F.col("conv_id") % 7 > 0, r) for r in rows] if (period, no) == (4, 6) else rows

    lines = [*mark(1), F.lit("13문제 중 10문제"), *(F.concat(F.lit(f"{no}. "), turn(F.lit(no))) for no in range(1, 14)), F.lit("40. 번호가 아닌 줄")]
    for period in (2, 3, 4):
        lines += [*mark(period), F.lit("6문제 중 4문제"), *(x for no in range(1, 7) for x in item(period, no))]
        if period == 3:
            lines += [F.concat(F.lit("[명세] "), turn(F.lit(0))), F.lit("※ 끝")]
    year = F.when(F.col("conv_id") % 3 > 0, F.lit(" (2021년)")).otherwise(F.lit(""))
    source = F.concat(F.lit("제"), F.col("conv_id").cast("string"), F.lit("회"), year, F.lit(".pdf"))
    return t.select("conv_id", source.alias("source"), F.array_join(F.array(*lines), "\n").alias("text"))


def with_hardlinks(f: DataFrame) -> DataFrame:
    """``files`` with a second name for every fiftieth: other idx and path, same file_id."""
    copy = f.filter(F.col("idx") % 50 == 0).withColumns({"idx": F.col("idx") + F.lit(1000000000000), "path": F.concat(F.lit("/links"), F.col("path")), "parent": F.lit("/links")})
    return f.unionByName(copy)


def with_linked_content(c: DataFrame) -> DataFrame:
    return c.unionByName(c.filter(F.col("idx") % 50 == 0).withColumn("idx", F.col("idx") + F.lit(1000000000000)))
