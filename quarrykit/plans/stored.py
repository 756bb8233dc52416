"""Registered queries about files on disk, stores and arriving papers; all are derived from the driver's tables first."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import text as fn
from quarrykit.operators import dup, folder_search, papers, report, search, tree, usage
from quarrykit.operators.hashing import PathContents
from quarrykit.operators.numbering import scratch
from quarrykit.plans.catalogue import FILES, FOLD, FOUND, NODES, NOW, ROW, SQL, TREE, TURNS, decay, found, groups_sql, register, state, usage_sql
from quarrykit.sources import listing, store, versions, views
from quarrykit.streaming import paper_stream, usage_stream

#: When files that these queries write were last changed.
WRITTEN = 1_700_000_000


def local(path: str) -> str:
    """A path of the shared folder as the operating system knows it, which all executors have to mount."""
    return path.removeprefix("file://").removeprefix("file:")


def written(rows: DataFrame, name: str) -> str:
    """Writes rows (path, content) as files below a fresh folder of the shared one, a task its own rows; the folder."""
    top = local(scratch(rows.sparkSession, name))

    def write(part):
        for row in part:
            at = top + row["path"]
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "wb") as f:
                f.write(row["content"])
            os.utime(at, (WRITTEN, WRITTEN))

    # row by row: an Arrow batch has ten thousand contents, and a worker would hold them twice
    rows.select("path", "content").foreachPartition(write)
    return top


def documents(spark: SparkSession, d: str) -> str:
    rows = views.files(spark, d).select("idx", "path").join(views.content(spark, d), "idx")
    return written(rows, "documents")


def below(top: str):
    """The path below a folder, ``/`` for itself."""
    return F.when(F.col("path") == top, F.lit("/")).otherwise(F.substring("path", len(top) + 1, 1 << 30))


@register("folder_scan", f"WITH {FILES}, {TREE} SELECT path, is_dir, size FROM tree")
def _(spark, d):
    top = documents(spark, d)
    return listing.folders(spark, [top]).select(below(top).alias("path"), "is_dir", "size")


@register("folder_scan_counts", f"""WITH {FILES} SELECT count(*) FILTER (parent <> '/src1')::BIGINT AS files, (count(DISTINCT parent) FILTER (parent <> '/src1') + 1)::BIGINT AS dirs,
  (count(DISTINCT parent) FILTER (parent = '/src1'))::BIGINT AS skipped, 1::BIGINT AS errors FROM files""")
def _(spark, d):
    top = documents(spark, d)
    return listing.scan_counts(listing.scanned(spark, [top, f"{top}/not there"], exclude=["SRC1"]))


@register("folder_find", f"WITH {FILES} SELECT path, size FROM files WHERE contains({FOLD.format('name')}, 'c_1') AND name LIKE '%.en' AND size > 1024 ORDER BY size DESC, path LIMIT 30")
def _(spark, d):
    top = documents(spark, d)
    rows = folder_search.find(spark, [top], "c_1 ext:en size:>1kb", state(spark, d).limit(0), sort="size", limit=0, now=NOW)
    shown = rows.select(below(top).alias("path"), "size")
    return shown.orderBy(F.desc("size"), "path").limit(30)


@register("dup_by_path", SQL["dup_members"].replace("f.idx, path", "path").replace("hash, wasted, idx, path", "hash, wasted, path"))
def _(spark, d):
    top = documents(spark, d)
    files = listing.folders(spark, [top])
    rows = dup.matched(files, PathContents())
    return dup.members(rows, dup.groups(rows)).select("group_no", "hash", "wasted", below(top).alias("path"))


@register("dup_report_first", f"WITH {FILES}, {groups_sql()} SELECT group_no, hash[1:12] AS hash, size, wasted FROM groups WHERE group_no <= 10")
def _(spark, d):
    first, _ = report.dup_report(dup.groups(found(spark, d)), 10)
    return first.select("group_no", "hash", "size", "wasted")


@register("usage_store", f"WITH {FILES}, {usage_sql(half_life=1.0)} SELECT key, path, round(score, 6) AS score, count, last FROM usage WHERE {decay('score', f'{NOW} - last', 1.0)} >= 0.001")
def _(spark, d):
    """Written, and rewritten from itself."""
    at = scratch(spark, "usage")
    store.write_usage(state(spark, d, half_life=1.0), at, NOW, 1.0)
    store.write_usage(store.read_usage(spark, at), at, NOW, 1.0)
    return store.read_usage(spark, at).select("key", "path", F.round("score", 6).alias("score"), "count", "last")


@register("hash_cache_store", f"""WITH {FILES} SELECT path AS key, size, CASE WHEN idx % 3 = 0 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN idx % 3 = 0 THEN 'new' ELSE 'old' END AS full
  FROM files WHERE idx % 2 = 0 OR idx % 3 = 0""")
def _(spark, d):
    f, at = views.files(spark, d), scratch(spark, "cache")
    rows = lambda every, age, mark: f.filter(F.col("idx") % every == 0).select(F.col("path").alias("key"), "size", (F.col("mtime") + age).alias("mtime"), F.lit(mark).alias("full"))
    store.write_cache(store.read_cache(spark, at), rows(2, 0, "old"), at)
    store.write_cache(store.read_cache(spark, at), rows(3, 1, "new"), at)
    return store.read_cache(spark, at)


@register("index_store", f"WITH {FILES}, {TREE} SELECT path, is_dir, size, parent FROM tree")
def _(spark, d):
    at = scratch(spark, "index")
    store.write_index(views.tree(spark, d), at)
    return store.read_index(spark, at).select("path", "is_dir", "size", "parent")


@register("sort_frecency_alias", f"{FOUND} SELECT idx, path, size, count, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, path, idx LIMIT 15")
def _(spark, d):
    rows = search.search(views.files(spark, d), "", state(spark, d), sort="frecency", limit=15, now=NOW)
    return rows.select("idx", "path", "size", "count", F.round("score", 6).alias("score"))


@register("exclude_raw_names", f"WITH RECURSIVE {NODES} SELECT file_id FROM nodes WHERE NOT ({FOLD.format('name')} = 'nation_3' OR {FOLD.format('name')} LIKE 'customer%7')")
def _(spark, d):
    return tree.exclude_raw(views.nodes(spark, d), ["NATION_3", "customer*7", "/nation_4"]).select("file_id")


@register("child_lookup", f"WITH RECURSIVE {NODES} SELECT file_id FROM nodes WHERE parent_id = ((1::BIGINT << 56) | 2) AND name IN (SELECT n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_name LIMIT 1)")
def _(spark, d):
    n = views.table(spark, d, "nation")
    name = n.filter("n_regionkey = 2").agg(F.min("n_name")).first()[0]
    return tree.child(views.nodes(spark, d).withColumnRenamed("parent_id", "parent"), 2 | 1 << 56, name).select("file_id")


@register("volume_paths", r"SELECT n_nationkey, upper(v) || ':\' AS root, '\\.\' || upper(v) || ':' AS device FROM (SELECT n_nationkey, chr(97 + CAST(n_nationkey % 26 AS INTEGER)) AS v FROM nation)")
def _(spark, d):
    text = F.concat(F.char(97 + F.col("n_nationkey") % 26), F.lit(":"), F.when(F.col("n_nationkey") % 3 == 0, "\\").when(F.col("n_nationkey") % 3 == 1, "/").otherwise(""))
    return views.table(spark, d, "nation").select("n_nationkey", fn.volume_root(text).alias("root"), fn.volume_device(text).alias("device"))


@register("scan_progress", "SELECT doc_id, round(384400.0::DOUBLE * (t - doc_id) / t, 6) AS km_left, round((doc_id + 1)::DOUBLE / 7 * 384400.0::DOUBLE / t * 3600, 6) AS km_per_hour FROM documents, (SELECT count(*)::DOUBLE AS t FROM documents)")
def _(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id")
    done, total = F.col("doc_id").cast("double"), F.lit(float(docs.count()))
    left, _, _ = fn.progress(done, total, F.lit(7.0))
    _, speed, _ = fn.progress(done + 1, total, F.lit(7.0))
    return docs.select("doc_id", F.round(left, 6).alias("km_left"), F.round(speed, 6).alias("km_per_hour"))


@register("paper_failures", f"WITH {TURNS} SELECT '제' || round || '회 (2020년)_' || conv_id || '.pdf' AS source, 'too little text' AS reason FROM p WHERE conv_id NOT IN (SELECT conv_id FROM good)")
def _(spark, d):
    return papers.failures(papers.structured(views.papers(spark, d)))


@register("paper_json_parts", f"WITH {TURNS} SELECT round::INT AS round, p1::INT AS short, 1 AS blocks, e::INT AS items, '2020' AS year FROM good")
def _(spark, d):
    rows = store.paper_json(papers.structured(views.papers(spark, d)))
    part = lambda at: F.json_array_length(F.get_json_object("json", at))
    return rows.select("round", part("$.period1").alias("short"), part("$.essay").alias("blocks"), part("$.essay[0].items").alias("items"), F.get_json_object("json", "$.year").alias("year"))


@register("summary_lines", f"WITH {TURNS}, s AS (SELECT {ROW} FROM good) SELECT round, '| ' || concat_ws(' | ', label, year, p1, essay_counts, total, status) || ' |' AS line FROM s")
def _(spark, d):
    return report.summary_lines(papers.summary(papers.structured(views.papers(spark, d))))


@register("papers_arrived", f"""WITH {TURNS}, named AS (SELECT *, '제' || round || '회 (2020년)_' || conv_id || '.pdf' AS source FROM good)
  SELECT round::INT AS round, source, p1::INT AS p1 FROM named QUALIFY row_number() OVER (PARTITION BY round ORDER BY source DESC) = 1""")
def _(spark, d):
    """Papers as files of one time, of which a stream keeps one a round."""
    rows = views.papers(spark, d).select(F.concat(F.lit("/"), "source").alias("path"), F.encode("text", "UTF-8").alias("content"))
    top, out = written(rows, "papers"), scratch(spark, "arrived")
    query = paper_stream.structure(paper_stream.arriving(spark, top), out, scratch(spark, "arriving"))
    query.awaitTermination()
    return versions.Versions(spark, f"{out}/papers").read().select("round", "source", F.size("period1").alias("p1"))


@register("usage_live", f"WITH {FILES}, {usage_sql(half_life=3650.0)} SELECT key, path, round(score, 6) AS score, count, last FROM usage")
def _(spark, d):
    """The earlier half of the log as a stored table, the later half as a stream that starts from it; the states at its end.

    The stream runs in a session of its own, which has the settings of keyed states; a half-life of ten years keeps all.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", usage_stream.PROVIDER)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    days, log = 3650.0, views.usage_log(own, d)
    middle = log.agg(F.floor(F.max("seq") / 2)).first()[0]
    stored, arriving, at = (scratch(spark, x) for x in ("stored", "uses", "live"))
    store.write_usage(usage.fold(log.filter(F.col("seq") <= middle), days), stored, NOW, days)
    log.filter(F.col("seq") > middle).write.parquet(arriving)
    stream = own.readStream.schema("seq long, path string, ts long").parquet(arriving)
    live = usage_stream.live_usage(stream, days, stored=store.read_usage(own, stored))
    query = live.writeStream.outputMode("update").foreachBatch(lambda batch, _: batch.write.format("noop").mode("overwrite").save()).option("checkpointLocation", at).start()
    try:
        n, until = own.read.parquet(arriving).count(), time.time() + 900
        while sum(p["numInputRows"] for p in query.recentProgress) < n:  # a stream with timers never ends by itself
            if query.exception() or time.time() > until:
                raise RuntimeError(f"the stream did not take all uses: {query.exception()}")
            time.sleep(0.5)
    finally:
        query.stop()
    kept = scratch(spark, "states")
    usage_stream.states(own, at).write.parquet(kept)
    return spark.read.parquet(kept).select("key", "path", F.round("score", 6).alias("score"), "count", "last")
