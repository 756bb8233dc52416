"""Registered queries over the driver's tables, and the SQL whose results they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import text as fn
from quarrykit.operators import dup, node_search, papers, search, tree, usage
from quarrykit.plans.query import parse
from quarrykit.sources import usn, views

NOW = views.NOW
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FILES = r"""files AS (
  SELECT doc_id AS idx, '/' || source AS parent, 'doc_' || doc_id || '.' || lang AS name, false AS is_dir, strlen(text)::BIGINT AS size,
         (1704067200 + 60 * doc_id)::BIGINT AS mtime, (doc_id + 1)::BIGINT AS file_id, '/' || source || '/doc_' || doc_id || '.' || lang AS path, text
  FROM documents)"""


def usage_sql(seq: str = "event_id", half_life: float = 30.0) -> str:
    return rf"""log AS (
  SELECT {seq} AS seq, CASE WHEN event_type = 'error' THEN '/gone/u' || user_id ELSE f.path END AS path, floor(epoch(ts))::BIGINT AS ts
  FROM events LEFT JOIN files f ON user_id = f.idx
), run AS (
  SELECT path, seq, max(ts) OVER (PARTITION BY path ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top_ts FROM log
), lasts AS (SELECT *, max(top_ts) OVER (PARTITION BY path) AS last FROM run
), usage AS (
  SELECT path AS key, path, sum(pow(0.5::DOUBLE, (last - top_ts)::DOUBLE / ({half_life} * 86400)::DOUBLE)) AS score, count(*)::BIGINT AS count, max(last)::BIGINT AS last
  FROM lasts GROUP BY path)"""


def decay(score: str, seconds: str, half_life: float = 30.0) -> str:
    return f"({score} * pow(0.5::DOUBLE, greatest(({seconds})::DOUBLE, 0::DOUBLE) / ({half_life} * 86400)::DOUBLE))"


HITS = rf"""hits AS (
  SELECT f.*, coalesce({decay("u.score", f"{NOW} - u.last")}, 0) AS score, coalesce(u.count, 0)::BIGINT AS count
  FROM files f LEFT JOIN usage u ON u.key = f.path)"""
FOUND = f"WITH {FILES}, {usage_sql()}, {HITS}"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SHOWN = "idx, path, size, count, round(score, 6) AS score"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def state(spark: SparkSession, d: str, late: bool = False, half_life: float = 30.0) -> DataFrame:
    return usage.fold(views.usage_log(spark, d, late), half_life)


def shown(df: DataFrame) -> DataFrame:
    return df.select("idx", "path", "size", "count", F.round("score", 6).alias("score"))


def register_search(name: str, query: str, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return shown(search.hits(views.files(spark, d), query, state(spark, d), views.content(spark, d), NOW))

    register(name, f"{FOUND} SELECT {SHOWN} FROM hits WHERE {where}")(run)


LOW = FOLD.format("name")
LOW_PATH = FOLD.format("path")
for _name, _query, _where in [
    ("search_substr", "DOC_1", f"contains({LOW}, 'doc_1')"),
    ("search_multi_and", "doc_2 .EN 5", f"contains({LOW}, 'doc_2') AND contains({LOW}, '.en') AND contains({LOW}, '5')"),
    ("search_neg", "doc_ !doc_9 !.de", f"contains({LOW}, 'doc_') AND NOT contains({LOW}, 'doc_9') AND NOT contains({LOW}, '.de')"),
    ("search_glob_star", "DOC_*1*.e*", f"{LOW} LIKE 'doc\\_%1%.e%' ESCAPE '\\'"),
    ("search_glob_q", "doc_?7.??", f"{LOW} LIKE 'doc\\__7.__' ESCAPE '\\'"),
    ("search_path", "src1/doc_1 path:/SRC1*", f"contains({LOW_PATH}, 'src1/doc_1') AND {LOW_PATH} LIKE '/src1%'"),
    ("search_ext_list", "ext:DE,.fr", f"regexp_extract({LOW}, '^.+\\.([^.]+)$', 1) IN ('de', 'fr')"),
    ("search_size_gt", "size:>10kb", "size > 10240"),
    ("search_size_ge", "size:>=1024", "size >= 1024"),
    ("search_size_lt", "size:<0.5kb", "size < 512"),
    ("search_size_le", "size:<=300b", "size <= 300"),
    ("search_size_eq", "!size:=1kb size:<2k", "size <> 1024 AND size < 2048"),
    ("search_runcount", "runcount:>2", "count > 2"),
    ("search_runcount_eq", "rc:=0 ext:es", f"count = 0 AND {LOW} LIKE '%.es'"),
    ("search_quoted", '"doc_1"2 path:"src"', f"contains({LOW}, 'doc_12') AND contains({LOW_PATH}, 'src')"),
    ("search_unknown_key", "doc:1", f"contains({LOW}, 'doc:1')"),
]:
    register_search(_name, _query, _where)

HASHED = r"""quick AS (
  SELECT *, sha256(unhex(printf('%016X', least(size, 16384))) || encode(text)[1:16384]) AS q, sha256(encode(text)) AS full_hash FROM {source}
), named AS (SELECT *, CASE WHEN size <= 16384 THEN q ELSE full_hash END AS hash FROM quick)"""
GROUPS = r"""sets AS (
  SELECT hash, size, list(idx ORDER BY path) AS members, (count(DISTINCT nullif(file_id, 0)) + count(*) FILTER (file_id = 0))::BIGINT AS physical
  FROM named WHERE size >= {least} GROUP BY hash, size HAVING count(*) >= 2
), groups AS (
  SELECT (row_number() OVER (ORDER BY size * (physical - 1) DESC, size DESC, hash))::INT AS group_no, hash, size, members, physical, physical <= 1 AS all_hardlinked, size * (physical - 1) AS wasted
  FROM sets WHERE {which})"""


def groups_sql(source: str = "files", least: int = 1, which: str = "physical > 1") -> str:
    return HASHED.format(source=source) + ", " + GROUPS.format(least=least, which=which)


LINKED = f"""linked AS (
  SELECT idx, path, size, file_id, text FROM files
  UNION ALL SELECT idx + 1000000000000, '/links' || path, size, file_id, text FROM files WHERE idx % 50 = 0)"""
GROUP_COLUMNS = "group_no, hash, size, array_to_string(members, ',') AS members, physical, all_hardlinked, wasted"


@register("search_dup", f"{FOUND}, {groups_sql()} SELECT {SHOWN} FROM hits WHERE idx IN (SELECT unnest(members) FROM groups)")
def _(spark, d):
    return shown(search.hits(views.files(spark, d), "dup:", state(spark, d), views.content(spark, d), NOW))


@register("search_not_dup", f"{FOUND}, {groups_sql()} SELECT {SHOWN} FROM hits WHERE idx NOT IN (SELECT unnest(members) FROM groups)")
def _(spark, d):
    return shown(search.hits(views.files(spark, d), "!dup:", state(spark, d), views.content(spark, d), NOW))


@register("search_dup_scoped", f"{FOUND}, part AS (SELECT * FROM files WHERE {FOLD.format('name')} LIKE '%.en' AND size > 500), {groups_sql('part')} SELECT {SHOWN} FROM hits WHERE idx IN (SELECT unnest(members) FROM groups)")
def _(spark, d):
    return shown(search.hits(views.files(spark, d), "ext:en dup: size:>500", state(spark, d), views.content(spark, d), NOW))


@register("search_mark_dup", f"{FOUND}, cut AS (SELECT * FROM hits ORDER BY mtime DESC, idx LIMIT 300), {groups_sql('cut')}, tags AS (SELECT unnest(members) AS idx, group_no FROM groups) SELECT cut.idx, path, coalesce(tags.group_no, 0) AS dup_tag FROM cut LEFT JOIN tags USING (idx)")
def _(spark, d):
    first = search.search(views.files(spark, d), "doc", state(spark, d), sort="date", limit=300, now=NOW)
    return search.tagged(first, views.content(spark, d)).select("idx", "path", F.coalesce("dup_tag", F.lit(0)).alias("dup_tag"))


TREE = rf"""tree AS (
  SELECT idx, parent, name, is_dir, size, mtime, path FROM files
  UNION ALL SELECT DISTINCT NULL::BIGINT, '/', source, true, NULL::BIGINT, 0::BIGINT, '/' || source FROM documents
  UNION ALL SELECT NULL, NULL, '/', true, NULL, 0, '/')"""


def register_kind(name: str, query: str, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.hits(views.tree(spark, d), query, state(spark, d), now=NOW).select("path", "is_dir", F.coalesce("size", F.lit(-1)).cast("long").alias("size"))

    register(name, f"WITH {FILES}, {TREE} SELECT path, is_dir, coalesce(size, -1)::BIGINT AS size FROM tree WHERE parent IS NOT NULL AND {where}")(run)


register_kind("search_kind_file", "file: 7", "NOT is_dir AND contains(name, '7')")
register_kind("search_kind_dir", "folder: src1", "is_dir AND contains(name, 'src1')")
register_kind("search_dir_size", "size:<400", "coalesce(size, 0) < 400")
register_kind("search_all", "", "true")

for _sort, _by in [("freq", "score DESC, path"), ("name", "lower(name), idx"), ("size", "size DESC, idx"), ("date", "mtime DESC, idx")]:

    def _run(spark: SparkSession, d: str, sort: str = _sort) -> DataFrame:
        return shown(search.search(views.files(spark, d), "doc", state(spark, d), sort=sort, limit=50, now=NOW))

    register(f"sort_{_sort}", f"{FOUND} SELECT {SHOWN} FROM hits ORDER BY {_by} LIMIT 50")(_run)


@register("search_total", f"{FOUND} SELECT count(*)::BIGINT AS total FROM hits WHERE size > 1024")
def _(spark, d):
    return search.total(search.hits(views.files(spark, d), "size:>1kb", state(spark, d), now=NOW))


HUMAN = """CASE WHEN b IS NULL THEN '-' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE)
  WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', b / 1099511627776.0::DOUBLE) END"""
LINES = rf"""freq AS (SELECT *, size AS b FROM {{0}}), lines AS (
  SELECT *, CASE WHEN count > 0 THEN printf('%4d회 %6.2f', count, score) ELSE '   -        -' END || '  ' || lpad({HUMAN}, 9, ' ') || '  ' || path AS line FROM freq)"""


@register("search_rendered", f"{FOUND}, {groups_sql()}, tags AS (SELECT unnest(members) AS idx, group_no FROM groups), {LINES.format('hits')} SELECT line || CASE WHEN group_no IS NULL THEN '' ELSE ' [중복 ' || group_no || ']' END AS line FROM lines LEFT JOIN tags USING (idx)")
def _(spark, d):
    first = search.search(views.files(spark, d), "doc", state(spark, d), limit=0, now=NOW)
    return search.rendered(search.tagged(first, views.content(spark, d)))


@register("search_numbered", f"{FOUND}, first AS (SELECT *, row_number() OVER (ORDER BY size DESC, idx) AS no FROM hits), {LINES.format('first')} SELECT printf('%4d. ', no) || line AS line FROM lines WHERE no <= 200 UNION ALL SELECT '... 전체 ' || count(*) || ' 건 중 200 건' FROM hits HAVING count(*) > 200")
def _(spark, d):
    hits = search.hits(views.files(spark, d), "doc", state(spark, d), now=NOW)
    return search.rendered(search.results(hits, sort="size", limit=200)).unionByName(search.footer(hits, limit=200))


@register("search_urls", r"""SELECT page_id AS idx, path, nullif(regexp_extract(name, '^.+\.([^.]+)$', 1), '') AS ext FROM (SELECT page_id, regexp_extract(url, '^[^:]*://([^?#]*)', 1) AS path, regexp_extract(regexp_extract(url, '^[^:]*://([^?#]*)', 1), '([^/]*)$', 1) AS name FROM pages) WHERE regexp_extract(name, '^.+\.([^.]+)$', 1) = 'html' AND NOT contains(path, '/en/')""")
def _(spark, d):
    from quarrykit.plans.compile import predicate

    return views.urls(spark, d).filter(predicate(parse("ext:html !path:/en/"))).select("idx", "path", "ext")


def found(spark: SparkSession, d: str, linked: bool = False, **options) -> DataFrame:
    f, c = views.files(spark, d), views.content(spark, d)
    return dup.matched(views.with_hardlinks(f), views.with_linked_content(c), **options) if linked else dup.matched(f, c, **options)


def listed(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Groups with their members as text in order of path: the form in which the SQL shows them, not for large groups."""
    each = dup.members(rows, of).groupBy("group_no").agg(F.array_sort(F.collect_list(F.struct("path", "idx"))).alias("m"))
    shown_as = F.array_join(F.transform("m", lambda x: x["idx"].cast("string")), ",")
    return of.join(each, "group_no").select("group_no", "hash", "size", shown_as.alias("members"), "physical", "all_hardlinked", "wasted")


@register("dup_groups", f"WITH {FILES}, {groups_sql()} SELECT {GROUP_COLUMNS} FROM groups")
def _(spark, d):
    rows = found(spark, d)
    return listed(rows, dup.groups(rows))


@register("dup_members", f"WITH {FILES}, {groups_sql()}, m AS (SELECT group_no, hash, wasted, unnest(members) AS idx FROM groups) SELECT group_no, hash, wasted, idx, path FROM m JOIN files USING (idx)")
def _(spark, d):
    rows = found(spark, d)
    return dup.members(rows, dup.groups(rows)).select("group_no", "hash", "wasted", "idx", "path")


@register("dup_min_size", f"WITH {FILES}, {groups_sql(least=2048)} SELECT {GROUP_COLUMNS} FROM groups")
def _(spark, d):
    rows = found(spark, d, min_size=2048)
    return listed(rows, dup.groups(rows))


@register("dup_hardlinks_excluded", f"WITH {FILES}, {LINKED}, {groups_sql('linked')} SELECT {GROUP_COLUMNS} FROM groups")
def _(spark, d):
    rows = found(spark, d, linked=True)
    return listed(rows, dup.groups(rows))


@register("dup_hardlinks_included", f"WITH {FILES}, {LINKED}, {groups_sql('linked', which='true')} SELECT {GROUP_COLUMNS} FROM groups")
def _(spark, d):
    rows = found(spark, d, linked=True)
    return listed(rows, dup.groups(rows, include_hardlinks=True))


@register("dup_report_totals", f"WITH {FILES}, {groups_sql()} SELECT count(*)::BIGINT AS groups, coalesce(sum(wasted), 0)::BIGINT AS wasted, coalesce(sum(len(members)), 0)::BIGINT AS members FROM groups")
def _(spark, d):
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for c, k in (("wasted", "wasted"), ("n", "members"))]
    return dup.groups(found(spark, d)).agg(F.count("*").alias("groups"), *sums)


@register(
    "dup_funnel_counts",
    f"""WITH {FILES}, {HASHED.format(source="files")}, s1 AS (SELECT * FROM named WHERE size >= 1 AND size IN (SELECT size FROM files WHERE size >= 1 GROUP BY size HAVING count(*) >= 2)),
s2 AS (SELECT * FROM s1 WHERE (size, q) IN (SELECT size, q FROM s1 GROUP BY size, q HAVING count(*) >= 2)), s3 AS (SELECT size, hash, count(*) AS n FROM s2 GROUP BY size, hash HAVING count(*) >= 2)
SELECT (SELECT count(*) FROM s1)::BIGINT AS stage1, (SELECT count(*) FROM s2)::BIGINT AS stage2, (SELECT coalesce(sum(n), 0) FROM s3)::BIGINT AS stage3, (SELECT count(*) FROM s3)::BIGINT AS groups,
(SELECT count(*) FROM s2 WHERE size > 16384)::BIGINT AS hashed, 0::BIGINT AS errors, ((SELECT coalesce(sum(least(size, 16384)), 0) FROM s1) + (SELECT coalesce(sum(size), 0) FROM s2 WHERE size > 16384))::BIGINT AS read_bytes""",
)
def _(spark, d):
    return dup.funnel(views.files(spark, d), views.content(spark, d))


#: A cache that knows every third large file, and every fifth with a time that has moved since.
CACHED = """c AS (SELECT *, size > 16384 AND idx % 3 = 0 AND idx % 5 <> 0 AS known FROM s2)"""


@register(
    "dup_cached_funnel",
    f"""WITH {FILES}, {HASHED.format(source="files")}, s1 AS (SELECT * FROM named WHERE size >= 1 AND size IN (SELECT size FROM files WHERE size >= 1 GROUP BY size HAVING count(*) >= 2)),
s2 AS (SELECT * FROM s1 WHERE (size, q) IN (SELECT size, q FROM s1 GROUP BY size, q HAVING count(*) >= 2)), s3 AS (SELECT size, hash, count(*) AS n FROM s2 GROUP BY size, hash HAVING count(*) >= 2), {CACHED}
SELECT (SELECT count(*) FROM s1)::BIGINT AS stage1, (SELECT count(*) FROM s2)::BIGINT AS stage2, (SELECT coalesce(sum(n), 0) FROM s3)::BIGINT AS stage3, (SELECT count(*) FROM s3)::BIGINT AS groups,
(SELECT count(*) FROM c WHERE size > 16384 AND NOT known)::BIGINT AS hashed, 0::BIGINT AS errors,
((SELECT coalesce(sum(least(size, 16384)), 0) FROM s1) + (SELECT coalesce(sum(size), 0) FROM c WHERE size > 16384 AND NOT known))::BIGINT AS read_bytes""",
)
def _(spark, d):
    f, c = views.files(spark, d), views.content(spark, d)
    kept = f.join(c, "idx").filter("idx % 3 = 0 or idx % 5 = 0")
    mtime = F.when(F.col("idx") % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime"))
    cache = kept.select(fn.normalize_key(F.col("path")).alias("key"), "size", mtime.alias("mtime"), F.sha2(F.col("content"), 256).alias("full"))
    return dup.funnel(f, c, cache=cache)


PLAN = f"""WITH {FILES}, {usage_sql()}, {groups_sql()}, m AS (
  SELECT group_no, f.path, f.size, f.mtime, coalesce(u.count, 0)::BIGINT AS uses FROM (SELECT group_no, unnest(members) AS idx FROM groups) JOIN files f USING (idx) LEFT JOIN usage u ON u.key = f.path
), r AS (
  SELECT *, row_number() OVER w AS place, lead(uses) OVER w AS nu, lead(mtime) OVER w AS nm FROM m WINDOW w AS (PARTITION BY group_no ORDER BY uses DESC, mtime DESC, length(path), path)
), named2 AS (SELECT *, CASE WHEN uses > 0 THEN '사용 ' || uses || '회' ELSE '사용 기록 없음' END AS said FROM r)
SELECT group_no, CASE WHEN place = 1 THEN '남김' ELSE '정리' END AS action, path, size, uses,
  CASE WHEN place > 1 THEN said WHEN uses > coalesce(nu, 0) THEN said || ' — 가장 많이 열었다' WHEN mtime > coalesce(nm, 0) THEN '가장 최근에 수정했다' ELSE '경로가 가장 짧다' END AS why FROM named2"""


@register("keeper_plan", PLAN)
def _(spark, d):
    rows = found(spark, d)
    return dup.keepers(dup.members(rows, dup.groups(rows)), state(spark, d))


def family_rows(rows: DataFrame) -> DataFrame:
    """Families with their members as text, the form in which the SQL shows them."""
    return rows.groupBy("family", "n").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))


@register("version_family", f"WITH {FILES}, v AS (SELECT path, 'doc_' || idx // 10 || '|' || lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS family FROM files) SELECT family, count(*)::BIGINT AS n, string_agg(path, ',' ORDER BY path) AS paths FROM v GROUP BY family HAVING count(*) >= 2")
def _(spark, d):
    marked = F.regexp_replace("name", "_([0-9]*)([0-9])[.]", "_0$1 ($2)_최종.")
    whole = F.regexp_replace(marked, "_0([0-9])", "_$1")  # a single digit is version n of document 0
    return family_rows(dup.families(views.files(spark, d).withColumn("name", whole)))


MARKED = "'doc_' || doc_id // 10 || ' (' || doc_id % 10 || ')_최종_v2_수정-copy final_진짜최종.' || lang"


@register("version_family_all", f"WITH v AS (SELECT '/' || source || '/doc_' || doc_id || '.' || lang AS path, {MARKED} AS name FROM documents), k AS (SELECT path, lower(regexp_replace(name, '( [(][0-9]+[)]_최종_v2_수정-copy final_진짜최종)?[.][^.]+$', '')) || '|' || lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS family FROM v) SELECT family, count(*)::BIGINT AS n, string_agg(path, ',' ORDER BY path) AS paths FROM k GROUP BY family HAVING count(*) >= 2")
def _(spark, d):
    f = views.files(spark, d)
    no, ext = F.col("idx"), fn.extension(F.col("name"))
    marked = F.concat(F.lit("doc_"), F.floor(no / 10).cast("string"), F.lit(" ("), (no % 10).cast("string"), F.lit(")_최종_v2_수정-copy final_진짜최종."), ext)
    return family_rows(dup.families(f.withColumn("name", marked)))


@register("version_family_members", f"WITH v AS (SELECT '/' || source || '/doc_' || doc_id || '.' || lang AS path, doc_id AS idx, 'doc_' || doc_id // 10 || '|' || lang AS family FROM documents) SELECT family, (count(*) OVER (PARTITION BY family))::BIGINT AS n, path, idx FROM v QUALIFY count(*) OVER (PARTITION BY family) >= 2")
def _(spark, d):
    f = views.files(spark, d)
    marked = F.concat(F.lit("doc_"), F.floor(F.col("idx") / 10).cast("string"), F.lit("_v"), (F.col("idx") % 10 + 2).cast("string"), F.lit("_최종."), fn.extension(F.col("name")))
    return dup.families(f.withColumn("name", marked)).select("family", "n", "path", "idx")


ACTIONS = "CASE event_type WHEN 'error' THEN 'list' WHEN 'view' THEN 'open' WHEN 'click' THEN 'copy' ELSE 'download' END"


@register("usage_from_actions", f"""WITH {FILES}, {usage_sql().replace("LEFT JOIN files f ON user_id = f.idx", "LEFT JOIN files f ON user_id = f.idx WHERE event_type <> 'error'")} SELECT key, round(score, 6) AS score, count, last FROM usage""")
def _(spark, d):
    kinds = views.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.expr(ACTIONS).alias("action"))
    actions = views.usage_log(spark, d).join(kinds, "seq")
    return usage.fold(usage.log_of(actions)).select("key", F.round("score", 6).alias("score"), "count", "last")


@register("frecency_score", f"WITH {FILES}, {usage_sql()} SELECT key, path, round(score, 6) AS score, count, last FROM usage")
def _(spark, d):
    return state(spark, d).select("key", "path", F.round("score", 6).alias("score"), "count", "last")


LATE = "(event_id % 7) * 1000000000000 + event_id"


@register("frecency_late", f"WITH {FILES}, {usage_sql(LATE)} SELECT key, path, round(score, 6) AS score, count, last FROM usage")
def _(spark, d):
    return state(spark, d, late=True).select("key", "path", F.round("score", 6).alias("score"), "count", "last")


@register("frecency_top", f"WITH {FILES}, {usage_sql()} SELECT path, round({decay('score', f'{NOW} - last')}, 6) AS score, count, last FROM usage ORDER BY {decay('score', f'{NOW} - last')} DESC, path LIMIT 20")
def _(spark, d):
    return usage.top(state(spark, d), 20, NOW).select("path", F.round("score", 6).alias("score"), "count", "last")


@register("frecency_pruned_save", f"WITH {FILES}, {usage_sql(half_life=1.0)} SELECT key, round(score, 6) AS score, count, last FROM usage WHERE {decay('score', f'{NOW} - last', 1.0)} >= 0.001")
def _(spark, d):
    return usage.saved(state(spark, d, half_life=1.0), NOW, 1.0).select("key", F.round("score", 6).alias("score"), "count", "last")


@register("usage_prune_semi", f"WITH {FILES}, {usage_sql()} SELECT key, count FROM usage WHERE key IN (SELECT path FROM files)")
def _(spark, d):
    return usage.indexed(state(spark, d), views.files(spark, d)).select("key", "count")


@register("usage_prune_anti", f"WITH {FILES}, {usage_sql()} SELECT key, count FROM usage WHERE key NOT IN (SELECT path FROM files)")
def _(spark, d):
    return usage.vanished(state(spark, d), views.files(spark, d)).select("key", "count")


@register("reconfigure_half_life", f"WITH {FILES}, {usage_sql()} SELECT key, least(count, 1000)::DOUBLE AS score, least(count, 1000)::BIGINT AS count, last FROM usage WHERE {decay('least(count, 1000)::DOUBLE', f'{NOW} - last', 2.0)} >= 0.001")
def _(spark, d):
    return usage.reconfigure(state(spark, d), NOW, 2.0).select("key", "score", "count", "last")


NODES = r"""nodes AS (
  SELECT (1::BIGINT << 57) | n_nationkey AS file_id, (1::BIGINT << 56) | n_regionkey AS parent_id, n_name AS name FROM nation
  UNION ALL SELECT (3::BIGINT << 56) | c_custkey, (1::BIGINT << 57) | c_nationkey, c_name FROM customer
  UNION ALL SELECT (1::BIGINT << 58) | s_suppkey, (1::BIGINT << 57) | (CASE WHEN s_suppkey % 7 = 0 THEN 999 ELSE s_nationkey END), s_name FROM supplier
), tops AS (SELECT (1::BIGINT << 56) | r_regionkey AS file_id, '/' || r_name AS path FROM region
), placed(file_id, path, depth) AS (
  SELECT file_id, path, 0 FROM tops UNION ALL SELECT n.file_id, p.path || '/' || n.name, p.depth + 1 FROM nodes n JOIN placed p ON n.parent_id = p.file_id)"""


@register("tree_paths", f"WITH RECURSIVE {NODES} SELECT file_id, path, depth::INT AS depth FROM placed WHERE depth > 0")
def _(spark, d):
    return tree.resolve(views.nodes(spark, d), views.roots(spark, d)).select("file_id", "path", "depth")


@register("tree_paths_recursive", f"WITH RECURSIVE {NODES} SELECT file_id, path, depth::INT AS depth FROM placed")
def _(spark, d):
    tops = views.roots(spark, d)
    placed = tree.resolve(views.nodes(spark, d), tops).select("file_id", "path", "depth")
    return placed.unionByName(tops.select("file_id", "path", F.lit(0).alias("depth")))


@register("tree_orphans", f"WITH RECURSIVE {NODES} SELECT file_id FROM nodes WHERE file_id NOT IN (SELECT file_id FROM placed)")
def _(spark, d):
    raw, tops = views.nodes(spark, d), views.roots(spark, d)
    return tree.orphans(raw, tree.resolve(raw, tops), tops)


SIZED = r"""sized AS (
  SELECT file_id, path, depth, split_part(path, '/', -1) AS name, depth = 1 AS is_dir,
    CASE WHEN depth > 1 THEN (file_id & 4294967295) * 37 % 5000 END AS size FROM placed WHERE depth > 0)"""


@register("search_unresolved", rf"""WITH RECURSIVE {NODES}, {SIZED} SELECT file_id, path, size FROM sized
  WHERE contains({FOLD.format('name')}, '#0000') AND size > 2048 AND NOT {FOLD.format('name')} LIKE '%7' AND contains({FOLD.format('path')}, '/asia/')
  ORDER BY path, file_id LIMIT 40""")
def _(spark, d):
    found = node_search.search_nodes(views.sized_nodes(spark, d), views.roots(spark, d), "#0000 size:>2kb !*7 path:/asia/", state(spark, d).limit(0), limit=40, now=NOW)
    return found.select("file_id", "path", "size")


@register("search_unresolved_folders", rf"WITH RECURSIVE {NODES}, {SIZED} SELECT file_id, path FROM sized WHERE is_dir AND contains({FOLD.format('name')}, 'n_1') ORDER BY {FOLD.format('name')}, file_id")
def _(spark, d):
    found = node_search.search_nodes(views.sized_nodes(spark, d), views.roots(spark, d), "folder: n_1", state(spark, d).limit(0), sort="name", limit=0, now=NOW)
    return found.select("file_id", "path")


@register("orphan_reasons", r"""WITH RECURSIVE nodes AS (
  SELECT (1::BIGINT << 57) | n_nationkey AS file_id, (1::BIGINT << 56) | n_regionkey AS parent_id FROM nation
  UNION ALL SELECT (3::BIGINT << 56) | c_custkey, (1::BIGINT << 57) | c_nationkey FROM customer
  UNION ALL SELECT (1::BIGINT << 58) | s_suppkey, (1::BIGINT << 57) | (CASE WHEN s_suppkey % 7 = 0 THEN 999 ELSE s_nationkey END) FROM supplier
  UNION ALL SELECT (5::BIGINT << 56) | p_partkey, CASE WHEN p_partkey % 10 < 9 THEN (5::BIGINT << 56) | (p_partkey + 1) WHEN p_partkey // 10 % 3 = 0 THEN (5::BIGINT << 56) | (p_partkey // 10 * 10)
    WHEN p_partkey // 10 % 3 = 1 THEN (6::BIGINT << 56) | p_partkey ELSE (1::BIGINT << 57) | (p_partkey // 10 % 25) END FROM part
), tops AS (SELECT (1::BIGINT << 56) | r_regionkey AS file_id FROM region
), ups(file_id, up, length) AS (
  SELECT file_id, parent_id, 1 FROM nodes UNION ALL SELECT u.file_id, n.parent_id, u.length + 1 FROM ups u JOIN nodes n ON n.file_id = u.up WHERE u.length < 40
), ends AS (
  SELECT u.file_id, u.up, u.length, t.file_id IS NOT NULL AS root, n.file_id IS NULL AND t.file_id IS NULL AS missing
  FROM ups u LEFT JOIN tops t ON t.file_id = u.up LEFT JOIN nodes n ON n.file_id = u.up
)
SELECT file_id, CASE WHEN bool_or(missing) THEN 'missing' WHEN bool_or(root) THEN 'deep' ELSE 'cycle' END AS reason,
  CAST(max(length) FILTER (missing OR root) AS BIGINT) AS length, max(up) FILTER (missing) AS missing
FROM ends GROUP BY file_id HAVING NOT bool_or(root) OR max(length) FILTER (root) > 8""")
def _(spark, d):
    return tree.orphan_reasons(views.broken_nodes(spark, d), views.roots(spark, d), deepest=8)


@register("volumes_union", "SELECT ((1::BIGINT << 56) | n_nationkey) AS file_id, n_name AS name FROM nation UNION ALL SELECT ((1::BIGINT << 57) | r_regionkey), r_name FROM region")
def _(spark, d):
    n = views.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("file_id"), F.lit(0).cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    r = views.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("file_id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    return tree.volumes([n, r]).select("file_id", "name")


@register("hydrate_join", f"WITH {FILES} SELECT idx, path, CASE WHEN idx % 3 <> 0 THEN size ELSE -1 END AS size, CASE WHEN idx % 3 <> 0 THEN mtime ELSE 0 END AS mtime FROM files")
def _(spark, d):
    f = views.files(spark, d)
    bare = f.withColumns({"size": F.lit(None).cast("long"), "mtime": F.lit(0).cast("long")})
    listing = f.filter("idx % 3 != 0").select("parent", F.upper("name").alias("name"), "size", "mtime")
    return tree.hydrate(bare, listing).select("idx", "path", F.coalesce("size", F.lit(-1)).cast("long").alias("size"), "mtime")


@register("exclude_subtree", f"WITH {FILES}, {TREE} SELECT path FROM tree WHERE parent IS NULL OR NOT (path = '/src1' OR path LIKE '/src1/%' OR {FOLD.format('name')} LIKE '%.de' OR contains(path, '/src2/doc_1'))")
def _(spark, d):
    return tree.exclude(views.tree(spark, d), ["src1", "*.DE", "/src2/doc_1"]).select("path")


@register("exclude_skipped", f"WITH {FILES}, {TREE} SELECT path FROM tree WHERE parent IS NOT NULL AND (path = '/src1' OR ({FOLD.format('name')} LIKE '%.de' AND path NOT LIKE '/src1/%'))")
def _(spark, d):
    return tree.skipped(views.tree(spark, d), ["SRC1", "*.de"]).select("path")


@register("index_stats_stores", rf"""WITH {FILES}, {TREE}, {usage_sql()} SELECT count(*)::BIGINT AS entries, (count(*) FILTER (NOT is_dir))::BIGINT AS files, sum(strlen(name))::BIGINT AS name_bytes,
  (36 * count(*))::BIGINT AS record_bytes, (SELECT count(*) FROM usage)::BIGINT AS usage_paths, (SELECT count(*) FROM files WHERE size > 16384)::BIGINT AS cached_hashes FROM tree""")
def _(spark, d):
    known = views.files(spark, d).filter("size > 16384").select(F.col("path").alias("key"), "size", "mtime", F.lit("").alias("full"))
    return tree.stats(views.tree(spark, d), state(spark, d), known)


@register("index_stats", f"WITH {FILES}, {TREE} SELECT count(*)::BIGINT AS entries, (count(*) FILTER (NOT is_dir))::BIGINT AS files, sum(strlen(name))::BIGINT AS name_bytes, (36 * count(*))::BIGINT AS record_bytes FROM tree")
def _(spark, d):
    return tree.stats(views.tree(spark, d))




def cube_rest(k: Column) -> Column:
    """The cube of a whole number modulo 2^42, with the number's sign; no product leaves 63 bits, as the cube would from
    2,097,152 on."""
    part, rest = F.lit(1 << 21), F.lit(1 << 42)
    own = F.abs(k.cast("long") % rest)

    def times(a: Column, b: Column) -> Column:
        high, low = F.floor(a / part), a % part  # exact: below 2^53
        return ((high * (b % part)) % part * part + (low * b) % rest) % rest

    return F.when(k < 0, -times(times(own, own), own)).otherwise(times(times(own, own), own))


@register("fmt_human", f"WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * o_orderkey * o_orderkey) % (1::BIGINT << 42) END AS b FROM orders) SELECT o_orderkey, {HUMAN} AS human FROM s")
def _(spark, d):
    k = F.col("o_orderkey")
    size = F.when(k % 11 == 0, F.lit(None)).otherwise(cube_rest(k))
    return views.table(spark, d, "orders").select("o_orderkey", fn.human(size.cast("long")).alias("human"))


@register("fmt_ago", f"WITH s AS (SELECT event_id, greatest({NOW} - floor(epoch(ts))::BIGINT * 1 - (event_id % 5) * 500000, 0) AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN '방금' WHEN s < 3600 THEN (s // 60) || '분 전' WHEN s < 86400 THEN (s // 3600) || '시간 전' WHEN s < 2592000 THEN (s // 86400) || '일 전' ELSE (s // 2592000) || '개월 전' END AS ago FROM s")
def _(spark, d):
    seconds = F.lit(NOW) - F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")) - (F.col("event_id") % 5) * 500000
    return views.table(spark, d, "events").select("event_id", fn.ago(seconds).alias("ago"))


@register("fmt_ext", "WITH n AS (SELECT page_id, regexp_extract(regexp_extract(url, '^[^:]*://([^?#]*)', 1), '([^/]*)$', 1) AS name FROM pages) SELECT page_id, nullif(regexp_extract(name, '^.+\\.([^.]+)$', 1), '') AS ext FROM n")
def _(spark, d):
    return views.urls(spark, d).select(F.col("idx").alias("page_id"), "ext")


@register("norm_key", "SELECT p_partkey, lower(replace('C:\\' || p_brand || '\\' || p_name, '\\', '/')) AS key FROM part")
def _(spark, d):
    path = F.concat(F.lit("C:\\"), F.col("p_brand"), F.lit("\\"), F.col("p_name"))
    return views.table(spark, d, "part").select("p_partkey", fn.normalize_key(path, fold_case=True).alias("key"))


@register("hash_cache_hits", f"WITH {FILES} SELECT idx, CASE WHEN idx % 2 = 0 THEN sha256(encode(text)) END AS cached FROM files")
def _(spark, d):
    f = views.files(spark, d)
    body = f.join(views.content(spark, d), "idx")
    cache = body.filter("idx % 4 != 1").select(F.col("path").alias("key"), "size", F.when(F.col("idx") % 4 == 3, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), F.sha2(F.col("content"), 256).alias("full"))
    return dup.with_cache(f, cache, fn.normalize_key(F.col("path"))).select("idx", "cached")


TURNS = r"""turns AS (SELECT conv_id, turn, (turn + 1) || '. ' || regexp_replace(text, '\s+', ' ', 'g') AS line FROM conversations
), p AS (
  SELECT conv_id, conv_id // 2 AS round, count(*) AS n, string_agg(line, chr(10) ORDER BY turn) AS t FROM turns GROUP BY conv_id
), good AS (SELECT *, least(n, 13) AS p1, least(n, 6) AS e FROM p WHERE length('13문제 중 10문제' || chr(10) || t || chr(10) || '6문제 중 4문제' || chr(10) || t) >= 500)"""
ROW = """round::INT AS round, round || '회 (추정)' AS label, '2020' AS year, p1::INT AS p1, e::VARCHAR AS essay_counts, (p1 + e)::INT AS total,
  '⚠ ' || concat_ws(', ', CASE WHEN p1 <> 13 THEN '1교시 ' || p1 || '문항' END, '논술형 1개 교시', CASE WHEN e <> 6 THEN '2교시 ' || e || '문항' END) AS status"""


@register("papers_summary", f"WITH {TURNS} SELECT {ROW} FROM good")
def _(spark, d):
    return papers.summary(papers.structured(views.papers(spark, d)))


@register("papers_totals", f"WITH {TURNS} SELECT count(*)::BIGINT AS papers, coalesce(sum(p1 + e), 0)::BIGINT AS items, count(*)::BIGINT AS warned FROM good")
def _(spark, d):
    return papers.totals(papers.summary(papers.structured(views.papers(spark, d))))


@register("paper_last_wins", f"WITH {TURNS} SELECT {ROW} FROM good QUALIFY row_number() OVER (PARTITION BY round ORDER BY '제' || round || '회 (2020년)_' || conv_id || '.pdf' DESC) = 1")
def _(spark, d):
    whole = papers.structured(views.papers(spark, d)).filter("error is null")
    return papers.summary(papers.last_wins(whole, "source"))


@register("question_filter", f"WITH {TURNS}, items AS (SELECT g.conv_id, g.round, least(t.turn + 1, 13) AS no, string_agg(line, ' ' ORDER BY turn) AS blob FROM good g JOIN turns t USING (conv_id) GROUP BY ALL) SELECT round::INT AS round, 1 AS gyosi, no::INT AS no FROM items WHERE contains(lower(blob), 'th')")
def _(spark, d):
    items = papers.questions(papers.structured(views.papers(spark, d)).filter("error is null"))
    return papers.question_filter(items, 1, " TH ").select("round", "gyosi", "no")


@register("fallback_blocks", f"WITH {TURNS} SELECT conv_id, 1::BIGINT AS blocks, least(n, 6)::BIGINT AS items FROM p")
def _(spark, d):
    t = views.numbered(spark, d).withColumn("groups", papers.fallback_groups(F.col("text")))
    return t.select("conv_id", F.size("groups").cast("long").alias("blocks"), F.size(papers.essay_items(F.get("groups", F.lit(0)))).cast("long").alias("items"))


@register("fallback_blocks_many", f"WITH {TURNS} SELECT conv_id, 3::BIGINT AS blocks, 3 * least(n, 6)::BIGINT AS items, '2,3,4' AS periods FROM p")
def _(spark, d):
    """Papers without notices that begin their numbers again four times: the first three are blocks."""
    t = views.numbered(spark, d)
    again = F.concat_ws("\n", F.lit("머리말 1 - 1"), *["text"] * 4)
    blocks = papers.structured(t.select("conv_id", F.concat(again, F.repeat(F.lit(" "), F.lit(500))).alias("text"), F.concat(F.lit("제"), F.col("conv_id").cast("string"), F.lit("회")).alias("source")))
    items = F.aggregate("essay", F.lit(0), lambda n, b: n + F.size(b["items"])).cast("long")
    return blocks.select(F.col("round").cast("long").alias("conv_id"), F.size("essay").cast("long").alias("blocks"), items.alias("items"), F.array_join(F.transform("essay", lambda b: b["gyosi"].cast("string")), ",").alias("periods"))


def subs_text(items: DataFrame) -> DataFrame:
    """Sub-items as one text, which every reader of results compares alike."""
    each = F.transform("subs", lambda x: F.concat(x["k"], F.lit("="), x["v"]))
    return items.withColumn("subs", F.array_join(each, "|"))


WORDS = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
LINE = "(turn + 1) || '. ' || trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@register("parse_short", f"SELECT conv_id, least(turn + 1, 13)::INT AS no, string_agg(CASE WHEN turn < 13 THEN {WORDS} ELSE {LINE} END, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1, 2")
def _(spark, d):
    return views.numbered(spark, d).select("conv_id", F.inline(papers.short_items(F.concat(F.lit("13문제 중 10문제\n"), F.col("text")))))


@register(
    "parse_essay",
    f"""WITH {TURNS} SELECT g.round::INT AS round, 2 AS gyosi, least(c.turn + 1, 6)::INT AS no,
  string_agg(CASE WHEN c.turn < 6 THEN {WORDS} ELSE {LINE} END, ' ' ORDER BY c.turn) AS stem, '' AS subs, NULL::VARCHAR AS spec
FROM good g JOIN conversations c USING (conv_id) GROUP BY g.conv_id, g.round, least(c.turn + 1, 6)""",
)
def _(spark, d):
    return subs_text(papers.questions(papers.structured(views.papers(spark, d)).filter("error is null")).filter("gyosi > 1"))


@register("attach_spec", f"SELECT conv_id, 6 AS no, string_agg(CASE WHEN turn < 6 THEN {WORDS} ELSE {LINE} END, ' ' ORDER BY turn) || ' 아래 명세 를 본다' AS stem, '' AS subs, conv_id::VARCHAR AS spec FROM conversations c WHERE turn >= 5 GROUP BY conv_id UNION ALL SELECT conv_id, max(turn + 1)::INT, arg_max({WORDS}, turn) || ' 아래 명세 를 본다', '', conv_id::VARCHAR FROM conversations GROUP BY conv_id HAVING max(turn) < 5")
def _(spark, d):
    block = F.concat(F.col("text"), F.lit("\n아래 명세 를 본다\n[명세] "), F.col("conv_id").cast("string"))
    items = views.numbered(spark, d).select("conv_id", F.inline(papers.with_spec(block, papers.essay_items(block))))
    return subs_text(items.filter("spec is not null"))


FULL = f"""l AS (SELECT conv_id, list({WORDS} ORDER BY turn) AS l FROM conversations WHERE {WORDS} <> '' GROUP BY conv_id)"""


@register(
    "papers_full_summary",
    f"""WITH {FULL} SELECT conv_id::INT AS round, conv_id || '회' || CASE WHEN conv_id % 2 = 1 THEN ' (추정)' ELSE '' END AS label, CASE WHEN conv_id % 3 > 0 THEN '2021' ELSE '—' END AS year, 13 AS p1,
  CASE WHEN conv_id % 7 > 0 THEN '6 · 6 · 6' ELSE '6 · 6 · 5' END AS essay_counts, CASE WHEN conv_id % 7 > 0 THEN 31 ELSE 30 END AS total, CASE WHEN conv_id % 7 > 0 THEN '정상' ELSE '⚠ 4교시 5문항' END AS status FROM l""",
)
def _(spark, d):
    return papers.summary(papers.structured(views.full_papers(spark, d)))


@register("papers_full_totals", f"WITH {FULL} SELECT count(*)::BIGINT AS papers, coalesce(sum(CASE WHEN conv_id % 7 > 0 THEN 31 ELSE 30 END), 0)::BIGINT AS items, (count(*) FILTER (conv_id % 7 = 0))::BIGINT AS warned FROM l")
def _(spark, d):
    return papers.totals(papers.summary(papers.structured(views.full_papers(spark, d))))


@register(
    "papers_full_items",
    f"""WITH {FULL} SELECT conv_id::INT AS round, 1::INT AS gyosi, no::INT AS no, l[no % len(l) + 1] || CASE WHEN no = 13 THEN ' 40. 번호가 아닌 줄' || CASE WHEN conv_id % 2 = 0 THEN ' 제 2 교시' ELSE '' END ELSE '' END AS stem, '' AS subs, NULL::VARCHAR AS spec
FROM l, range(1, 14) r(no)
UNION ALL SELECT conv_id::INT, p::INT, no::INT, CASE WHEN p = 3 AND no = 4 THEN '아래 명세 참조 ' ELSE '' END || l[(p + no) % len(l) + 1],
  '가=' || l[no % len(l) + 1] || '|나=이어짐 ' || l[p % len(l) + 1] || CASE WHEN conv_id % 2 = 0 AND p = 2 AND no = 6 THEN ' 제 3 교시' ELSE '' END, CASE WHEN p = 3 AND no = 4 THEN l[1] END
FROM l, range(2, 5) q(p), range(1, 7) r(no) WHERE conv_id % 7 > 0 OR p < 4 OR no < 6""",
)
def _(spark, d):
    return subs_text(papers.questions(papers.structured(views.full_papers(spark, d)).filter("error is null")))


@register("usn_decode", "SELECT c_custkey AS file_id, c_nationkey::BIGINT AS parent_id, c_name AS name, false AS is_dir FROM customer UNION ALL SELECT n_nationkey::BIGINT, n_regionkey::BIGINT, n_name, true FROM nation")
def _(spark, d):
    c = views.table(spark, d, "customer").select(usn.encode_column(F.col("c_custkey"), F.col("c_nationkey"), F.col("c_name"), F.lit(False)).alias("content"))
    n = views.table(spark, d, "nation").select(usn.encode_column(F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_name"), F.lit(True)).alias("content"))
    return usn.nodes(usn.decode(c.unionByName(n)))


@register("filetime", "SELECT o_orderkey, (floor(epoch(o_orderdate)))::BIGINT AS seconds FROM orders")
def _(spark, d):
    ft = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 10000000 + F.lit(116444736000000000)
    return views.table(spark, d, "orders").select("o_orderkey", fn.filetime_seconds(ft).alias("seconds"))


@register("cleanup_plan", PLAN.replace("SELECT group_no, CASE", "SELECT CASE").replace(" path, size, uses,", " path, size, group_no,"))
def _(spark, d):
    rows = found(spark, d)
    return dup.keepers(dup.members(rows, dup.groups(rows)), state(spark, d)).select("action", "path", "size", "group_no", "why")
