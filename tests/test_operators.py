import json
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrykit import workspace
from quarrykit.operators import dup, folder_search, hashing, node_search, numbering, papers, report, search, tree, usage
from quarrykit.plans.query import parse
from quarrykit.sources import listing, store, usn, versions, volumes

DAY = 86400
FILES = "idx long, parent string, name string, is_dir boolean, size long, mtime long, file_id long, path string"


# ---- usage


def fold(spark, rows, h=30.0):
    log = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "seq long, path string, ts long")
    return {r.key: r for r in usage.fold(log, h).collect()}


def sequential(rows, h):
    state = {}
    for path, ts in rows:
        score, count, last = state.get(path, (0.0, 0, None))
        if last is not None and ts > last:
            score *= 0.5 ** ((ts - last) / (h * DAY))
        state[path] = (score + 1, count + 1, ts if last is None else max(last, ts))
    return state


def test_usage_equals_one_use_after_the_other(spark):
    g = random.Random(1)
    rows = [(f"/f{g.randrange(4)}", g.randrange(100 * DAY)) for _ in range(300)]
    log = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "seq long, path string, ts long")
    got, want = {r.key: r for r in usage.fold(log, 7.0, chunk=16).collect()}, sequential(rows, 7.0)
    for k, (s, n, last) in want.items():
        assert got[k].score == pytest.approx(s, rel=1e-9) and (got[k]["count"], got[k]["last"]) == (n, last)
    assert fold(spark, [("D:\\\\x\\y.c".replace("\\\\", "\\"), 5), ("D:/x/y.c", 9)])["D:/x/y.c"]["count"] == 2


def test_usage_state_operations(spark):
    log = [("/often", 40 * DAY)] * 3 + [("/long ago", 2 * DAY)] * 5
    state = usage.fold(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(log)], "seq long, path string, ts long"), 5.0)
    assert [r.path for r in usage.top(state, 0, 40 * DAY).collect()][0] == "/often"
    files = spark.createDataFrame([("/often",)], "path string")
    assert [r.key for r in usage.indexed(state, files).collect()] == ["/often"] and [r.key for r in usage.vanished(state, files).collect()] == ["/long ago"]
    assert [r.key for r in usage.saved(state, 70 * DAY, 5.0).collect()] == ["/often"]
    assert {(r.key, r.score) for r in usage.reconfigure(state, 40 * DAY, 300.0).collect()} == {("/often", 3.0), ("/long ago", 5.0)}


# ---- duplicates


def noise(seed, n):
    return random.Random(seed).randbytes(n)


def store_of(spark, blobs, mtime=77, file_id=None):
    """Files a, b, ... with these contents; None cannot be read and claims 9 bytes."""
    rows = [(k, "/d", chr(97 + k), False, 9 if b is None else len(b), mtime, k + 1 if file_id is None else file_id[k], f"/d/{chr(97 + k)}") for k, b in enumerate(blobs)]
    content = [(k, bytearray(b)) for k, b in enumerate(blobs) if b is not None]
    return spark.createDataFrame(rows, FILES), spark.createDataFrame(content, "idx long, content binary")


def brute_groups(blobs, least=1):
    sets = {}
    for k, b in enumerate(blobs):
        if b is not None and len(b) >= least:
            sets.setdefault(b, set()).add(k)
    return {frozenset(s) for s in sets.values() if len(s) > 1}


def grouped(found, **options):
    out = {}
    for r in dup.members(found, dup.groups(found, **options)).collect():
        out.setdefault(r.group_no, set()).add(r.idx)
    return {frozenset(s) for s in out.values()}


def test_duplicates_equal_brute_force(spark):
    g = random.Random(8)
    long = noise(1, 60_000)
    kinds = [b"", b"q", noise(2, 9), noise(3, dup.PREFIX), noise(4, dup.PREFIX + 1), long, long[:-1] + b"!", b"?" + long[1:], None]
    blobs = [g.choice(kinds) for _ in range(24)]
    files, content = store_of(spark, blobs)
    for least in (0, 1, 100):
        assert grouped(dup.matched(files, content, min_size=least)) == brute_groups(blobs, least)
    found = dup.matched(files, content)
    of = dup.groups(found).collect()
    assert [r.group_no for r in sorted(of, key=lambda r: (-r.wasted, -r.size, r.hash))] == list(range(1, len(of) + 1))
    assert all(r.wasted == r.size * (r.n - 1) for r in of)
    assert {r.idx for r in dup.twins(found).collect()} == set().union(*brute_groups(blobs))
    assert [r.path for r in report.dup_errors(dup_quick(files, content)).collect()] == [f"/d/{chr(97 + k)}" for k, b in enumerate(blobs) if b is None][:5]


def dup_quick(files, content):
    return dup.with_quick(dup.same_size(files), content)


def test_names_of_one_file_count_once(spark):
    body = noise(6, 20_000)
    files, content = store_of(spark, [body] * 5, file_id=[8, 8, 8, 8, 8])
    found = dup.matched(files, content)
    assert not grouped(found) and not dup.twins(found).count()
    only = dup.groups(found, include_hardlinks=True).first()
    assert (only.n, only.physical, only.all_hardlinked, only.wasted) == (5, 1, True, 0)
    files, content = store_of(spark, [body] * 5, file_id=[8, 8, 3, 0, 0])  # 0: unknown, each its own
    found = dup.matched(files, content)
    assert dup.groups(found).first().wasted == 3 * len(body) and dup.twins(found).count() == 5


def test_cache_spares_whole_hashes(spark):
    twin, other = noise(10, 30_000), noise(11, 30_000)
    files, content = store_of(spark, [twin, twin, twin[:-1] + b"~", other, b"few", b"few"])
    counts = lambda cache, f=files: (lambda r: (r.stage2, r.stage3, r.groups, r.hashed, r.read_bytes))(dup.funnel(f, content, cache=cache).first())
    cold = spark.createDataFrame([], store.CACHE)
    assert counts(None) == counts(cold) == (5, 4, 2, 3, 4 * dup.PREFIX + 6 + 3 * 30_000)
    warm = store.merged_cache(cold, dup.learned(dup.with_full(dup.same_prefix(dup_quick(files, content)), content, cold)))
    assert warm.count() == 3 and counts(warm) == (5, 4, 2, 0, 4 * dup.PREFIX + 6)
    moved = files.withColumn("mtime", F.when(F.col("idx") == 1, 78).otherwise(F.col("mtime")))
    assert counts(warm, moved)[3] == 1
    unknown = files.withColumn("mtime", F.lit(0).cast("long"))
    assert counts(warm, unknown)[3] == 3
    assert dup.learned(dup.with_full(dup.same_prefix(dup_quick(unknown, content)), content)).count() == 0


def test_no_content_passes_an_exchange(spark, tmp_path):
    body = noise(12, 20_000)
    files, content = store_of(spark, [body, body, noise(13, 20_000)])
    content.write.parquet(str(tmp_path / "c"))
    contents = hashing.TableContents(spark.read.parquet(str(tmp_path / "c")))
    for rows in (files.join(contents.quick(files), "idx"), files.join(contents.whole(files.filter("idx < 2")), "idx")):
        assert rows.filter("hash is not null").count() >= 2
        plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
        moved = re.findall(r"\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", plan)
        assert moved and not any("content" in m for m in moved), moved


def on_disk(spark, folder, blobs):
    """Files of these contents; None is a name without a file. (idx, ..., path) with the sizes that they claim."""
    rows = []
    for k, b in enumerate(blobs):
        at = folder / f"f{k:03d}"
        if b is not None:
            at.write_bytes(b)
        rows.append((k, str(folder), at.name, False, 9 if b is None else len(b), 77, k + 1, str(at)))
    return spark.createDataFrame(rows, FILES)


def test_files_hashed_by_path_equal_a_table(spark, tmp_path):
    g = random.Random(18)
    long = noise(1, 300_000)
    kinds = [b"", b"q", noise(2, 9), noise(3, dup.PREFIX), noise(4, dup.PREFIX + 1), long, long[:-1] + b"!", b"?" + long[1:], None]
    blobs = [g.choice(kinds) for _ in range(40)]
    files, by_path = on_disk(spark, tmp_path, blobs), hashing.PathContents(task_bytes=1 << 20)
    _, table = store_of(spark, blobs)
    for least in (0, 1, 100):
        assert grouped(dup.matched(files, by_path, min_size=least)) == brute_groups(blobs, least)
    assert dup.funnel(files, by_path).first() == dup.funnel(files, table).first()
    assert {r.hash for r in dup.groups(dup.matched(files, by_path)).collect()} == {r.hash for r in dup.groups(dup.matched(files, table)).collect()}
    quick = dup.with_quick(dup.same_size(files), by_path)
    failed = dup.errors(quick, dup.with_full(dup.same_prefix(quick), by_path)).collect()
    gone = {f"{tmp_path}/f{k:03d}" for k, b in enumerate(blobs) if b is None}
    assert {r.path for r in failed} == gone and all("No such file" in r.error for r in failed)
    assert {r.path for r in search.search(files, "dup:", spark.createDataFrame([], store.USAGE), by_path, limit=0).collect()} == {f"{tmp_path}/f{k:03d}" for g_ in brute_groups(blobs) for k in g_}


def test_huge_sparse_files_are_duplicates(spark, tmp_path):
    """Beyond what a row can hold: two of 3 GiB are equal, a third differs in its last byte, one cannot be read."""
    size, rows = 3 << 30, []
    for k, end in enumerate(b"aab"):
        with open(tmp_path / f"s{k}", "wb") as f:
            f.truncate(size - 1)
            f.seek(size - 1)
            f.write(bytes([end]))
    os.mkfifo(tmp_path / "s3")  # opening it must not wait
    for k in range(5):
        rows.append((k, str(tmp_path), f"s{k}", False, size, 77, k + 1, str(tmp_path / f"s{k}")))
    files, by_path = spark.createDataFrame(rows, FILES), hashing.PathContents()
    report_ = dup.funnel(files, by_path).first()
    assert (report_.stage1, report_.stage2, report_.stage3, report_.groups, report_.hashed, report_.errors) == (5, 3, 2, 1, 3, 2)
    assert report_.read_bytes == 3 * dup.PREFIX + 3 * size
    assert grouped(dup.matched(files, by_path)) == {frozenset({0, 1})}


def test_a_file_that_goes_away_between_the_stages(spark, tmp_path):
    files = on_disk(spark, tmp_path, [b"x" * 20_000] * 3)
    quick = dup.with_quick(dup.same_size(files), hashing.PathContents())
    os.unlink(tmp_path / "f001")
    second = dup.with_full(dup.same_prefix(quick), hashing.PathContents())
    assert [r.path for r in dup.errors(quick, second).collect()] == [f"{tmp_path}/f001"]
    assert second.filter("hash is not null").count() == 2


def test_hashing_tasks_have_about_as_much_to_read(spark):
    sizes = [10**6] * 5 + [1000] * 400 + [7, 0, 3 * 10**6, 10**5]
    rows = spark.createDataFrame([(k, f"/x/{k}", n) for k, n in enumerate(sizes)], "idx long, path string, size long")
    dealt = hashing.PathContents(task_bytes=10**6).dealt(rows, True).groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size").alias("n"), F.count("*").alias("files")).collect()
    assert sum(r.files for r in dealt) == len(sizes) and len(dealt) == 9
    loads = sorted(r.n for r in dealt)
    assert loads[-1] <= 3 * 10**6 + 10**5 and loads[-2] <= 10**6 + 2 * 10**5  # one file cannot be split, all else is even
    assert hashing.PathContents().dealt(rows.limit(0), True).count() == 0


def test_keepers(spark):
    body = noise(14, 3_000)
    rows = [(k, "/p", n, False, 3_000, t, k + 1, n) for k, (n, t) in enumerate([("/p/used", 10), ("/p/newest", 90), ("/p/newer", 80)])]
    files, content = spark.createDataFrame(rows, FILES), spark.createDataFrame([(k, bytearray(body)) for k in range(3)], "idx long, content binary")
    state = usage.fold(spark.createDataFrame([(1, "/p/used", 0), (2, "/p/used", 0)], "seq long, path string, ts long"))
    none = spark.createDataFrame([], store.USAGE)

    def plan(files, state):
        found = dup.matched(files, content)
        return {r.path: (r.action, r.why) for r in dup.keepers(dup.members(found, dup.groups(found)), state).collect()}

    assert plan(files, state) == {"/p/used": ("남김", "사용 2회 — 가장 많이 열었다"), "/p/newest": ("정리", "사용 기록 없음"), "/p/newer": ("정리", "사용 기록 없음")}
    assert plan(files, none)["/p/newest"] == ("남김", "가장 최근에 수정했다")
    assert plan(files.withColumn("mtime", F.lit(5).cast("long")), none)["/p/used"] == ("남김", "경로가 가장 짧다")


# ---- stores and reports


def test_cleanup_plan_is_csv_for_spreadsheets(spark, tmp_path):
    plan = spark.createDataFrame([(2, "정리", '/x/"q", r', 5, "사용 3회"), (1, "정리", "/b", 7, "-"), (1, "남김", "/z", 7, "경로가 가장 짧다")], "group_no int, action string, path string, size long, why string")
    store.write_cleanup_plan(plan, str(tmp_path / "plan"))
    parts = [p.read_bytes().decode() for p in sorted((tmp_path / "plan").glob("*.csv"))]
    lines = [line for p in parts for line in p.split("\r\n") if line]
    heads = [line for line in lines if line.startswith("\ufeff")]
    assert set(heads) == {"\ufeff조치,경로,크기(바이트),묶음,근거"} and len(heads) == len(parts)
    assert [x for x in lines if x not in heads] == ["남김,/z,7,1,경로가 가장 짧다", "정리,/b,7,1,-", '정리,"/x/""q"", r",5,2,사용 3회']


def test_stores_that_are_missing_or_broken_are_empty(spark, tmp_path):
    assert store.read_usage(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no table at all")
    assert store.read_usage(spark, str(tmp_path / "broken")).count() == 0 == store.read_cache(spark, str(tmp_path / "broken")).count()
    at = str(tmp_path / "cache")
    old = spark.createDataFrame([("/a", 1, 1, "x"), ("/b", 1, 1, "y")], store.CACHE)
    store.write_cache(spark.createDataFrame([], store.CACHE), old, at)
    store.write_cache(store.read_cache(spark, at), spark.createDataFrame([("/a", 2, 2, "z")], store.CACHE), at)
    assert {(r.key, r.full) for r in store.read_cache(spark, at).collect()} == {("/a", "z"), ("/b", "y")}


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "/", True, None, 0, 0, "/"), (2, "/", "a", False, 3, 0, 0, "/a")], FILES)
    store.write_index(rows, str(tmp_path / "i"))
    assert store.read_index(spark, str(tmp_path / "i")).count() == 2
    store.write_index(rows.filter("idx = 2"), str(tmp_path / "i"))
    with pytest.raises(ValueError):
        store.read_index(spark, str(tmp_path / "i"))


# ---- search


def test_search(spark):
    def entry(k, folder, name, size, mtime):
        return (k, folder, name, size is None, size, mtime, k, f"{folder}/{name}".replace("//", "/") if folder else name)

    files = spark.createDataFrame([entry(0, None, "/", None, 0), entry(1, "/", "maps", None, 1), entry(2, "/maps", "Coast.svg", 2_000, 9), entry(3, "/maps", "alps.svg", 70, 30), entry(4, "/", "길.txt", 70, 20)], FILES)
    none = spark.createDataFrame([], store.USAGE)
    names = lambda q, **o: [r.name for r in search.search(files, q, none, **o).collect()]
    assert search.hits(files, "", none).count() == 4  # the root is no match
    assert names("", sort="size") == ["maps", "Coast.svg", "alps.svg", "길.txt"]
    assert names("file:", sort="date", limit=2) == ["alps.svg", "길.txt"]
    assert names("", sort="name") == ["alps.svg", "Coast.svg", "maps", "길.txt"]
    state = usage.fold(spark.createDataFrame([(1, "/maps/Coast.svg", 0)] * 3, "seq long, path string, ts long"))
    assert [(r.name, r["count"]) for r in search.search(files, "*.svg", state).collect()] == [("Coast.svg", 3), ("alps.svg", 0)]
    assert [r.line for r in search.rendered(search.results(search.hits(files, "svg", state), limit=0)).collect()] == ["   1.    3회   3.00     2.0 KB  /maps/Coast.svg", "   2.    -        -       70 B  /maps/alps.svg"]
    found = search.hits(files, "", none)
    assert [r.line for r in search.footer(found, 3).collect()] == ["... 전체 4 건 중 3 건"] and not search.footer(found, 4).count() and not search.footer(found, 0).count()
    assert search.dup_candidates(files, "dup:", none).count() == 0 and search.dup_candidates(files, "", none).count() == 3
    with pytest.raises(ValueError):
        search.order_by("length")
    with pytest.raises(ValueError):
        search.hits(files, "dup:", none)


def test_usage_joins_what_size_leaves(spark):
    files = spark.createDataFrame([], FILES)
    plan = search.hits(files, "rc:>1 size:>5", spark.createDataFrame([], store.USAGE))._jdf.queryExecution().analyzed().toString()
    assert plan.index("count") < plan.index("LeftOuter") < plan.rindex("size#")  # the size test is below the join


def test_numbers_need_no_checkpoint_folder_to_be_right(spark):
    rows = spark.range(5_000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = [(r.k, r.no) for r in numbering.numbered(rows, [F.asc("k")], "no").collect()]
    assert sorted(n for _, n in got) == list(range(1, 5_001)) and [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted(k for k, _ in got)


# ---- trees


def test_tree_equals_walking_up(spark):
    g = random.Random(6)
    parent = {k: g.choice([1, 2, *range(3, k)]) if g.random() < 0.95 else 10_000 + k for k in range(3, 300)}
    parent |= {400: 401, 401: 402, 402: 400, 403: 402, 404: 404}
    raw = spark.createDataFrame([(k, p, f"n{k}", k % 3 == 0) for k, p in parent.items()], "file_id long, parent_id long, name string, is_dir boolean")
    tops = {1: "E:\\", 2: "/srv"}

    def path(k, seen=()):
        if k in tops:
            return tops[k], 0
        if k not in parent or k in seen or (up := path(parent[k], (*seen, k))) is None:
            return None
        sep = "\\" if "\\" in up[0] else "/"
        return up[0] + ("" if up[0].endswith(sep) else sep) + f"n{k}", up[1] + 1

    roots = spark.createDataFrame(list(tops.items()), "file_id long, path string")
    placed = tree.resolve(raw, roots)
    want = {k: path(k) for k in parent}
    assert {r.file_id: (r.path, r.depth) for r in placed.collect()} == {k: v for k, v in want.items() if v}
    assert {r.file_id for r in tree.orphans(raw, placed, roots).collect()} == {k for k, v in want.items() if not v}


def test_a_deep_chain(spark):
    rows = spark.createDataFrame([(k, k - 1, str(k), True) for k in range(1, 131)], "file_id long, parent_id long, name string, is_dir boolean")
    last = tree.resolve(rows, spark.createDataFrame([(0, "/")], "file_id long, path string")).orderBy(F.desc("depth")).first()
    assert last.depth == 130 and last.path == "/" + "/".join(map(str, range(1, 131)))


def test_raw_nodes_are_excluded_by_name_only(spark):
    raw = spark.createDataFrame([(2, 1, "Windows", True), (3, 2, "system.ini", False), (4, 1, "home", True), (5, 4, "windows", False), (6, 4, "a.tmp", False)], "file_id long, parent_id long, name string, is_dir boolean")
    left = tree.exclude_raw(raw, [*tree.DEFAULT_EXCLUDES, "*.tmp", "home/windows"])
    assert {r.file_id for r in left.collect()} == {3, 4}
    roots = spark.createDataFrame([(1, "C:\\")], "file_id long, path string")
    assert {r.file_id for r in tree.orphans(left, tree.resolve(left, roots), roots).collect()} == {3}


def test_recursive_paths_have_no_row_limit(spark):
    from quarrykit.plans import catalogue

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        got = {(r.file_id, r.path, r.depth) for r in catalogue.QUERIES["tree_paths_recursive"](spark, sf).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    below = {(r.file_id, r.path, r.depth) for r in catalogue.QUERIES["tree_paths"](spark, sf).collect()}
    tops = {r.file_id for r in catalogue.views.roots(spark, sf).collect()}
    assert len(got) > 20 and below < got and {x[0] for x in got - below} == tops and all(x[2] == 0 for x in got - below)


# ---- journal records


def journal(*rows):
    """Bytes of records (file_id, parent_id, name, attributes, major, name_at)."""
    out = b""
    for file_id, parent_id, name, attributes, major, name_at in rows:
        raw = name if isinstance(name, bytes) else name.encode("utf-16-le", "surrogatepass")
        head = np.zeros(1, usn.HEAD)
        head["length"], head["major"], head["file_id"], head["parent_id"] = usn.HEADER + len(raw), major, file_id, parent_id
        head["attributes"], head["name_size"], head["name_at"] = attributes, len(raw), name_at
        out += head.tobytes() + raw
    return out


def seen(buffer, mask=False):
    return [tuple(r.values()) for r in usn.records(buffer, mask).to_pylist()]


BAD, NEWER = ("malformed", None, None, None, None), ("unsupported", None, None, None, None)


def test_journal_records(spark):
    good = journal((70, 7, "그림", 0x10, 2, 60), (71, 70, "sun.png", 0x20, 2, 60), (72, 70, "..", 0x10, 2, 60), (73, 70, "", 0, 2, 60))
    nodes = [("node", 70, 7, "그림", True), ("node", 71, 70, "sun.png", False)]
    assert seen(good) == nodes
    assert seen(journal((1, 2, "v3", 0, 3, 60)) + good) == [NEWER, *nodes]
    assert seen(journal((1, 2, "out", 0, 2, 63), (1, 2, "in", 0, 2, 59), (1, 2, b"odd", 0, 2, 60)) + good) == [BAD, BAD, BAD, *nodes]
    assert seen(journal((1, 2, "a\ud800b", 0, 2, 60)))[0][3] == "a\ufffdb"
    for rest, torn in ((b"", []), (b"\0\0\0", []), (bytes(4), []), (bytes(5), [BAD]), (b"\x07\0\0\0", [BAD]), (good[:-1], [*nodes, BAD])):
        assert seen(rest) == torn
    assert seen(journal((5 | 9 << 48, 6 | 3 << 48, "x", 0, 2, 60)), mask=True) == [("node", 5, 6, "x", False)]
    table = spark.createDataFrame([(bytearray(good),), (None,), (bytearray(journal((1, 2, "v4", 0, 4, 60))),)], "content binary")
    assert tuple(usn.stats(usn.decode(table)).first()) == (2, 0, 1)


def test_short_buffers_are_decoded_many_at_a_time(spark):
    """Buffers of one record each leave in few batches, each buffer's rows together and in order, torn ends behind them."""
    one = [journal((k, 5, f"n{k}", 0, 2, 60)) for k in range(3000)]
    buffers = [*one[:1500], b"\x07\0\0\0", one[1500] + one[1501] + b"\x07\0\0\0", *one[1502:], bytes(4), b""]
    rows = usn.records_of(buffers).to_pylist()
    assert rows == [r for b in buffers for r in usn.records(b).to_pylist()] and len(rows) == 3002
    lists = list(usn.pieces(pa.array([*buffers, None], pa.binary())))
    assert len(lists) == 1 and lists[0] == buffers
    assert [len(x) for x in usn.pieces(pa.array([b"aaaa", None, b"bbbbbb", b"c", b"d"], pa.binary()), 5)] == [1, 1, 2]


def test_volumes_of_which_one_fails(spark, tmp_path):
    """Two good dumps, one broken, one that is not there and an empty one: two volumes and three errors, ids apart."""
    rows = [(100 + k, 5, f"이름{k}.txt", 0, 2, 60) for k in range(500)]
    good = {"a": journal(*rows), "c": journal((7, 5, "folder", 0x10, 2, 60), (8, 7, "v3", 0, 3, 60)) + b"\x07\0\0\0 torn"}
    for name, body in (good | {"b": b"no journal, but a text of some length, that begins with no record at all", "e": b""}).items():
        (tmp_path / name).write_bytes(body)
    dumps = [str(tmp_path / n) for n in ("a", "b", "c", "d", "e")]
    for piece in (volumes.PIECE, 97, 1024):  # records that two pieces share
        found = volumes.scan(spark, dumps, piece=piece).collect()
        nodes = {(r.volume, r.file_id, r.parent_id, r.name) for r in found if r.kind == "node"}
        assert nodes == {(1, 1 << 56 | i, 1 << 56 | p, n) for i, p, n, *_ in rows} | {(3, 3 << 56 | 7, 3 << 56 | 5, "folder")}
        assert {r.volume: r.error.split(": ", 1)[1] for r in found if r.kind == "error"} == {2: "no journal records", 4: "No such file or directory", 5: "no journal records"}
    assert tuple(volumes.counts(volumes.scan(spark, dumps)).first()) == (2, 3, 501, 1, 1)
    assert volumes.scan(spark, []).count() == 0


# ---- papers


class Paper:
    """A made-up paper with random text, and what has to be found in it."""

    def __init__(self, seed, marked, blocks=(6, 6, 6), short=13):
        g = random.Random(seed)
        self.words = lambda: " ".join(g.choice(["망", "암호", "cloud", "지표", "trust", "큐", "연산", "v2"]) for _ in range(g.randint(4, 9)))
        self.short = [self.words() for _ in range(short)]
        out = ["제 1 교시"] * marked + ["국가기술자격 어쩌고", "다음 문제 중 10 문제 고르기"]
        for no, words in enumerate(self.short, 1):
            if g.random() < 0.4:  # goes on in a line of its own
                more = self.words()
                out += [f"{no}. {words}", f"   {more} ", ""]
                self.short[no - 1] += " " + more
            else:
                out.append(f"{no}.{words}")
        out += ["  1 – 1 "]
        self.items, self.spec_at = {}, (g.randint(2, 1 + len(blocks)), g.randint(1, 3)) if blocks else None
        for period, n in enumerate(blocks, 2):
            out += [f"제{period}교시"] * marked + ["다음문제 중 4문제 고르기"]
            for no in range(1, n + 1):
                stem, subs = self.words(), [(k, self.words()) for k in "가나다"[: g.randint(0, 3)]]
                if (period, no) == self.spec_at:
                    stem = "다음 명세 " + stem
                out += [f"{no}. {stem}", *(f"{k}. {v}" for k, v in subs)]
                if g.random() < 0.3:
                    more = self.words()
                    out.append(more)
                    stem, subs = (stem, [*subs[:-1], (subs[-1][0], f"{subs[-1][1]} {more}")]) if subs else (f"{stem} {more}", subs)
                self.items[period, no] = (stem, subs)
            if self.spec_at and period == self.spec_at[0]:
                self.spec = self.words()
                out += ["[ 명세 ] " + self.spec, "※ 쪽 끝"]
        self.text = "\n".join(out)


@pytest.mark.parametrize("seed,marked", [(1, True), (2, False), (3, True)])
def test_papers_are_found_whole(spark, seed, marked):
    p = Paper(seed, marked)
    found = papers.structured(spark.createDataFrame([(f"기술 제{90 + seed}회(2011년).pdf", p.text)], "source string, text string"))
    r = found.first()
    assert (r["round"], r["year"], r["gyosi_estimated"], r["error"]) == (90 + seed, "2011", not marked, None)
    got = [i["text"] for i in r["period1"]]
    assert got[:12] == p.short[:12] and got[12].startswith(p.short[12])  # the last item takes what follows it
    for b in r["essay"]:
        for i in b["items"]:
            stem, subs = p.items[b["gyosi"], i["no"]]
            last = i["no"] == len(b["items"]) and marked and b["gyosi"] < 4  # the next period's mark follows
            assert i["stem"] == stem or (last and not subs and i["stem"].startswith(stem))
            assert [(s["k"], s["v"]) for s in i["subs"]][: len(subs) - last] == subs[: len(subs) - last]
            assert i["spec"] == (p.spec if (b["gyosi"], i["no"]) == p.spec_at else None)
    assert [len(b["items"]) for b in r["essay"]] == [6, 6, 6] and papers.summary(found).first().status == "정상"


def test_reports_of_papers(spark, tmp_path):
    rows = [("제9회.pdf", Paper(4, False).text), ("제100회 (2020년).hwp", Paper(5, True, blocks=(6, 5)).text), ("제7회.pdf", "짧다"), ("이름.pdf", Paper(6, True).text)]
    found = papers.structured(spark.createDataFrame(rows, "source string, text string"))
    assert {r.source for r in papers.failures(found).collect()} == {"제7회.pdf", "이름.pdf"}
    good = found.filter("error is null")
    assert tuple(papers.outcome(found).first()) == (2, 2, 1, False) and tuple(papers.outcome(good).first()) == (2, 0, 1, True)
    assert not papers.outcome(good, strict=True).first().ok
    text = report.summary_markdown(found, to=str(tmp_path / "out.md"))
    assert (tmp_path / "out.md").read_text() == text and text.index("9회 (추정)") < text.index("100회 ") and "⚠ 논술형 2개 교시, 3교시 5문항" in text and "2개 회차 · 55문항" in text
    assert report.summary_markdown(found.limit(0)) == report.NO_PAPERS
    page = report.questions_html(found, "a<b")
    assert page.index("제100회") < page.index("제9회") and "<h1>a&lt;b</h1>" in page and "총 55문항" in page and "문제지 1개는" in page
    store.write_questions(found, str(tmp_path / "q"))
    whole = json.loads("\n".join(p.read_text() for p in sorted((tmp_path / "q").glob("part-*"))))
    assert list(whole) == ["papers"] and list(whole["papers"]) == ["100", "9"] and list(whole["papers"]["9"]) == sorted(whole["papers"]["9"])
    first = papers.questions(good).filter("round = 9 and gyosi = 2 and no = 1").first()
    item = whole["papers"]["9"]["essay"][0]["items"][0]
    assert item == {"no": 1, "spec": first.spec, "stem": first.stem, "subs": [[s["k"], s["v"]] for s in first.subs]}
    assert whole["papers"]["9"]["year"] is None and whole["papers"]["9"]["gyosi_estimated"] is True and whole["papers"]["9"]["period1"][2][0] == 3
    store.write_questions(found.limit(0), str(tmp_path / "e"))
    assert json.loads("\n".join(p.read_text() for p in sorted((tmp_path / "e").glob("part-*")))) == {"papers": {}}


def test_a_continuation_of_many_lines_takes_time_in_proportion(spark):
    """One item with 20,000 further lines: all are there, and four times the lines take no more than some eight times as long."""
    import time

    def parsed(n):
        more = [f"이어지는 줄 {k}" for k in range(n)]
        text = "\n".join(["13문제 중 10문제", "1. 처음", *more, "2. 다음", "6문제 중 4문제", "1. 논술", "가. 항목", *more, "2. 끝"])
        table = spark.createDataFrame([("제1회.txt", text)], "source string, text string")
        begin = time.time()
        row = papers.structured(table).first()
        return row, time.time() - begin, " ".join(more)

    parsed(100)
    (_, short, _), (row, long, more) = parsed(5_000), parsed(20_000)
    assert [(i.no, i.text) for i in row.period1] == [(1, f"처음 {more}"), (2, "다음")]
    first, last = row.essay[0]["items"]
    assert (first["stem"], [(x["k"], x["v"]) for x in first["subs"]], last["stem"]) == ("논술", [("가", f"항목 {more}")], "끝")
    assert long < 8 * short + 2


def test_papers_are_parsed_once(spark):
    """Questions, filters and summaries of structured papers match no patterns again, and small papers fill many tasks."""
    g = random.Random(3)
    table = spark.createDataFrame([(f"제{k}회.txt", paper_text(g, "x"), k) for k in range(40)], "source string, text string, mark int").coalesce(1)
    found = papers.structured(table, ("mark",))
    assert sorted(r.mark for r in found.select("round", "mark").collect() if r.round == r.mark) == list(range(40))
    assert found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    for use in (papers.questions(found.filter("error is null")), papers.summary(found), papers.outcome(found)):
        plan = use._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract" not in plan and "split(" not in plan


def test_page_of_questions(spark):
    text = "\n".join(["13문제 중 10문제", *(f"{k}. RAG <{k}> & 신호" for k in range(1, 14)), "6문제 중 4문제", *(f"{k}. 논술 {k}" for k in range(1, 7))]) + " " * 500
    made = papers.structured(spark.createDataFrame([("제3회.txt", text)], "source string, text string"))
    page = report.questions_page(made, "a < b")
    assert page.startswith("<!doctype html>") and page.rstrip().endswith("</html>") and "<title>a &lt; b</title>" in page
    assert page.count("<li data-g=") == 19 and page.count('data-g="1"') == 13 and 'id="q"' in page and 'id="count"' in page
    assert "RAG &lt;1&gt; &amp; 신호" in page and "<script>" in page and "1개 회차 · 1교시 13문항 + 논술형 6문항 = 총 19문항" in page


# ---- folders


def planted(top, names):
    for name in names:
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(name)


def test_cubes_of_large_keys(spark):
    """Keys whose cube leaves 63 bits, of both signs: as with whole numbers of any size."""
    from quarrykit.plans import catalogue

    keys = [0, 1, 2_097_151, 2_097_152, 3_000_001, 9_000_000, 1 << 42, (1 << 42) - 1, (1 << 62) + 12345, -1, -9_000_001, -(1 << 63)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", catalogue.cube_rest(F.col("k")).alias("c")).collect()
    assert [r.c for r in rows] == [(abs(k) ** 3 % (1 << 42)) * (-1 if k < 0 else 1) for k in keys]


def test_contents_are_written_a_few_at_a_time(spark):
    """400 contents of a megabyte in one task: all are written, and no worker has held half of them."""
    from quarrykit.plans import stored

    content = F.encode(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), F.lit(1 << 20))), "UTF-8")
    top = stored.written(spark.range(0, 400, 1, 1).select(F.concat(F.lit("/f"), F.col("id").cast("string")).alias("path"), content.alias("content")), "megabytes")
    assert sorted(os.listdir(top)) == sorted(f"f{k}" for k in range(400)) and os.path.getsize(f"{top}/f37") == (1 << 20) + 2
    peaks = []
    for p in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{p}/cmdline", "rb") as f, open(f"/proc/{p}/status") as g:
                if b"pyspark.daemon" in f.read():
                    peaks += [int(x.split()[1]) // 1024 for x in g if x.startswith("VmHWM")]
        except OSError:
            pass
    assert peaks and max(peaks) < 200 + min(peaks)


def test_folder_scan(spark, tmp_path):
    planted(tmp_path, ["top.md", "src/deep/er/a[1].c", "src/a1.c", "skip/inner/b.c", "빈/c.txt"])
    os.symlink(tmp_path / "src", tmp_path / "src/deep/again")
    here = str(tmp_path)
    walk = lambda **o: {os.path.relpath(r.path, here) for r in listing.folders(spark, [here], **o).collect()}
    whole = {".", "top.md", "src", "src/a1.c", "src/deep", "src/deep/again", "src/deep/er", "src/deep/er/a[1].c", "skip", "skip/inner", "skip/inner/b.c", "빈", "빈/c.txt"}
    assert walk() == whole
    assert walk(exclude=["SKIP", "*[1].c", "src/deep/er"]) == {x for x in whole if not x.startswith("skip") and not x.startswith("src/deep/er")}
    assert walk(follow_links=True) == whole - {"src/deep/again"}  # a link to a folder above is an error
    counts = listing.scan_counts(listing.scanned(spark, [here], exclude=["skip", "?1.c"])).first()
    assert tuple(counts) == (4, 5, 2, 0)
    rows = {r.path: r for r in listing.folders(spark, [here]).collect()}
    top = os.stat(tmp_path / "top.md")
    assert (rows[f"{here}/top.md"].size, rows[f"{here}/top.md"].mtime, rows[f"{here}/top.md"].file_id) == (top.st_size, int(top.st_mtime), top.st_ino)
    assert rows[f"{here}/src"].size is None and rows[f"{here}/src"].mtime > 0 and rows[here].parent is None and rows[here].name == here
    os.unlink(tmp_path / "src/deep/again")  # Spark's own listing follows every link
    assert listing.spark_listing(spark, here).filter("not is_dir").count() == 5
    some = listing.folders(spark, [here]).filter("name like '%.c'")
    assert {bytes(r.content).decode() for r in listing.contents(spark, some).collect()} == {"src/deep/er/a[1].c", "src/a1.c", "skip/inner/b.c"}


def test_flat_deep_and_wide_trees_equal_a_plain_walk(spark, tmp_path):
    g = random.Random(3)
    planted(tmp_path, [f"flat/f{k}" for k in range(3000)] + ["deep/" + "/".join(["d"] * 120) + "/x"])
    planted(tmp_path, ["wide/" + "/".join(str(g.randrange(6)) for _ in range(g.randint(1, 5))) + f"/n{k}" for k in range(400)])
    want = {(str(tmp_path), True)}
    for at, below, files in os.walk(tmp_path):
        want |= {(f"{at}/{n}", True) for n in below} | {(f"{at}/{n}", False) for n in files}
    for first, budget in ((listing.FIRST_BUDGET, listing.BUDGET), (1, 40)):  # in few rounds, and in many
        rows = listing.names(spark, [str(tmp_path)], first=first, budget=budget).collect()
        assert len(rows) == len(want) and {(r.path, r.is_dir) for r in rows} == want
        assert all(r.depth == len(os.path.relpath(r.path, tmp_path).split("/")) for r in rows if r.parent) and not any(r.error for r in rows)
    both = listing.names(spark, [str(tmp_path / "deep"), str(tmp_path / "deep")])  # roots are not compared
    assert both.count() == 2 * 122


def test_usual_exclusions_are_in_force(spark, tmp_path):
    planted(tmp_path, ["AppData/x.txt", "work/windows/y.txt", "work/Program Files/z.txt", "work/windows.txt"])
    seen = lambda **o: {r.name for r in listing.names(spark, [str(tmp_path)], **o).filter("kind in ('file', 'dir') and parent is not null").collect()}
    assert seen() == {"work", "windows.txt"}
    assert seen(exclude=[]) == {"AppData", "x.txt", "work", "windows", "y.txt", "Program Files", "z.txt", "windows.txt"}
    assert listing.scan_counts(listing.scanned(spark, [str(tmp_path)])).first().skipped == 3


def test_errors_of_a_scan_are_counted(spark, tmp_path):
    planted(tmp_path, ["a/b.txt", "c.txt"])
    os.symlink("nowhere", tmp_path / "broken")
    os.symlink(tmp_path / "a", tmp_path / "a" / "up")
    os.mkdir(os.fsencode(str(tmp_path)) + b"/\xff\xfe")
    open(os.fsencode(str(tmp_path)) + b"/\xff\xfe/in.txt", "w").close()
    here = str(tmp_path)
    counts = lambda roots, **o: tuple(listing.scan_counts(listing.scanned(spark, roots, **o)).first())
    assert counts([here + "/none"]) == (0, 0, 0, 1) and listing.folders(spark, [here + "/none"]).count() == 0
    assert counts([here + "/c.txt"]) == (1, 0, 0, 0)
    # what is no UTF-8 is listed by a name that leads nowhere: its folder's and its file's metadata fail
    assert counts([here, here + "/none"]) == (5, 3, 0, 1 + 2)
    assert counts([here], follow_links=True) == (3, 3, 0, 2 + 2)  # the broken link, and the one that leads back
    named = listing.cut(listing.names(spark, [here]))
    os.unlink(tmp_path / "a/b.txt")
    row = listing.filled(named).filter("name = 'b.txt'").first()
    assert row.size is None and row.mtime == 0 and "No such file" in row.error
    assert listing.filled(named).count() == named.count()


def test_names_first_and_metadata_later(spark, tmp_path):
    planted(tmp_path, [f"docs/report{k}.txt" for k in range(30)] + [f"docs/{k}.bin" for k in range(20)] + ["big.txt"])
    (tmp_path / "big.txt").write_bytes(b"z" * 5000)
    none, here = spark.createDataFrame([], store.USAGE), [str(tmp_path)]

    def found(query, **options):
        seen = spark.sparkContext.accumulator(0)
        rows = folder_search.find(spark, here, query, none, looked_up=seen, **options).collect()
        whole = search.search(listing.folders(spark, here), query, none, hashing.PathContents(), **options).collect()
        assert [(r.path, r.size, r.mtime, r.score) for r in rows] == [(r.path, r.size, r.mtime, r.score) for r in whole]
        return seen.value, len(rows)

    assert found("report ext:txt", limit=5) == (5, 5)  # just what is shown
    assert found("nothing_like_it", limit=0) == (0, 0)
    assert found("ext:txt size:>1kb", limit=0) == (31, 1)  # only what the name leaves
    assert found("bin dup:", limit=0)[0] == 20
    assert found("folder:", sort="date", limit=0) == (1, 1)
    seen = spark.sparkContext.accumulator(0)
    assert listing.names(spark, here).filter("name like 'report%'").count() == 30 and seen.value == 0


def test_paper_files(spark, tmp_path):
    for name in ("제20회.hwp", "무명.pdf", "★제3회.pdf", "제20회.pdf", "제100 회.pdf", "notes.txt"):
        (tmp_path / name).write_text("x")
    assert [r.source for r in listing.paper_files(spark, str(tmp_path)).collect()] == ["★제3회.pdf", "제20회.pdf", "제20회.hwp", "제100 회.pdf", "무명.pdf"]


# ---- streams


@pytest.fixture
def keyed_states(spark):
    from quarrykit.streaming import usage_stream

    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, usage_stream.PROVIDER)
    yield usage_stream
    spark.conf.unset(key)


def until(spark, sql):
    """Waits for a row; a stream with timers never runs out of work."""
    import time

    for _ in range(240):
        if spark.sql(sql).count():
            return
        time.sleep(0.5)
    raise AssertionError(sql)


LOG = "seq long, path string, ts long"


def test_stream(spark, tmp_path, keyed_states):
    import time

    now = int(time.time())
    spark.createDataFrame([(1, "/now", now), (2, "/now", now - 50), (3, "/once", 5)], LOG).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
    q = keyed_states.live_usage(stream).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until(spark, "select 1 from live where key = '/once'")
        assert {(r.key, r.score, r["count"], r["last"]) for r in spark.sql("select * from live").collect()} == {("/now", 2.0, 2, now), ("/once", 1.0, 1, 5)}
        time.sleep(4)  # what has decayed long ago is forgotten, what is in use is not
        spark.createDataFrame([(4, "/now", now), (5, "/once", now)], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        until(spark, "select 1 from live where key = '/now' and count = 3")
    finally:
        q.stop()
    last = {r.key: r["n"] for r in spark.sql("select key, max(count) n from live group by key").collect()}
    assert last == {"/now": 3, "/once": 1}
    assert keyed_states.expiry_seconds(1.0, 0, 1.0) == pytest.approx(9.9658 * DAY, rel=1e-4)


def test_a_stream_goes_on_from_the_stored_table(spark, tmp_path, keyed_states):
    """Stored table, stream, restart: the states equal the fold of the whole log, late uses and all, and can be stored."""
    import time

    g, now, at = random.Random(5), int(time.time()), str(tmp_path / "usage")
    log = [(k, f"/f{g.randrange(4)}" if k < 50 else "/new", now - g.randrange(20 * DAY)) for k in range(90)]
    first, second, third = log[:30], log[30:60], log[60:]
    store.write_usage(usage.fold(spark.createDataFrame(first, LOG)), at, now)

    def run(rows):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
        live = keyed_states.live_usage(stream, stored=store.read_usage(spark, at))
        seen = set()
        note = lambda batch, _: seen.update(r.key for r in batch.select("key").collect())
        q = live.writeStream.outputMode("update").foreachBatch(note).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            for _ in range(240):
                if seen == {p for _, p, _ in rows} and q.lastProgress and not q.lastProgress["numInputRows"]:
                    break
                time.sleep(0.5)
        finally:
            q.stop()

    run(second)
    run(third)  # from the checkpoint, not from the table again
    got = {r.key: r for r in keyed_states.states(spark, str(tmp_path / "c")).collect()}
    want = {r.key: r for r in usage.fold(spark.createDataFrame(log, LOG)).collect()}
    assert set(got) == set(want)
    for key, r in want.items():
        assert got[key].score == pytest.approx(r.score, rel=1e-9) and (got[key]["count"], got[key]["last"], got[key].path) == (r["count"], r["last"], r.path)
    store.write_usage(keyed_states.states(spark, str(tmp_path / "c")), at, now)
    assert {r.key: r["count"] for r in store.read_usage(spark, at).collect()} == {k: r["count"] for k, r in want.items()}


# ---- versions, and papers as they arrive


def test_a_write_that_fails_leaves_the_version_before(spark, tmp_path):
    at = str(tmp_path / "t")
    table = versions.Versions(spark, at)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.write(spark.range(100)) == 1
    reader = table.read()
    half = spark.range(0, 100, 1, 4).select(F.when(F.col("id") > 90, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        table.write(half)
    assert table.read().count() == 100 and table.newest().version == 1
    assert table.write(table.read().filter("id >= 50")) == 2  # from itself
    assert (table.read().count(), table.read(version=1).count(), reader.count()) == (50, 100, 100)
    assert table.write(table.read().limit(0)) == 3 and table.read().count() == 0
    assert len(table.vacuum(keep=2)) == 2 and table.read(version=2).count() == 50 and table.vacuum(keep=2) == []
    os.rename(f"{at}/{table.newest().folder}", f"{at}/elsewhere")
    (tmp_path / "t" / table.newest().folder).mkdir()
    (tmp_path / "t" / table.newest().folder / "part-0.parquet").write_bytes(b"no table at all")
    assert table.read(spark.range(1).schema).count() == 0


def paper_text(g, mark):
    items = [f"{k}. {mark} {' '.join(g.choice(['회로', '전송', '신호', 'TCP']) for _ in range(9))}" for k in range(1, 14)]
    return "\n".join(["13문제 중 10문제", *items, "6문제 중 4문제", *(f"{k}. 논술 {mark} " + "설명 " * 12 for k in range(1, 7))])


def test_papers_that_arrive_are_kept_once_a_round(spark, tmp_path):
    from quarrykit.streaming import paper_stream

    g, out = random.Random(2), str(tmp_path / "out")
    rounds = lambda: {r.round: (r.source, r.period1[0].text.split()[0]) for r in versions.Versions(spark, f"{out}/papers").read().collect()}
    failed = lambda: {r.source: r.reason for r in versions.Versions(spark, f"{out}/failures").read().collect()}

    def send(name, text, age):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
        os.utime(tmp_path / "in" / name, (1_700_000_000 + age,) * 2)

    def run():
        q = paper_stream.structure(paper_stream.arriving(spark, str(tmp_path / "in")), out, str(tmp_path / "c"))
        q.awaitTermination(120)
        assert q.exception() is None

    send("제7회.txt", paper_text(g, "old"), 1)
    send("제8회.txt", paper_text(g, "eight"), 2)
    send("short 제9회.txt", "too short", 3)
    run()
    assert rounds() == {7: ("제7회.txt", "old"), 8: ("제8회.txt", "eight")} and failed() == {"short 제9회.txt": "too little text"}
    send("제7회 again.txt", paper_text(g, "new"), 9)
    send("제8회 early.txt", paper_text(g, "late news"), 0)  # arrived before the one that is kept
    send("nameless.txt", paper_text(g, "x"), 4)
    run()
    want = {7: ("제7회 again.txt", "new"), 8: ("제8회.txt", "eight")}
    assert rounds() == want and failed() == {"short 제9회.txt": "too little text", "nameless.txt": "no round in the name"}
    # a batch that runs again, as after a crash before its end was noted, changes nothing
    table = versions.Versions(spark, f"{out}/papers")
    version, last = table.newest().version, table.newest().batch
    batch = spark.createDataFrame([("제7회.txt", paper_text(g, "replayed"))], "source string, text string").withColumn("arrived", F.current_timestamp())
    paper_stream.upsert(batch, last, out, "papers")
    assert table.newest().version == version and rounds() == want
    paper_stream.upsert(batch.unionByName(batch), last + 1, out, "papers")
    assert rounds()[7] == ("제7회.txt", "replayed") and len(rounds()) == 2


# ---- nodes without paths


def node_rows(spark, rows):
    return spark.createDataFrame(rows, "file_id long, parent_id long, name string, is_dir boolean, size long, mtime long")


def planted_nodes(g, n):
    """A random tree below roots 1 and 2, with a chain of nine, orphans, a cycle, and ids that occur twice."""
    rows = [(10 + k, g.choice([1, 2, *range(10, 10 + k)]), f"d{k}", True, None, 0) for k in range(40)]
    rows += [(100 + k, g.choice([1, *range(10, 50)]), g.choice(["report", "Photo", "x"]) + f"{k}." + g.choice(["txt", "PDF", "jpg"]), False, g.randrange(5000), k) for k in range(n)]
    rows += [(1000 + k, 999 + k if k else 2, f"c{k}", True, None, 0) for k in range(9)] + [(1100, 1008, "report_deep.txt", False, 3000, 1)]
    rows += [(2000, 2001, "cyc", True, None, 0), (2001, 2000, "cyc2", True, None, 0), (2002, 2001, "report_lost.txt", False, 1, 1), (2003, 7777, "report_gone.txt", False, 1, 1)]
    return rows + [(100, 9999, "zzz.txt", False, 4, 4), (1, 10, "report_root", True, None, 0)]


def test_search_before_paths_equals_search_of_an_index(spark):
    g = random.Random(4)
    raw = node_rows(spark, planted_nodes(g, 150))
    roots = spark.createDataFrame([(1, "/a"), (2, "C:\\")], "file_id long, path string")
    placed = tree.resolve(raw, roots).select("file_id", "path")
    # of two rows with one id, the smallest parent counts; the planted second row of 100 has a larger one
    index = raw.filter("not (file_id = 100 and parent_id = 9999)").join(placed, "file_id").withColumns({"idx": F.col("file_id"), "parent": F.col("parent_id")})
    log = spark.createDataFrame([(k, r.path, 100 + k) for k, r in enumerate(placed.orderBy("file_id").limit(80).collect())], "seq long, path string, ts long")
    used = usage.fold(log)
    for query, sort in (("report", "freq"), ("report ext:txt,pdf size:>1kb", "size"), ("!ext:jpg path:d1 rc:>0", "freq"), ("C:\\c0\\", "size"), ("", "freq"), ("no such name", "freq")):
        got = [(r.path, r.size, r["count"]) for r in node_search.search_nodes(raw, roots, query, used, sort=sort, limit=25, now=500).collect()]
        assert got == [(r.path, r.size, r["count"]) for r in search.search(index, query, used, sort=sort, limit=25, now=500).collect()], (query, sort)


def test_only_what_is_above_a_survivor_is_resolved(spark):
    g = random.Random(4)
    raw = node_rows(spark, planted_nodes(g, 400))
    roots = spark.createDataFrame([(1, "/a"), (2, "/b")], "file_id long, path string")
    parent = {r.file_id: r.parent_id for r in raw.filter("parent_id != 9999 and file_id != 1").collect()}
    for query in ("report_deep", "photo3 size:>1kb", "nothing"):
        found = node_search.survivors(raw, roots, parse(query))
        want = set()
        for r in found.collect():
            at = r.file_id
            while at in parent and at not in want:
                want.add(at)
                at = parent[at]
        got = [r.file_id for r in node_search.needed(raw, roots, found).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) < 0.3 * raw.count()
    assert node_search.needed(raw, roots, node_search.survivors(raw, roots, parse("report_lost"))).count() == 3  # a cycle ends


def test_why_nodes_are_orphans(spark):
    rows = [(10, 1, "a"), (11, 10, "b"), (12, 11, "c")]  # placed, three deep
    rows += [(20, 99, "a"), (21, 20, "b"), (22, 21, "c"), (23, 22, "d"), (24, 22, "e")]  # below a missing parent
    rows += [(30, 31, "x"), (31, 32, "y"), (32, 30, "z"), (33, 30, "w"), (34, 33, "v"), (35, 35, "own")]  # cycles and what leads there
    rows += [(40 + k, 39 + k if k else 98, "l") for k in range(50)]
    raw = spark.createDataFrame([(a, b, c, True) for a, b, c in rows], "file_id long, parent_id long, name string, is_dir boolean")
    roots = spark.createDataFrame([(1, "/r")], "file_id long, path string")
    got = {r.file_id: (r.reason, r.length, r.missing) for r in tree.orphan_reasons(raw, roots).collect()}
    want = {20: ("missing", 1, 99), 21: ("missing", 2, 99), 22: ("missing", 3, 99), 23: ("missing", 4, 99), 24: ("missing", 4, 99)}
    want |= {k: ("cycle", None, None) for k in range(30, 36)} | {40 + k: ("missing", k + 1, 98) for k in range(50)}
    assert got == want
    assert set(got) == {r.file_id for r in tree.orphans(raw, tree.resolve(raw, roots), roots).collect()}
    deep = {r.file_id: r.length for r in tree.orphan_reasons(raw, roots, deepest=2).filter("reason = 'deep'").collect()}
    assert deep == {12: 3} and tree.orphan_reasons(raw.limit(0), roots).count() == 0


# ---- counters of the same job


def test_a_search_counts_in_the_job_that_shows(spark, tmp_path):
    from pyspark.sql import Observation

    files = spark.range(500).select(F.col("id").alias("idx"), F.lit("/d").alias("parent"), F.concat(F.lit("f"), "id").alias("name"), F.lit(False).alias("is_dir"), F.col("id").alias("size"), F.lit(1).cast("long").alias("mtime"), F.col("id").alias("file_id"), F.concat(F.lit("/d/f"), "id").alias("path"))
    files.write.parquet(str(tmp_path / "f"))
    counted = Observation("search")
    shown = search.search(spark.read.parquet(str(tmp_path / "f")), "f1 size:>100", spark.createDataFrame([], store.USAGE), sort="size", limit=7, counted=counted)
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    found = [k for k in range(101, 500) if "1" in str(k) and str(k).startswith("1")]
    assert [r.size for r in shown.collect()] == found[::-1][:7] and counted.get["total"] == len(found)


def test_hashing_counts_in_its_own_job(spark, tmp_path):
    from pyspark.sql import Observation

    files = on_disk(spark, tmp_path, [b"x" * 20_000] * 3 + [None, b"123456789", b"y" * 20_000])
    first, whole = Observation("quick"), Observation("whole")
    second = dup.with_full(dup.same_prefix(dup.with_quick(dup.same_size(files), hashing.PathContents(), first)), hashing.PathContents(), counted=whole)
    assert first.get == {"files": 6, "bytes": 4 * dup.PREFIX + 9, "errors": 1} and whole.get == {"files": 3, "bytes": 60_000, "errors": 0}
    assert second.count() == 3


# ---- all commands together


def test_workspace(spark, tmp_path):
    """Index, use, find, duplicates with a cache, prune and a new half-life, over stores that go on from each other."""
    home = tmp_path / "home"
    planted(home, ["docs/a.txt", "docs/b.txt", "pics/c.jpg", "Windows/sys.dll"])
    for name in ("docs/twin1.bin", "pics/twin2.bin"):
        (home / name).write_bytes(noise(3, 40_000))
    own, top, day = workspace.Workspace(spark, str(tmp_path / "stores")), str(home), 86_400
    assert tuple(own.index([top, top + "/none"]).first()) == (5, 3, 1, 1)
    own.hit([f"{top}/docs/b.txt", f"{top}/docs/b.txt", f"{top}/pics/c.jpg"], 100 * day)
    row = own.hit([f"{top}/docs/b.txt"], 130 * day).first()  # a half-life later
    assert (row.score, row["count"], row["last"]) == (pytest.approx(2.0), 3, 130 * day)
    assert [r.name for r in own.search("!folder: !dup:", 130 * day).collect()] == ["b.txt", "c.jpg", "a.txt"]
    assert [r.name for r in own.search("rc:>2", 130 * day).collect()] == ["b.txt"]
    assert {r.name: r.dup_tag for r in own.search("ext:bin", 0, mark_dups=True).collect()} == {"twin1.bin": 1, "twin2.bin": 1}
    groups, members = own.dup()
    assert [(r.n, r.wasted) for r in groups.collect()] == [(2, 40_000)] and {os.path.basename(r.path) for r in members.collect()} == {"twin1.bin", "twin2.bin"}
    assert tuple(own.stats().first())[4:] == (2, 2)
    (home / "pics/twin2.bin").write_bytes(noise(3, 40_000)[:-1] + b"!")
    os.utime(home / "pics/twin2.bin", (5, 5))
    os.unlink(home / "pics/c.jpg")
    own.index([top])
    assert own.dup()[0].count() == 0  # the changed file is hashed again
    assert [r.key for r in own.prune(130 * day).collect()] == [f"{top}/pics/c.jpg"] and own.prune(130 * day).count() == 0
    assert [(r.path, r["count"]) for r in own.top(5, 130 * day).collect()] == [(f"{top}/docs/b.txt", 3)]
    assert [(r.score, r["count"]) for r in own.config(7.0, 130 * day).collect()] == [(3.0, 3)] and own.half_life_days == 7.0
    assert own.top(0, 137 * day).first().score == pytest.approx(1.5)
    assert own.open(f"{top}\\docs\\a.txt").count() == 1
