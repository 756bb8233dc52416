import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrykit.functions import text as fn
from quarrykit.plans.compile import predicate
from quarrykit.plans.query import QueryError, parse, size_literal, tokens

SCHEMA = "name string, path string, is_dir boolean, size long, count long, is_dup boolean"
#: A small orchard of files: name -> (folder, is_dir, size, count, is_dup)
ORCHARD = {
    "Apple Harvest 2021.ODT": ("/farm/notes", False, 4_000, 0, False),
    "apple-prices.csv": ("/farm/tables", False, 900, 7, True),
    "pear:grafting.txt": ("/farm/notes", False, 70, 1, False),
    "사과밭 일지.txt": ("/farm/notes", False, 2_048, 3, True),
    "배.txt": ("/farm/notes", False, 1, 0, False),
    ".pruned": ("/farm", False, 0, 0, True),
    "crates": ("/farm", True, None, 0, False),
    "plum.tar.gz": ("/old\\backup", False, 3 << 30, 2, False),
}


@pytest.fixture(scope="module")
def orchard(spark):
    rows = [(name, f"{folder}/{name}", *rest) for name, (folder, *rest) in ORCHARD.items()]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize(
    "query,found",
    [
        ("", set(ORCHARD)),
        ("APPLE", {"Apple Harvest 2021.ODT", "apple-prices.csv"}),
        ("apple 21", {"Apple Harvest 2021.ODT"}),
        ("일지", {"사과밭 일지.txt"}),
        ("apple !prices", {"Apple Harvest 2021.ODT"}),
        ("'e harv'est", {"Apple Harvest 2021.ODT"}),
        ('"사과밭 일', {"사과밭 일지.txt"}),
        ("pear:graft", {"pear:grafting.txt"}),
        ("*.txt", {"pear:grafting.txt", "사과밭 일지.txt", "배.txt"}),
        ("???.txt", {"배.txt"}),  # bytes count
        ("name:pl?m*", {"plum.tar.gz"}),
        ("ext:ODT,.csv", {"Apple Harvest 2021.ODT", "apple-prices.csv"}),
        ("ext:pruned", set()),
        ("ext:gz", {"plum.tar.gz"}),
        ("!ext:txt,odt,csv,gz", {".pruned", "crates"}),
        ("farm/tables", {"apple-prices.csv"}),
        ("path:old\\back", {"plum.tar.gz"}),
        ("size:>=2kb !size:>1g", {"Apple Harvest 2021.ODT", "사과밭 일지.txt"}),
        ("size:=900b", {"apple-prices.csv"}),
        ("size:<2", {"배.txt", ".pruned", "crates"}),
        ("size:3gb", {"plum.tar.gz"}),
        ("rc:>=3", {"apple-prices.csv", "사과밭 일지.txt"}),
        ("runcount:2 file:", {"plum.tar.gz"}),
        ("rc:>nan", set()),
        ("dup: runcount:>0", {"apple-prices.csv", "사과밭 일지.txt"}),
        ("!dupe: folder:", {"crates"}),
        ("!files:", {"crates"}),
    ],
)
def test_terms(orchard, query, found):
    assert {r.name for r in orchard.filter(predicate(parse(query))).collect()} == found


def test_many_stars_end_quickly(spark):
    # a fixed kind of case: many ways to split, none that fits
    row = spark.createDataFrame([("z" * 90, "/z", False, 0, 0, False)], SCHEMA)
    assert row.filter(predicate(parse("*z" * 12 + "*y"))).count() == 0


def test_fold_is_ascii_only(spark):
    row = spark.createDataFrame([("\u0130\u212a",)], "name string")
    assert row.filter(fn.contains_fold(F.col("name"), "k") | fn.contains_fold(F.col("name"), "i")).count() == 0


def plain_tokens(text):
    """Letter by letter, as the language is defined."""
    words, open_with = [""], None
    for c in text:
        if open_with == c:
            open_with = None
        elif open_with is None and c in "'\"":
            open_with = c
        elif open_with is None and c.isspace():
            words.append("")
        else:
            words[-1] += c
    return [w for w in words if w]


@given(st.text(alphabet="ab:! \t\n\u3000\"'", max_size=30))
def test_tokens(text):
    assert tokens(text) == plain_tokens(text)


def test_values():
    assert [size_literal(x) for x in ("7", "7b", "0.25K", "2.5 mb", "1e2", "inf", "nan", "9t")] == [7, 7, 256, 2621440, 100, 2**63 - 1, 0, 9 << 40]
    for bad in ("size:", "size:ten", "size:-4kb", "size:1_0", "ext:", "ext:. ,", "rc:", "rc:few"):
        with pytest.raises(QueryError):
            parse(bad)
    q = parse("!dup: pear !! ! !!!x")
    assert q.needs_dup and [(c.negated, c.term.value) for c in q.without_dup().clauses] == [(False, "pear"), (True, "!"), (True, "!!x")]


def test_formats(spark):
    rows = spark.createDataFrame([(0, 0), (999, -5), (1024, 120), (1572864, 7200), (None, 3 * 86400)], "b long, s long")
    got = rows.select(fn.human(F.col("b")), fn.ago(F.col("s"))).collect()
    assert [r[0] for r in got] == ["0 B", "999 B", "1.0 KB", "1.5 MB", "-"]
    assert [r[1] for r in got] == ["방금", "방금", "2분 전", "2시간 전", "3일 전"]


def test_families(spark):
    def keys(*names):
        return [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(fn.family_key(F.col("n"))).collect()]

    assert len(set(keys("사업계획_최종.hwp", "사업계획_최종_v2.hwp", "사업계획_진짜최종.hwp", "사업계획 (1).hwp", "사업계획_복사본.hwp"))) == 1
    assert len(set(keys("Chapter_1.docx", "Chapter_2.docx", "3장.docx"))) == 3
    assert len(set(keys("계획_최종.hwp", "계획_최종.pdf"))) == 2


def test_families_take_off_any_number_of_marks(spark):
    names = ["계획.hwp", "계획_최종_v2_수정_복사본 (1)_진짜최종.hwp", "계획" + "_final (2)" * 12 + ".hwp", "계획" + "진짜최종" * 40 + "본.hwp"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(fn.family_key(F.col("n"))).collect()]
    assert got == ["계획|hwp"] * 4
    real = spark.createDataFrame([("a" + "진짜최종" * 40 + "x.hwp",)], "n string").select(fn.family_key(F.col("n"))).first()[0]
    assert real == "a" + "진짜최종" * 40 + "x|hwp"
