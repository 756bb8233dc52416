"""Exam papers: from the text of a paper to nested questions, all with ordered folds over arrays of lines.

A paper is (name, text). Its first period has short items 1 to 13; then come blocks, one for each further period,
with items 1 to 6, each with a stem and lettered sub-items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.operators.numbering import cut

# What the papers print on every page, and the notices and marks that structure them.
BOILERPLATE = ["국가기술자격", "기술사 제", "분", "야 정보통신", "수험", "번호", "성", "명", "▶수험자", "“채점기준", "<표>"]
SHORT_HEAD = r"(?U)(?:13\s*문제\s*중\s*10\s*문제|다음\s*문제\s*중\s*10\s*문제)[^\n]*"
ESSAY_HEAD = r"(?U)(?:6\s*문제|다음\s*문제)\s*중\s*4\s*문제[^\n]*"
PERIOD_MARK = r"(?U)제\s*([1-4])\s*교시"
PAGE_FOOTER = r"(?U)^\s*\d\s*[–-]\s*\d\s*$"
SPEC = r"(?sU)\[\s*명세\s*\](.*?)(?=※|\z)"
SPEC_REFERENCE = r"(?U)아래\s*명세|다음\s*명세"

WHITE = r"(?U)\s+"
SPEC_TAIL = r"(?sU)\s*\[\s*명세\s*\].*$"
NOTICE_TAIL = r"(?sU)\s*※.*$"
PAGE_TAIL = r"(?U)\s*\d\s*[–-]\s*\d\s*$"
SHORT_ITEM = r"(?U)^(\d{1,2})\.\s*(.+)$"
ESSAY_ITEM = r"(?U)^(\d)\.\s*(.+)$"
SUB_ITEM = r"(?U)^([가-라])\.\s*(.+)$"

SHORT_ITEMS = "array<struct<no:int,text:string>>"
SUBS = "array<struct<k:string,v:string>>"
ESSAY_ITEMS = f"array<struct<no:int,stem:string,subs:{SUBS},spec:string>>"
EXPECTED = (13, 3, 6)


def squeeze(c: Column) -> Column:
    """White space to single spaces; what follows a specification mark, a notice mark or is a page mark goes."""
    c = F.trim(F.regexp_replace(c, WHITE, " "))
    for tail in (SPEC_TAIL, NOTICE_TAIL, PAGE_TAIL):
        c = F.regexp_replace(c, tail, "")
    return F.trim(c)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines that count: stripped, not blank, without what every page repeats."""
    own = F.transform(F.split(text, "\n"), stripped)
    noise = "^(?:" + "|".join(BOILERPLATE) + ")"
    return F.filter(own, lambda x: (x != "") & ~F.rlike(x, F.lit(noise)) & ~F.rlike(x, F.lit(PAGE_FOOTER)))


def after(text: Column, pattern: str) -> Column:
    """What follows the first match, null if there is none."""
    return F.get(F.split(text, pattern, 2), F.lit(1))


def read_once(own: Column, item: str) -> Column:
    """Each line with its number and words, its letter and sub-item, so that the folds match no pattern again and again."""

    def read(x: Column, place: Column) -> Column:
        no = F.regexp_extract(x, item, 1).try_cast("int").alias("no")
        return F.struct(
            place.alias("place"), x.alias("line"), no, F.regexp_extract(x, item, 2).alias("words"),
            F.regexp_extract(x, SUB_ITEM, 1).alias("letter"), F.regexp_extract(x, SUB_ITEM, 2).alias("sub"),
        )

    return F.transform(own, read)


def item_starts(read: Column, most: int) -> Column:
    """The places (from 0) of the lines that start an item: numbers 1 to ``most``, each one more than the last.

    The fold carries the places and the last number alone, so its work is that of the lines, however long an item is.
    """
    none = F.struct(F.array().cast("array<int>").alias("at"), F.lit(None).cast("int").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        no = x["no"]
        starts = F.coalesce((no >= 1) & (no <= most) & (acc["last"].isNull() | (no == acc["last"] + 1)), F.lit(False))
        return F.when(starts, F.struct(F.concat(acc["at"], F.array(x["place"])).alias("at"), no.alias("last"))).otherwise(acc)

    return F.aggregate(read, none, step, lambda acc: acc["at"])


def cut_at(rows: Column, starts: Column) -> Column:
    """The pieces of ``rows`` from each of the places (from 0) to the next one."""
    return F.transform(starts, lambda at, k: F.slice(rows, at + 1, F.coalesce(F.get(starts, k + 1), F.size(rows)) - at))


def joined_lines(first: Column, rest: Column) -> Column:
    return F.array_join(F.concat(F.array(first), F.transform(rest, lambda x: x["line"])), " ")


def after_first(rows: Column) -> Column:
    return F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))


def short_items(text: Column) -> Column:
    """Items of the first period: 1 to 13, each number one more than the last; other lines continue the last item."""
    head = after(text, SHORT_HEAD)
    body = F.coalesce(head, F.get(F.split(text, "1 - 1", 2), F.lit(0)))
    body = F.get(F.split(body, ESSAY_HEAD, 2), F.lit(0))

    def items(read: Column) -> Column:
        def item(rows: Column) -> Column:
            head = F.get(rows, F.lit(0))
            return F.struct(head["no"].alias("no"), squeeze(joined_lines(head["words"], after_first(rows))).alias("text"))

        return bound(item_starts(read, 13), lambda starts: F.transform(cut_at(read, starts), item))

    return bound(read_once(lines(body), SHORT_ITEM), items).cast(SHORT_ITEMS)


def essay_items(block: Column) -> Column:
    """Items 1 to 6 of a block with lettered sub-items; other lines continue the last sub-item, else the stem."""

    def sub(rows: Column) -> Column:
        head = F.get(rows, F.lit(0))
        return F.struct(head["letter"].alias("k"), squeeze(joined_lines(head["sub"], after_first(rows))).alias("v"))

    def item(rows: Column) -> Column:
        head = F.get(rows, F.lit(0))
        # a line that starts an item is no sub-item, whatever it looks like
        lettered = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda k: (k > 0) & (F.get(rows, k)["letter"] != ""))

        def whole(at: Column) -> Column:
            stem = F.slice(rows, 2, F.coalesce(F.get(at, F.lit(0)), F.size(rows)) - 1)
            return F.struct(head["no"].alias("no"), squeeze(joined_lines(head["words"], stem)).alias("stem"), F.transform(cut_at(rows, at), sub).alias("subs"), F.lit(None).cast("string").alias("spec"))

        return bound(lettered, whole)

    def items(read: Column) -> Column:
        return bound(item_starts(read, 6), lambda starts: F.transform(cut_at(read, starts), item))

    return bound(read_once(lines(block), ESSAY_ITEM), items).cast(ESSAY_ITEMS)


def with_spec(block: Column, items: Column) -> Column:
    """The block's first specification goes to the first item that refers to one."""
    spec = F.trim(F.regexp_replace(F.regexp_extract(block, SPEC, 1), r"(?U)\s+", " "))
    there = F.rlike(block, F.lit(SPEC))

    def refers(i: Column) -> Column:
        return F.rlike(i["stem"], F.lit(SPEC_REFERENCE)) | F.exists(i["subs"], lambda s: F.rlike(s["v"], F.lit(SPEC_REFERENCE)))

    def attached(own: Column) -> Column:
        def given(first: Column) -> Column:
            return F.transform(own, lambda i: F.struct(i["no"].alias("no"), i["stem"].alias("stem"), i["subs"].alias("subs"), F.when(there & (i["no"] == first), spec).alias("spec")))

        return bound(F.get(F.filter(own, refers), F.lit(0))["no"], given)

    return bound(items, attached).cast(ESSAY_ITEMS)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fallback_groups(text: Column) -> Column:
    """Blocks of a text without notices: lines after the first ``1 - 1``, a new block at every ``1. ``, three at most."""
    rest = F.coalesce(F.get(F.split(text, "1 - 1", 2), F.lit(1)), text)

    def groups(own: Column) -> Column:
        places = F.filter(F.transform(own, lambda _, k: k), lambda k: (k == 0) | F.rlike(F.get(own, k), F.lit(r"(?U)^1\.\s")))
        return bound(places, lambda starts: F.transform(F.slice(cut_at(own, starts), 1, 3), lambda piece: F.array_join(piece, "\n")))

    return bound(lines(rest), groups)


def structured(papers: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(round, year, source, gyosi_estimated, period1, essay, error) and the columns ``keep`` of papers (source, text).

    Papers are dealt out evenly and parsed once, into the shared folder: left to Spark, every filter and every use of the
    questions would repeat the folds, in as few tasks as small texts give.

    A paper without a round in its name, or with less than 500 characters, has an error and no questions; it never
    stops the others.
    """
    text = F.col("text")
    rows = papers.select("source", "text", *keep).repartition(4 * papers.sparkSession.sparkContext.defaultParallelism).withColumns(
        {
            "round": F.regexp_extract("source", r"(?U)(\d+)\s*회", 1).try_cast("int"),
            "year": F.nullif(F.regexp_extract("source", r"(?U)\((\d{4})년\)", 1), F.lit("")),
            "gyosi_estimated": ~F.rlike(text, F.lit(PERIOD_MARK)),
        }
    )
    error = F.when(F.col("round").isNull(), F.lit("no round in the name")).when(F.coalesce(F.length("text"), F.lit(0)) < 500, F.lit("too little text"))
    rows = rows.withColumn("error", error)
    good = F.col("error").isNull()
    pieces = F.split(text, ESSAY_HEAD)
    noted = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda b, i: F.struct((i + 2).alias("gyosi"), with_spec(b, essay_items(b)).alias("items")))
    plain = F.transform(fallback_groups(text), lambda b, i: F.struct((i + 2).alias("gyosi"), essay_items(b).alias("items")))
    return cut(rows.select(
        "round", "year", "source", "gyosi_estimated",
        F.when(good, short_items(text)).alias("period1"),
        F.when(good, F.when(F.size(pieces) > 1, noted).otherwise(plain)).alias("essay"),
        "error", *keep,
    ))


def failures(papers: DataFrame) -> DataFrame:
    """(source, reason) of the papers that gave no questions."""
    return papers.filter(F.col("error").isNotNull()).select("source", F.col("error").alias("reason"))


def outcome(papers: DataFrame, strict: bool = False) -> DataFrame:
    """One row: papers, failed, warned, and ``ok``: nothing failed and, if ``strict``, nothing was warned of."""
    warned = summary(papers).agg(F.count_if(F.col("status") != "정상").alias("warned")).withColumn("_one", F.lit(1))
    counts = papers.agg(F.count_if(F.col("error").isNull()).alias("papers"), F.count_if(F.col("error").isNotNull()).alias("failed")).withColumn("_one", F.lit(1))
    ok = (F.col("failed") == 0) & ((F.col("warned") == 0) | F.lit(not strict))
    return counts.join(warned, "_one").select("papers", "failed", "warned", ok.alias("ok"))


def last_wins(papers: DataFrame, order: str) -> DataFrame:
    """One row for each round: the one that comes last in ``order``."""
    by = Window.partitionBy("round").orderBy(F.desc(order))
    return papers.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def questions(papers: DataFrame) -> DataFrame:
    """One row for each item: (round, gyosi, no, stem, subs, spec)."""
    short = papers.select("round", F.lit(1).alias("gyosi"), F.inline("period1")).select("round", "gyosi", "no", F.col("text").alias("stem"), F.array().cast(SUBS).alias("subs"), F.lit(None).cast("string").alias("spec"))
    blocks = papers.select("round", F.inline("essay"))
    return short.unionByName(blocks.select("round", "gyosi", F.inline("items")))


def question_filter(items: DataFrame, gyosi: int | None, term: str) -> DataFrame:
    """Items of a period that contain the term in stem or sub-items, without regard to case; blank finds all."""
    blob = F.lower(F.concat_ws(" ", "stem", F.array_join(F.transform("subs", lambda s: s["v"]), " ")))
    out = items.filter(F.contains(blob, F.lit(term.strip().lower())))
    return out if gyosi is None else out.filter(F.col("gyosi") == gyosi)


def summary(papers: DataFrame) -> DataFrame:
    """Counts and notes of each paper: (round, label, year, p1, essay_counts, total, status)."""
    counts = F.transform("essay", lambda b: F.size(b["items"]))
    p1 = F.size("period1")
    notes = F.concat(
        F.when(p1 != EXPECTED[0], F.array(F.concat(F.lit("1교시 "), p1.cast("string"), F.lit("문항")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("essay") != EXPECTED[1], F.array(F.concat(F.lit("논술형 "), F.size("essay").cast("string"), F.lit("개 교시")))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter("essay", lambda b: F.size(b["items"]) != EXPECTED[2]), lambda b: F.concat(b["gyosi"].cast("string"), F.lit("교시 "), F.size(b["items"]).cast("string"), F.lit("문항"))),
    )
    shown = F.array_join(F.transform(counts, lambda c: c.cast("string")), " · ")
    return papers.filter(F.col("period1").isNotNull()).select(
        "round",
        F.concat(F.col("round").cast("string"), F.lit("회"), F.when(F.col("gyosi_estimated"), F.lit(" (추정)")).otherwise(F.lit(""))).alias("label"),
        F.coalesce("year", F.lit("—")).alias("year"),
        p1.alias("p1"),
        F.when(F.size("essay") == 0, F.lit("—")).otherwise(shown).alias("essay_counts"),
        (p1 + F.aggregate(counts, F.lit(0), lambda a, c: a + c)).alias("total"),
        F.when(F.size(notes) == 0, F.lit("정상")).otherwise(F.concat(F.lit("⚠ "), F.array_join(notes, ", "))).alias("status"),
    )


def totals(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.count("*").alias("papers"), F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("items"), F.count_if(F.col("status") != "정상").alias("warned"))
