"""Reports as text: small results only, rendered from rows that the operators have summed up."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.operators import papers


#: The texts of the reports.
NO_PAPERS = """## 기출문제 처리 결과

**처리할 문제지가 없다.**

`exam/papers/` 에 PDF 나 HWP 를 올리면 그 순간 이 작업이 다시 돌면서 여기에 회차별 표가 채워진다. 파일명에 `NNN회` 가 들어 있어야 회차를 인식한다.
"""
SUMMARY_TAIL = """
결과물: `exam/out/questions.json` (기계용) · `exam/out/index.html` (열람용).
`(추정)` 은 문제지에 교시 번호가 없어 수록 순서로 본 회차다."""
ESTIMATED = '<footer>교시 표기가 없는 문제지 {}개는 수록 순서를 교시 순서로 보았고 <span class="est">추정</span> 으로 표시했다.</footer>'
SHORT_TITLE = "1교시 단답형 · 13문제 중 10문제 선택 · 각 10점"
ESSAY_TITLE = "{}교시{} · 6문제 중 4문제 선택 · 각 25점"
SUMMARY_HEAD = "## 기출문제 처리 결과\n\n**{}개 회차 · {}문항**"
SUMMARY_WARNED, SUMMARY_CLEAN = " · 경고 {}개 회차", " · 경고 없음"
SUMMARY_COLUMNS = ["| 회차 | 시행 | 1교시 | 논술형(교시별) | 합계 | 상태 |", "|---|---|---|---|---|---|"]
PAGE_TOTALS = '<p class="sub">{}개 회차 · 1교시 {}문항 + 논술형 {}문항 = 총 {}문항</p>'
PAGE_TITLE = "<h1>{}</h1>"
SECTION, YEAR = '<section class="paper" data-group="r{0}"><h2>제{0}회<span class="meta">{1} · {2}</span></h2>', " · {}년"
GUESSED = '<span class="est">추정</span>'
PERIOD = '<div class="gy">{}</div>'
ITEM = '<li data-g="{}" data-t="{}">{}{}{}</li>'
SUBS, SUB = "<span class=subs>{}</span>", "<span><b>{}.</b> {}</span>"
SPEC = '<span class="spec">[명세] {}</span>'
PAGE_BAR = (
    '<div class="bar"><input type="search" id="q" placeholder="문항 검색 (예: RAG, 가명처리)">'
    '<select id="gy"><option value="all">전체 교시</option><option value="1">1교시</option><option value="2">2교시</option>'
    '<option value="3">3교시</option><option value="4">4교시</option></select><span class="count" id="count"></span></div>'
)
PAGE_FRAME = (
    '<!doctype html>\n<html lang="ko">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n'
    "<title>{title}</title>\n<style>{style}</style>\n</head>\n<body>\n<div class=\"wrap\">\n{body}\n</div>\n<script>{script}</script>\n</body>\n</html>\n"
)

#: The page's own look and filter: items of a period that hold the term, and how many of all these are.
STYLE = "body{font:16px/1.6 sans-serif}.wrap{max-width:52rem;margin:auto}.bar{position:sticky;top:0;background:#fff}.subs span{display:block}"
SCRIPT = """
const term = document.getElementById("q"), period = document.getElementById("gy"), count = document.getElementById("count");
const items = [...document.querySelectorAll("li[data-g]")];
function show() {
  const wanted = term.value.trim().toLowerCase();
  for (const item of items) item.hidden = !(["all", item.dataset.g].includes(period.value) && item.dataset.t.includes(wanted));
  count.textContent = items.filter(item => !item.hidden).length + " / " + items.length;
  for (const part of document.querySelectorAll("section")) part.hidden = !part.querySelector("li:not([hidden])");
}
for (const input of [term, period]) input.addEventListener("input", show);
show();
"""


def summary_lines(summaries: DataFrame) -> DataFrame:
    """(round, line): each row of ``papers.summary`` as a row of the table."""
    cells = F.concat_ws(" | ", "label", "year", F.col("p1").cast("string"), "essay_counts", F.col("total").cast("string"), "status")
    return summaries.select("round", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def summary_markdown(structured: DataFrame, to: str | None = None) -> str:
    """The table of all papers by round, with totals; one row for each paper. ``to`` names a file to append it to."""
    rows = papers.summary(structured)
    t = papers.totals(rows).first()
    if t["papers"]:
        head = SUMMARY_HEAD.format(t["papers"], t["items"]) + (SUMMARY_WARNED.format(t["warned"]) if t["warned"] else SUMMARY_CLEAN)
        body = [r["line"] for r in summary_lines(rows).orderBy("round").select("line").collect()]
        text = "\n".join([head, "", *SUMMARY_COLUMNS, *body, SUMMARY_TAIL, ""])
    else:
        text = NO_PAPERS
    if to:
        with open(to, "a", encoding="utf-8") as f:
            f.write(text)
    return text


def questions_html(structured: DataFrame, title: str, gyosi: int | None = None, term: str = "") -> str:
    """A page of questions, the newest round first; for the few papers that a page can show.

    ``gyosi`` and ``term`` keep the items that ``papers.question_filter`` finds; papers without one stay with their title.
    """
    good = structured.filter(F.col("error").isNull())
    heads = {r["round"]: r for r in good.select("round", "year", "source", "gyosi_estimated").orderBy(F.desc("round")).collect()}
    items = papers.question_filter(papers.questions(good), gyosi, term).orderBy(F.desc("round"), "gyosi", "no").collect()
    short = sum(r["gyosi"] == 1 for r in items)
    out = [PAGE_TITLE.format(html.escape(title)), PAGE_TOTALS.format(len(heads), short, len(items) - short, len(items)), PAGE_BAR]
    for no, head in heads.items():
        year = YEAR.format(head["year"]) if head["year"] else ""
        out.append(SECTION.format(no, year, html.escape(head["source"])))
        mark = GUESSED if head["gyosi_estimated"] else ""
        own = [r for r in items if r["round"] == no]
        for period in sorted({r["gyosi"] for r in own}):
            out.append(PERIOD.format(SHORT_TITLE if period == 1 else ESSAY_TITLE.format(period, mark)))
            out.append("<ol>" + "".join(_item(r) for r in own if r["gyosi"] == period) + "</ol>")
        out.append("</section>")
    estimated = sum(h["gyosi_estimated"] for h in heads.values())
    return "\n".join([*out, *([ESTIMATED.format(estimated)] if estimated else [])])


def questions_page(structured: DataFrame, title: str, gyosi: int | None = None, term: str = "") -> str:
    """``questions_html`` as a page of its own, with its look and a filter that counts what it shows."""
    return PAGE_FRAME.format(title=html.escape(title), style=STYLE, body=questions_html(structured, title, gyosi, term), script=SCRIPT)


def _item(r) -> str:
    subs = "".join(SUB.format(html.escape(s["k"]), html.escape(s["v"])) for s in r["subs"])
    found_by = html.escape(" ".join([r["stem"], *(s["v"] for s in r["subs"])]).lower(), quote=True)
    return ITEM.format(r["gyosi"], found_by, html.escape(r["stem"]), SUBS.format(subs) if subs else "", SPEC.format(html.escape(r["spec"])) if r["spec"] else "")


def dup_report(groups: DataFrame, shown: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first groups (0: all), with the start of their hash, and totals over all groups."""
    first = groups.orderBy("group_no").limit(shown) if shown else groups.orderBy("group_no")
    return first.withColumn("hash", F.substring("hash", 1, 12)), groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))


def dup_errors(quick: DataFrame, shown: int = 5) -> DataFrame:
    """Paths of the first files that ``dup.with_quick`` could not read."""
    return quick.filter(F.col("quick").isNull()).orderBy("path").limit(shown).select("path")
