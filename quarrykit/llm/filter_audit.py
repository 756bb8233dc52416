"""What the order of a chain of document filters changes: an audit over sorted posting lists.

Every document fails some of five filters. Per part (a language) and filter, the ids that fail are a sorted posting
list, cut into ranges of ids: Spark deals the failing documents out by ranges of ``doc_id`` and puts each range in
order, and a task builds the lists of its range. The union of every set of filters comes from a k-way merge, one list
at a time, that gallops through the longer list (doubling steps until it is past a block of the shorter one, then a
binary search within that step); differences of such unions are what a filter removes after others. Only sizes leave a
task, 31 for each part, and are summed. All 120 orders of the filters follow from those sums.

Filters: A under 100 words, B fewer than 80 distinct words of 100, C more than 10 capitals A-Z of 100 code points,
D a symbol of ``#$%&*|``, E a text that a smaller doc_id has too.

Defined cases: a null text counts as empty; a null language is the part with the empty name; rows with equal doc_id
are documents of their own (E needs a truly smaller id); a row with a null doc_id never fails E, and its text makes no
other row fail it; a document is good (toxic) if any row of ``labels`` for its id says 1, so repeated or null label
rows add nothing; an empty table gives an empty result; other columns are ignored, whatever their names. Texts of any
length are read whole, in the JVM; only ids, flags and counts are shuffled.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import LOWER, UPPER, cut

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
ALL = (1 << len(FILTERS)) - 1
#: Texts that at least so many thousandths of all rows have are joined by broadcast: there are a thousand at most.
HOT_SHARE = 1000
#: Rows of a range that a task merges at a time.
RANGE_ROWS = 1 << 18


def failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails, by built-in functions."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    tests = {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals.cast("long") > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}
    return sum((F.when(t, BIT[f]).otherwise(0) for f, t in tests.items()), F.lit(0))


def flagged(docs: DataFrame) -> DataFrame:
    """(part, doc_id, mask): each document with the bits of the filters that it fails.

    One pass over the texts leaves flags and a hash of each text. Copies are told by that hash: of a text that many
    rows have, the smallest id is sent to the rows, of any other it is joined by the hash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), failures(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    rows = cut(rows)
    least = rows.count() / HOT_SHARE
    first = rows.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = cut(first)
    hot = F.broadcast(first.filter(F.col("n") >= least).select("sha", "first"))
    cold = first.filter(F.col("n") < least).select("sha", "first")
    copies = rows.join(hot, "sha").unionByName(rows.join(hot, "sha", "left_anti").join(cold, "sha", "left"))
    return copies.select("part", "doc_id", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), BIT["E"]).otherwise(0)).alias("mask"))


def gallop(left: np.ndarray, right: np.ndarray, block: int = 512) -> np.ndarray:
    """Which elements of ``left`` are in ``right``; both ascending, without repeats.

    Block by block of ``left``: steps double from where the last block ended in ``right`` until they are past the
    block, and only that stretch is searched.
    """
    found = np.zeros(len(left), bool)
    low = 0
    for at in range(0, len(left), block):
        part = left[at : at + block]
        step = block
        while low + step < len(right) and right[low + step] < part[-1]:
            step *= 2
        stretch = right[low : low + step + 1]
        where = np.searchsorted(stretch, part)
        inside = where < len(stretch)
        found[at : at + block][inside] = stretch[where[inside]] == part[inside]
        low += int(where[-1])
        if low >= len(right):
            break
    return found


def merged(union: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The union of two ascending lists: what the longer one lacks is put in its place."""
    if len(union) < len(other):
        union, other = other, union
    new = other[~gallop(other, union)]
    return np.insert(union, np.searchsorted(union, new), new) if len(new) else union


def union_sizes(lists: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """For every set of lists (by its bits) the sums of ``weights`` (rows: positions) over the union of the lists."""
    out = np.zeros((1 << len(lists), weights.shape[1]), np.int64)

    def grow(first: int, bits: int, union: np.ndarray) -> None:
        for k in range(first, len(lists)):
            more = merged(union, lists[k])
            out[bits | 1 << k] = weights[more].sum(0)
            grow(k + 1, bits | 1 << k, more)

    grow(0, 0, np.zeros(0, np.int64))
    return out


def posting_sizes(entries: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): sizes of the unions of each part's lists; the empty set is left out.

    ``entries`` has (part, doc_id, mask, n, good, toxic), one row for each distinct (part, doc_id, mask).
    """

    def run(batches):
        total: dict[str, np.ndarray] = {}
        held: list[pa.RecordBatch] = []

        def merge():
            table = pa.Table.from_batches(held)
            held.clear()
            codes = table["part"].combine_chunks().dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            mask = table["mask"].to_numpy()
            weights = np.stack([table[c].to_numpy() for c in ("n", "good", "toxic")], 1)
            order = np.argsort(code, kind="stable")  # each part's rows stay in the order of their ids
            for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                lists = [np.flatnonzero(mask[rows] & 1 << k) for k in range(len(FILTERS))]
                name = names[code[rows[0]]]
                total[name] = total.get(name, 0) + union_sizes(lists, weights[rows])

        def sums():
            parts = [p for p in total for _ in range(ALL)]
            sizes = np.concatenate([total[p][1:] for p in total])
            bits = np.tile(np.arange(1, ALL + 1), len(total))
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(bits, pa.int32()), *(pa.array(c) for c in sizes.T)], names=["part", "bits", "n", "good", "toxic"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= RANGE_ROWS:
                merge()
                if len(total) > 4096:
                    yield sums()
        if held:
            merge()
        if total:
            yield sums()

    ranged = entries.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "mask")
    sizes = ranged.mapInArrow(run, "part string, bits int, n long, good long, toxic long")
    return sizes.groupBy("part", "bits").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic): each labelled id once."""
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step in it."""
    rows = cut(flagged(docs).groupBy("part", "doc_id", "mask").agg(F.count("*").alias("n")))
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    known = rows.filter("mask != 0").join(labelled(labels), "doc_id", "left")
    times = lambda c: (F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    sizes = posting_sizes(known.select("part", "doc_id", "mask", "n", times("good"), times("toxic")))
    # 31 sizes for each part
    unions = sizes.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("bits", F.struct("n", "good", "toxic").alias("s")))).alias("unions"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = totals.join(unions, "part", "left").select("part", "total", "unions", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit = F.element_at(F.create_map(*(F.lit(x) for pair in BIT.items() for x in pair)), letter)
    before = sum((F.when(F.instr(F.col("filter_order"), f) < F.col("step"), b).otherwise(0) for f, b in BIT.items()), F.lit(0))
    steps = steps.withColumns({"filter": letter, "bit": bit, "before": before}).withColumn("after", F.col("before") + F.col("bit"))

    def size(bits: Column, c: str = "n") -> Column:
        return F.coalesce(F.get(F.map_values(F.map_filter("unions", lambda k, _: k == bits)), F.lit(0))[c], F.lit(0))

    gain = lambda c: size(F.col("after"), c) - size(F.col("before"), c)
    out = steps.select(
        "part", "filter_order", "step", "filter",
        (F.col("total") - size(F.col("after"))).alias("kept"),
        gain("n").alias("removed"),
        (size(F.col("bit")) - gain("n")).alias("redundant"),
        (size(F.lit(ALL)) - size(F.lit(ALL) - F.col("bit"))).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
    )
    value = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(value, ["part", "filter"]).select(*(c for c in out.columns if c != "filter"), "shapley")
