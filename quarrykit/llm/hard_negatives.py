"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

Rows are (id, label, v) with whole numbers in v. An anchor's positives are its ``positives`` best other rows of the
same label; a positive's negatives are the ``negatives`` best rows of other labels whose score lies in a window below
the positive's. Both are threshold joins: each anchor has a threshold, and asks for all rows with at least that score.

Rows lie in blocks of rows of about equal norm. A block keeps posting lists by groups of dimensions, those that carry
most of its rows' norm first: a row is listed in a group only if the norm of what it has from there on could still
lift an anchor over its threshold, all others end earlier. An anchor adds up partial scores group by group and drops
what cannot reach the threshold with the norms that remain; where few pairs are left, or a row's list ended, the pair
is scored exactly. Blocks whose largest norm is too small are not asked at all. Anchors whose window is not full ask
again with a lower threshold; the last one takes everything, so results are exact. A block hands on at most the best of
an anchor and window; the best of all blocks are taken by Spark.

Rows stay where they are: anchors (a fixed share of the rows) are sent past the blocks in batches, no pair of rows is
ever shuffled, and neither rows nor anchors meet in the driver. What it collects is one row for each quarter power of
two among the norms.

Defined cases: rows with a null id, label or vector, or with a null, NaN or infinite component, take no part; vectors
may be zero or empty (score 0), and of different lengths the missing components count as 0; equal rows count once; rows
with one id and different contents are rows of their own; ties go to the smaller id; an anchor without positives, and a
positive without negatives, gives no rows; a positive score below zero has an empty window. Scores are exact beyond
2^53 too; those beyond the range of a long are cut to it. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import cut, scratch

#: Dimensions whose postings are kept and added up together.
GROUP = 8
#: Anchors that are scored at a time, and rows of a block, at most on average.
BATCH, BLOCK_ROWS = 128, 16_384
LONGS = np.iinfo(np.int64)
FOUND = "anchor long, slot int, id long, score long"


class Block:
    """Posting lists of some rows by groups of dimensions, with the norms of what follows in each row."""

    def __init__(self, x: np.ndarray, order: np.ndarray):
        """x: whole numbers (rows, dimensions); order: the dimensions, those with the largest sum of squares first."""
        self.exact = x
        self.order = order
        self.x = x[:, order].astype(np.float64)
        self.cuts = [*range(0, x.shape[1], GROUP), x.shape[1]] if x.shape[1] else [0, 0]
        self.rest = self.norms(self.x)
        self.largest = float(np.abs(self.x).max(initial=0))

    def norms(self, y: np.ndarray) -> np.ndarray:
        """The norms of rows from each group of dimensions on."""
        tails = np.cumsum((y**2)[:, ::-1], 1)[:, ::-1]
        tails = np.concatenate([tails, np.zeros((len(y), 1))], 1)
        return np.sqrt(tails[:, self.cuts])

    def at_least(self, asked: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the anchor, row, score) of all pairs whose score is at least the anchor's threshold."""
        q = asked[:, self.order].astype(np.float64)
        rest = self.norms(q)
        top = rest.max(0, initial=0)
        # rounding never drops a pair: bounds are compared with a little less than the threshold
        t = least - 1e-9 * rest[:, 0] * self.rest[:, 0].max(initial=0)
        lowest = t.min(initial=math.inf)
        rows, total = np.arange(len(self.x)), np.zeros((len(q), len(self.x)))
        pairs = []
        for c, (at, to) in enumerate(zip(self.cuts, self.cuts[1:])):
            listed = self.rest[rows, c] * top[c] >= lowest
            if not listed.all():
                ended = rows[~listed]
                a, r = np.nonzero(total[:, ~listed] + rest[:, c, None] * self.rest[ended, c] >= t[:, None])
                pairs.append((a, ended[r]))
                rows, total = rows[listed], total[:, listed]
            total += q[:, at:to] @ self.x[rows, at:to].T
            alive = total + rest[:, c + 1, None] * self.rest[rows, c + 1] >= t[:, None]
            some = alive.any(0)
            rows, total, alive = rows[some], total[:, some], alive[:, some]
            if not len(rows) or np.count_nonzero(alive) * 32 < alive.size:
                break
        if len(rows):
            a, r = np.nonzero(alive)
            pairs.append((a, rows[r]))
        a, r = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        scores = self.scores(asked, a, r)
        enough = scores >= least[a]
        return a[enough], r[enough], scores[enough]

    def scores(self, asked: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        fits = float(np.abs(asked.astype(np.float64)).max(initial=0)) * self.largest * max(self.x.shape[1], 1) < 2**53
        for at in range(0, len(a), 1 << 15):
            i, j = a[at : at + (1 << 15)], r[at : at + (1 << 15)]
            if fits:
                out[at : at + len(i)] = np.einsum("ij,ij->i", asked[i].astype(np.float64), self.exact[j].astype(np.float64))
            else:
                sums = (asked[i].astype(object) * self.exact[j].astype(object)).sum(1)
                out[at : at + len(i)] = [min(max(int(s), LONGS.min), LONGS.max) for s in sums]
        return out


def first_of(a: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of each anchor: larger score, then smaller id."""
    order = np.lexsort((ids, ~scores, a))  # ~s falls as s grows, without an overflow
    sorted_a = a[order]
    starts = np.flatnonzero(np.append(True, sorted_a[1:] != sorted_a[:-1])) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    return order[rank < n]


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists as whole numbers, short lists filled up with 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    if len(flat):
        rows = np.repeat(np.arange(len(column)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def bounds(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole scores s with low * p <= 100 * s <= high * p; none where p is below zero."""
    p = positive.astype(object)
    least = np.array([min(-((-low * int(x)) // 100), LONGS.max) for x in p], np.int64)
    most = np.array([min((high * int(x)) // 100, LONGS.max) if x >= 0 else LONGS.min for x in p], np.int64)
    return least, most


class Finder:
    """What a task does: takes the rows of a block, then batches of anchors, and gives the best pairs of each."""

    def __init__(self, width: int, positives: int, negatives: int, low: int, high: int):
        self.width, self.positives, self.negatives, self.low, self.high = width, positives, negatives, low, high

    def build(self, batches: list) -> None:
        rows = pa.Table.from_batches(batches)
        x = matrix(rows["v"].combine_chunks(), self.width)
        self.key, self.id, self.label = (rows[c].to_numpy() for c in ("key", "id", "label"))
        order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
        self.whole, self.x, self.order, self.by_label = Block(x, order), x, order, {}

    def of_label(self, label: int) -> tuple[Block, np.ndarray]:
        if label not in self.by_label:
            rows = np.flatnonzero(self.label == label)
            self.by_label[label] = Block(self.x[rows], self.order), rows
        return self.by_label[label]

    def same(self, part) -> list[tuple]:
        """The best rows of the anchor's own label, the anchor left out."""
        key, label, t = (part[c].to_numpy(zero_copy_only=False) for c in ("key", "label", "t"))
        q, out = matrix(part["v"], self.width), []
        for one in np.unique(label):
            mine = np.flatnonzero(label == one)
            block, rows = self.of_label(one)
            if not len(rows):
                continue
            a, r, s = block.at_least(q[mine], t[mine])
            a, r = mine[a], rows[r]
            other = self.key[r] != key[a]
            a, r, s = a[other], r[other], s[other]
            best = first_of(a, s, self.id[r], self.positives)
            out.append((key[a[best]], np.zeros(len(best), np.int32), self.id[r[best]], s[best]))
        return out

    def others(self, part) -> list[tuple]:
        """The best rows of other labels in the window of each positive."""
        key, label, t = (part[c].to_numpy(zero_copy_only=False) for c in ("key", "label", "t"))
        a, r, s = self.whole.at_least(matrix(part["v"], self.width), t)
        differ = self.label[r] != label[a]
        a, r, s = a[differ], r[differ], s[differ]
        slots = part["windows"]
        sizes, flat, out = np.diff(slots.offsets.to_numpy()), slots.flatten(), []
        owner = np.repeat(np.arange(len(sizes)), sizes)
        slot, positive = (flat.field(c).to_numpy() for c in ("slot", "score"))
        least, most = bounds(positive, self.low, self.high)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for k in range(int(sizes.max(initial=0))):
            here = np.flatnonzero(place == k)
            window = np.full(len(sizes), -1)
            window[owner[here]] = here
            w = window[a]
            fits = np.flatnonzero((w >= 0) & (s >= least[w]) & (s <= most[w]))
            best = fits[first_of(a[fits], s[fits], self.id[r[fits]], self.negatives)]
            out.append((key[a[best]], slot[w[best]], self.id[r[best]], s[best]))
        return out


class Index:
    """The rows in blocks, written once; ``ask`` sends anchors past them."""

    def __init__(self, rows: DataFrame, finder: dict):
        """rows: (id, label, v); each distinct row is one."""
        self.spark, self.finder = rows.sparkSession, finder
        at = scratch(self.spark, "rows")
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
        rows = rows.select("id", "label", "v").distinct().withColumn("norm", norm)
        level = F.when(F.col("norm") > 0, F.floor(4 * F.log2("norm"))).otherwise(-1)
        rows.withColumn("level", level.cast("int")).withColumn("key", F.monotonically_increasing_id()).write.parquet(at)
        stored = self.spark.read.parquet(at)
        # quarter powers of two up to the largest norm of whole numbers: some hundred rows at most
        levels = stored.groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.max(F.size("v")).alias("width")).orderBy("level").collect()
        self.width = max((x.width for x in levels), default=0)
        tasks = 4 * self.spark.sparkContext.defaultParallelism
        room = min(max(sum(x.n for x in levels) // tasks, 512), BLOCK_ROWS)
        self.levels, first = [], 0
        for x in levels:
            parts = math.ceil(x.n / room)
            self.levels.append((x.level, first, parts, x.top))
            first += parts
        self.blocks = max(first, 1)
        block = F.lit(0)
        for level, start, parts, _ in self.levels:
            block = F.when(F.col("level") == level, start + F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(block)
        self.rows = stored.withColumn("block", block.cast("int")).drop("level")

    def ask(self, asked: DataFrame, kind: str) -> DataFrame:
        """``asked``: (key, label, v, norm, t, windows); (anchor, slot, id, score), the best of each block."""
        empty = F.array().cast("array<int>")
        reach = [F.when(F.col("norm") * top * (1 + 1e-9) >= F.col("t"), F.sequence(F.lit(first), F.lit(first + parts - 1))).otherwise(empty) for _, first, parts, top in self.levels]
        anchors = asked.select(F.explode(F.flatten(F.array(empty, *reach))).alias("block"), F.lit(1).alias("kind"), "key", F.lit(None).cast("long").alias("id"), "label", "v", "t", "windows")
        rows = self.rows.select("block", F.lit(0).alias("kind"), "key", "id", "label", "v", F.lit(None).cast("double").alias("t"), F.lit(None).cast("array<struct<slot:int,score:long>>").alias("windows"))
        width, options = self.width, self.finder

        def run(batches):
            finder, held, block, built = Finder(width, **options), [], None, False
            for batch in batches:
                codes = batch["block"].to_numpy() * 2 + batch["kind"].to_numpy()
                for part in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(codes)) + 1):
                    if not len(part):
                        continue
                    piece, (own, is_anchor) = batch.slice(part[0], len(part)), divmod(int(codes[part[0]]), 2)
                    if own != block:
                        held, block, built = [], own, False
                    if not is_anchor:
                        held.append(piece)
                        continue
                    if held:
                        finder.build(held)
                        held, built = [], True
                    for at in range(0, piece.num_rows if built else 0, BATCH):
                        for found in getattr(finder, kind)(piece.slice(at, BATCH)):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "slot", "id", "score"])

        both = rows.unionByName(anchors).repartition(self.blocks, "block").sortWithinPartitions("block", "kind")
        return both.mapInArrow(run, FOUND)


def best(found: DataFrame, n: int) -> DataFrame:
    """The first n of each anchor and slot, with their ``rank``."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, starts: tuple = (0.5, 0.25), drops: tuple = (0.125, 0.5)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: (id, label, v) with whole numbers in v; anchors are the rows whose id is divisible by ``every``.
    ``starts`` are the thresholds of the search for positives, as shares of the largest score that norms allow;
    ``drops`` those for negatives, as shares of the way from the top of the lowest window to its end. After them
    everything is asked for.
    """
    index = Index(vectors, {"positives": positives, "negatives": negatives, "low": low, "high": high})
    anchors = index.rows.filter(F.col("id") % every == 0).select("key", "id", "label", "v", "norm")
    top = max((x[3] for x in index.levels), default=0.0)
    none = F.lit(None).cast("array<struct<slot:int,score:long>>").alias("windows")
    open_, near = anchors.select("key"), None
    for share in (*starts, None):
        least = F.lit(-math.inf) if share is None else F.col("norm") * (share * top)
        asked = anchors.join(open_, "key").select("key", "label", "v", "norm", least.alias("t"), none)
        found = cut(best(index.ask(asked, "same"), positives))
        full = found.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= (0 if share is None else positives)).select(F.col("anchor").alias("key"))
        whole = found.join(full, F.col("anchor") == F.col("key"), "left_semi")
        near = whole if near is None else near.unionByName(whole)
        open_ = cut(open_.join(full, "key", "left_anti"))
        if share is None or not open_.limit(1).count():
            break
    near = cut(near.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows, lists = near.filter("positive_score >= 0").select("anchor", "slot", "positive_score"), None
    for share in (*drops, 1.0):
        open_ = windows.groupBy("anchor").agg(F.collect_list(F.struct("slot", F.col("positive_score").alias("score"))).alias("windows"), F.min("positive_score").cast("double").alias("p"))
        least = (high - share * (high - low)) / 100 * (1 - 1e-9) * F.col("p")
        asked = anchors.join(open_, F.col("key") == F.col("anchor")).select("key", "label", "v", "norm", least.alias("t"), "windows")
        found = cut(best(index.ask(asked, "others"), negatives))
        full = found.groupBy("anchor", "slot").agg(F.count("*").alias("n")).filter(F.col("n") >= (0 if share == 1 else negatives)).select("anchor", "slot")
        whole = found.join(full, ["anchor", "slot"], "left_semi").select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        lists = whole if lists is None else lists.unionByName(whole)
        windows = cut(windows.join(full, ["anchor", "slot"], "left_anti"))
        if share == 1 or not windows.limit(1).count():
            break
    names = anchors.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id"))
    out = near.join(lists, ["anchor", "slot"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v): the rows that take part, v as the floors of the scaled components."""
    v = F.col(vector_col).cast("array<double>")
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), v.alias("v")).filter("id is not null and label is not null and v is not null")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    return x.filter(finite).withColumn("v", F.transform("v", lambda c: F.floor(scale * c).cast("long")))
