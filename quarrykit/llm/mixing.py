"""Mixing sources to target weights by temperature.

A source's share p of all tokens becomes the weight p**a / Z. The exponent a is bisected between 0 (even) and 1
(as found): to the largest a whose weights reach the target entropy (as a share of the largest possible), and to
the smallest a at which no source is read more often than ``repeats`` times; the larger of both is used. The budget
is the smallest number of tokens with which every source is read at least once, unless given.

A source's documents are dealt into hashed blocks of about ``block_tokens``. An epoch is a permutation of the
blocks, and inside each block of its documents, both in the order of a seeded hash. Whole epochs take everything;
the last one takes blocks until the source's budget is spent, and the block in which it ends document by document
(the document that crosses the budget is taken). So no task ever holds a whole source.

Defined cases: a null source is a source of its own; null or empty texts have no tokens, and are dealt like others;
an empty table gives an empty result; equal rows (id and text) are drawn
together; texts of any length count whole; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import cut, scratch

GRID = 32


def tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def narrowed(at: dict[float, float], target: float) -> tuple[float, float]:
    """The neighbours in the grid between which a falling function crosses the target."""
    grid = sorted(at)
    low = max((a for a in grid if at[a] >= target), default=grid[0])
    return low, next((a for a in grid if a > low), grid[-1])


def entropies(shares: DataFrame, grid: list[float]) -> dict[float, float]:
    """The entropy of the weights at each exponent, over all sources at once."""
    z = [F.sum(F.pow("p", F.lit(a))) for a in grid]
    y = [F.sum(F.pow("p", F.lit(a)) * F.log("p") * a) for a in grid]
    row = shares.agg(*[(F.log(zi) - yi / zi).alias(f"h{k}") for k, (zi, yi) in enumerate(zip(z, y))]).first()
    return dict(zip(grid, row))


def exponent(sources: DataFrame, entropy: float | None, repeats: float | None, precision: float = 1e-6) -> float:
    """The bisected exponent for sources (source, tokens) with tokens > 0; 1 if there is nothing to flatten."""
    total, most, least, n = sources.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count("*")).first()
    if not n or most == least:
        return 1.0
    out = 0.0
    if repeats is not None:  # a source is read (most / tokens) ** (1 - a) times: bisected in closed form
        out = max(0.0, 1 - math.log(max(1.0, repeats)) / math.log(most / least))
    if entropy is not None:
        shares = cut(sources.select((F.col("tokens") / F.lit(total)).alias("p")))
        low, high = 0.0, 1.0
        while high - low > precision:
            low, high = narrowed(entropies(shares, [low + (high - low) * k / GRID for k in range(GRID + 1)]), entropy * math.log(n))
        out = max(out, low)
    return out


def plan(rows: DataFrame, entropy: float | None = 0.95, repeats: float | None = 4.0, budget: int | None = None) -> DataFrame:
    """(source, docs, tokens, weight, quota): quota is the source's budget in tokens."""
    sources = cut(rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")))
    real = sources.filter("tokens > 0")
    a = exponent(real, entropy, repeats)
    total = real.agg(F.sum("tokens")).first()[0] or 1
    raw = sources.withColumn("raw", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(a))).otherwise(0.0))
    z, most = raw.agg(F.sum("raw"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("raw")))).first()
    spend = budget if budget is not None else (most or 0) * (z or 0)
    weight = F.col("raw") / F.lit(z or 1.0)
    return raw.select("source", "docs", "tokens", weight.alias("weight"), F.round(weight * F.lit(float(spend)), 3).alias("quota"))


def order(*parts: Column | str | int) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])


def row_key(docs: DataFrame, seed: int) -> Column:
    """The hash that orders rows; equal rows tie, and are then drawn together."""
    return order(seed, docs["doc_id"].cast("long"), docs["text"].cast("string"))


def count_tokens(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, tokens, _key) of every row, written once: all planning reads this and not the texts."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), tokens(docs["text"]).alias("tokens"), row_key(docs, seed).alias("_key"))
    return stored(rows, "tokens")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; Spark knows its size, and broadcasts it only if that is small."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


class Draw:
    """How often each row is drawn: decided from (source, tokens, _key) alone."""

    def __init__(self, rows: DataFrame, entropy: float | None = 0.95, repeats: float | None = 4.0, budget: int | None = None, block_tokens: int = 1 << 18, seed: int = 1):
        self.seed = seed
        whole = F.col("tokens") > 0
        blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).alias("blocks")
        epochs = F.when(whole, F.floor(F.col("quota") / F.col("tokens") + 1e-9)).otherwise(1).cast("int")
        quotas = plan(rows, entropy, repeats, budget).select(F.col("source").alias("_s"), "weight", "tokens", "quota", blocks, epochs.alias("epochs"))
        rest = F.when(whole, F.greatest(F.lit(0.0), F.col("quota") - F.col("epochs") * F.col("tokens"))).otherwise(F.lit(0.0))
        self.quotas = stored(quotas.withColumn("rest", rest).drop("tokens", "quota"), "quotas")
        dealt = self.dealt(rows.select("source", "tokens", "_key"))
        sums = dealt.groupBy("_s", "_block", "epochs", "rest").agg(F.sum("tokens").alias("held"))
        # a large source's blocks are dealt out by the start of their key: 256 ranges, and each range's sum before its own
        sums = sums.withColumn("_k", self.block_key("epochs")).withColumn("_r", F.shiftright("_k", 56))
        ranges = sums.groupBy("_s", "_r").agg(F.sum("held").alias("_held"))
        earlier = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(F.col("_s").alias("_rs"), F.col("_r").alias("_rr"), F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_begun"))
        sums = sums.join(ranges, F.col("_s").eqNullSafe(F.col("_rs")) & (F.col("_r") == F.col("_rr")))
        turn = Window.partitionBy("_s", "_r").orderBy("_k", "_block")
        left = (F.col("rest") - (F.col("_begun") + F.sum("held").over(turn) - F.col("held"))).alias("left")  # of the budget, where the block begins
        ranked = stored(sums.select(F.col("_s").alias("_bs"), F.col("_block").alias("_b"), "held", left), "blocks")
        partly = self.placed(dealt, ranked.filter("left > 0 and left < held"))
        inside = Window.partitionBy("_s", "_block").orderBy(self.draw_key("epochs")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        taken = partly.withColumn("_before", F.sum("tokens").over(inside) - F.col("tokens")).filter("_before < left")
        ends = taken.groupBy("_s", "_block").agg(F.max(self.draw_key("epochs")).alias("_end"))
        ends = ends.select(F.col("_s").alias("_es"), F.col("_block").alias("_eb"), "_end")
        same = F.col("_bs").eqNullSafe(F.col("_es")) & (F.col("_b") == F.col("_eb"))
        self.blocks = stored(ranked.join(ends, same, "left").select("_bs", "_b", "held", "left", "_end"), "ends")

    def block_key(self, epoch: str) -> Column:
        return order(self.seed + 2, "_s", epoch, "_block")

    def draw_key(self, epoch: str) -> Column:
        return order(self.seed + 3, epoch, "_key")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with their source's quota and their block, so that a source with most of the rows is many groups."""
        joined = rows.join(self.quotas, rows["source"].cast("string").eqNullSafe(F.col("_s")))
        return joined.withColumn("_block", F.pmod(order(self.seed + 1, "_key"), F.col("blocks")))

    @staticmethod
    def placed(dealt: DataFrame, blocks: DataFrame) -> DataFrame:
        return dealt.join(blocks, F.col("_s").eqNullSafe(F.col("_bs")) & (F.col("_block") == F.col("_b")))

    def drawn(self, docs: DataFrame, key: Column) -> DataFrame:
        """(row, weight, epoch, block, block_key, draw_key): each row, as a struct of its columns, as often as it is
        drawn, its epoch counted from 0, and the keys that order the blocks of an epoch and the rows of a block."""
        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].cast("string").alias("source"), key.alias("_key"))
        placed = self.placed(self.dealt(rows), self.blocks)
        extra = F.when(F.col("left") <= 0, 0).when(F.col("left") >= F.col("held"), 1).otherwise(F.coalesce((self.draw_key("epochs") <= F.col("_end")).cast("int"), F.lit(0)))
        times = placed.withColumn("_times", F.col("epochs") + extra).filter("_times > 0")
        times = times.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
        return times.select("row", "weight", "epoch", F.col("_block").alias("block"), self.block_key("epoch").alias("block_key"), self.draw_key("epoch").alias("draw_key"))

    def rows(self, counted: DataFrame) -> DataFrame:
        """What is drawn of ``count_tokens``' rows."""
        out = self.drawn(counted, counted["_key"])
        return out.select("row.doc_id", "row.source", "row.tokens", "weight", "epoch", "block", "block_key", "draw_key")

    def repeated(self, docs: DataFrame) -> DataFrame:
        """``docs`` with each row as often as it is drawn, and the same columns."""
        return self.drawn(docs, row_key(docs, self.seed)).select("row.*")
