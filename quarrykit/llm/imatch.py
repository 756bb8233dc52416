"""I-Match fingerprints: sorted distinct terms of a middle band of inverse document frequency, hashed for several
randomised subsets of the lexicon. DataFrame functions only.

Terms are white-space separated words in lower case. The lexicon holds the terms found in a share of all
documents between ``least`` and ``most`` (in two documents at least), a band that does not depend on the corpus; as
every such term takes up at least ``least`` of all documents' distinct terms, there are at most (distinct terms of an
average document) / ``least`` of them however many documents there are. Up to ``ROOM`` terms are broadcast; more meet
the documents' terms in a shuffle, with the same result. Each
lexicon term gets a mask that says to which of the 26 random subsets it belongs; four subsets keep a quarter of the
lexicon, six a sixteenth, eight a 64th and eight a 256th, so that short and long texts both have telling subsets.
The fingerprint is the list of the subsets' hashes: of the document's terms in the subset, distinct and sorted.

The likeness of two fingerprints is the share of equal hashes among the subsets in which either has a term; two
texts without any lexicon term are alike (1) if both have none, else 0.

Defined cases: a null text counts as empty; a text without lexicon terms has only the hash of nothing in all
places; rows with one doc_id, or with none, are documents of their own: they follow each other in descending order of
a hash of their texts, those without an id last; rows equal in both are one document and are returned as often as they
occur; very long texts count whole; other columns are ignored; an empty table gives an empty result; a lone document
is its own next.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import scratch

#: (power of a quarter that a subset keeps of the lexicon, number of such subsets)
SUBSETS = [(1, 4), (2, 6), (3, 8), (4, 8)]
WHITE = "[ \\t-\\r]+"


def terms(text: Column) -> Column:
    """Distinct terms."""
    return F.array_distinct(F.filter(F.split(F.lower(text), WHITE), lambda w: w != ""))


def mask(term: Column) -> Column:
    """Bit j is set if the term belongs to subset j: the first byte of its MD5 with the subset's name is small."""
    out, j = F.lit(0), 0
    for power, n in SUBSETS:
        for k in range(n):
            digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{power}.{k}:"), term).cast("binary")), 1, 2), 16, 10).cast("int")
            out = out + F.when(digits < 4 ** (4 - power), F.lit(1 << j)).otherwise(F.lit(0))
            j += 1
    return out


def lexicon(docs: DataFrame, least: float = 0.001, most: float = 0.2) -> DataFrame:
    """(term, mask) of the terms whose share of documents lies in the band."""
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    low = max(least * n, 2)
    at = scratch(docs.sparkSession, "terms")
    df.filter((F.col("df") >= low) & (F.col("df") <= max(most * n, low))).select("term", mask(F.col("term")).alias("mask")).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """(id, h, n_chars, copies, next_id, next_h, prev) in descending order of id and h, the last followed by the first;
    prev is a struct of the previous document's id, h and n_chars.

    Ids are cut into ranges; each range is ordered by itself, and the ranges are joined at their ends.
    """
    spark, at = docs.sparkSession, scratch(docs.sparkSession, "ids")
    ids = docs.groupBy("id", "h").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies"))
    order = [F.col("id").desc(), F.col("h").desc()]
    ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).write.parquet(at)
    ids = spark.read.parquet(at).withColumns({"me": F.struct(F.col("id").alias("p_id"), F.col("h").alias("p_h"), F.col("n_chars").alias("p_chars")), "at": F.struct("id", "h")})
    ends = ids.groupBy("part").agg(F.max("at").alias("top"), F.min_by("me", "at").alias("bottom"))
    chain = Window.orderBy("part")  # one row for each of the ``parts`` ranges
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        F.col("part").alias("_part"),
        F.when(F.lead("part").over(chain).isNull(), F.first("top").over(whole)).otherwise(F.lead("top").over(chain)).alias("below"),
        F.when(F.lag("part").over(chain).isNull(), F.last("bottom").over(whole)).otherwise(F.lag("bottom").over(chain)).alias("above"),
    )
    own = Window.partitionBy("part").orderBy(*order)
    rows = ids.withColumns({"_next": F.lead("at").over(own), "_prev": F.lag("me").over(own)})
    rows = rows.join(F.broadcast(ends), F.col("part") == F.col("_part"))  # ``ends`` has a row for each range
    following = F.coalesce("_next", "below")
    return rows.select("id", "h", "n_chars", "copies", following["id"].alias("next_id"), following["h"].alias("next_h"), F.coalesce("_prev", "above").alias("prev"))


def edited(docs: DataFrame, near: DataFrame) -> DataFrame:
    """(id, h, text, edited): the last floor(n_chars / 2) characters give way to the next document's first."""
    # rows equal in id and text are one document
    same = Window.partitionBy("id", "h").orderBy("h")
    docs = docs.withColumn("_before", F.lag(F.lit(True)).over(same)).filter("_before is null").drop("_before")
    own = docs.join(near, ["id", "h"])
    heads = own.select(F.col("prev.p_id").alias("id"), F.col("prev.p_h").alias("h"), F.substring("text", F.lit(1), F.floor(F.col("prev.p_chars") / 2).cast("int")).alias("head"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    return own.join(heads, ["id", "h"]).select("id", "h", "text", F.concat(kept, "head").alias("edited"))


N_SUBSETS = sum(n for _, n in SUBSETS)
NO_ID = -(2**63)
ROOM = 1 << 18
SALTS = 32
NOTHING = hashlib.md5(b"").hexdigest()[:12]


def fingerprints(texts: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """(key..., prints): the hash of each subset's terms. ``texts`` has the key columns and text."""
    # the empty term stands in the lexicon too, with no subset, so that every text keeps a row
    words = words.unionByName(words.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).alias("mask")))
    own = texts.select(*key, F.explode(F.concat(F.array(F.lit("")), terms(F.col("text")))).alias("term"))
    if words.count() <= ROOM:
        found = own.join(F.broadcast(words), "term")
    else:  # the empty term is in every text, and a frequent one in a fifth of them: each meets its lexicon row in parts
        words = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = own.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).join(words, ["term", "salt"])
    sets = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("term", "mask"))).alias("t"))

    def held(terms: str, bits: int) -> Column:
        return F.filter(terms, lambda x: x["mask"].bitwiseAND(F.lit(bits)) != 0)

    # the few terms of the small subsets are taken out once, so that not all terms are tried for each subset
    prints, j, parts = [], 0, {}
    for power, n in SUBSETS:
        parts[f"_t{power}"] = held("t", ((1 << n) - 1) << j)
        for k in range(j, j + n):
            chosen = F.transform(held(f"_t{power}", 1 << k), lambda x: x["term"])
            prints.append(F.substring(F.md5(F.array_join(chosen, " ").cast("binary")), 1, 12))
        j += n
    return sets.withColumns(parts).select(*key, F.array(*prints).alias("prints"))


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes among the subsets where either side has a term."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != NOTHING) | (y != NOTHING)), lambda z: z))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != NOTHING)), lambda z: z))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def compare(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to it and to the next document's."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # plain keys, so that one dealing by id serves all that follows; a null id is one below all others
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("h"), "text")
    words = lexicon(docs)
    near = neighbours(docs, parts)
    both = edited(docs, near)
    kinds = [F.struct(F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("sha"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"), F.col("edited").alias("text"))]
    texts = both.select("id", "h", F.explode(F.array(*kinds)).alias("x")).select("id", "h", "x.kind", "x.sha", "x.text")
    at = scratch(spark, "prints")
    fingerprints(texts, words, ["id", "h", "kind", "sha"]).write.parquet(at)
    prints = spark.read.parquet(at)
    own = prints.filter("kind = 0").select("id", "h", F.col("prints").alias("own"))
    changed = prints.filter("kind = 1").select("id", "h", "sha", F.col("prints").alias("changed"))
    after = prints.filter("kind = 0").select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("prints").alias("after"))
    rows = near.drop("prev").join(own, ["id", "h"]).join(changed, ["id", "h"]).join(after, ["next_id", "next_h"])
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        F.array_join("own", ":").alias("fingerprint"), F.array_join("changed", ":").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
