"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again by the next.

1. language ID: documents without a main language go; 2. line dedup: lines of ten documents or more go from every
document, where copies (documents with equal lines) count as one, so that what only copies share stays for the next
stage; 3. MinHash near-dedup: one document of each group stays; 4. mixing: sources are repeated towards an even mix,
every document at least once; 5. BPE: token counts and digests of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import bpe, language_id, line_dedup, mixing, near_dedup
from quarrykit.llm.common import scratch, table
from quarrykit.llm.queries import BPE_PATH


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.filter(~language_id.held_out()))
    return language_id.accept(docs, model, least=0.4)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.kept_lines(docs, line_dedup.fill_once(docs, threshold=10))
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    cut, row = F.col("n_dropped") > 0, F.col("row")
    return out.select(*[F.when(cut, changed[c]).otherwise(row[c]).alias(c) if c in changed else row[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs, percent=75)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    draw = mixing.Draw(mixing.count_tokens(docs), entropy=0.95, repeats=2.0)
    return draw.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, BPE_PATH, bpe.build_lexicon(docs, BPE_PATH))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: Training, sketching, mixing and encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        at = scratch(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
