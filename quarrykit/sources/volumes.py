"""Several volumes' journal dumps in one scan, of which any may fail: one task a volume, an error row where it fails.

A dump is a file of change-journal records. It is read in pieces, so that neither a volume nor a task holds it whole. A
dump that cannot be opened or read, or that has no record at all, is a failed volume: it gives one row of kind ``error``,
and the others are not affected. Ids get the volume's number, from 1, in their top byte, failed volumes counted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.sources import usn

PIECE = 8 << 20
SCHEMA = f"volume int, {usn.SCHEMA}, error string"


def pieces(path: str, piece: int = PIECE, mask: bool = False):
    """The records of a dump, batch by batch; a record that two pieces share is read with the second one."""
    rest, first = b"", True
    with open(path, "rb") as f:
        while got := f.read(piece):
            buffer = rest + got
            starts, rest = usn.chain(buffer)
            if first and not starts and len(buffer) >= usn.HEADER and len(got) < piece:
                raise ValueError("no journal records")
            if not starts and len(buffer) > 4 * piece:
                raise ValueError("a record longer than can be")
            if starts:
                yield usn.records(buffer[: len(buffer) - len(rest)], mask)
            first = first and not starts
            if len(rest) >= 4 and int.from_bytes(rest[:4], "little") < usn.HEADER:
                break  # no record begins here, so nothing behind can be told
    if first:
        raise ValueError("no journal records")
    yield usn.records(rest, mask)


def scan(spark: SparkSession, dumps: list[str], mask: bool = False, piece: int = PIECE) -> DataFrame:
    """(volume, kind, file_id, parent_id, name, is_dir, error) of all dumps; kinds as in ``usn``, and ``error``."""

    def run(batches):
        for batch in batches:
            for volume, path in zip(batch["volume"].to_pylist(), batch["path"].to_pylist()):
                try:
                    for rows in pieces(path, piece, mask):
                        none = [pa.nulls(rows.num_rows, pa.string())]
                        yield pa.RecordBatch.from_arrays([pa.array([volume] * rows.num_rows, pa.int32()), *rows.columns, *none], names=["volume", *rows.schema.names, "error"])
                except (OSError, ValueError) as e:
                    row = {"volume": volume, "kind": "error", "file_id": None, "parent_id": None, "name": None, "is_dir": None, "error": f"{path}: {getattr(e, 'strerror', None) or e}"}
                    yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("volume", pa.int32()), *usn.ARROW, ("error", pa.string())]))

    table = spark.createDataFrame(list(enumerate(dumps, 1)), "volume int, path string")
    rows = table.repartitionById(max(len(dumps), 1), F.col("volume") - 1).mapInArrow(run, SCHEMA)
    tag = F.shiftleft(F.col("volume").cast("long"), 56)
    return rows.withColumns({c: F.col(c).bitwiseOR(tag) for c in ("file_id", "parent_id")})


def counts(scanned: DataFrame) -> DataFrame:
    """One row: volumes that gave nodes, failed ones, nodes, malformed and unsupported records."""
    kinds = {"nodes": "node", "malformed": "malformed", "unsupported": "unsupported"}
    return scanned.agg(F.count_distinct(F.when(F.col("kind") == "node", F.col("volume"))).alias("volumes"), F.count_if(F.col("kind") == "error").alias("errors"), *(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()))
