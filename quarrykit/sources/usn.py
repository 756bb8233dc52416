"""Binary change-journal records of version 2 to raw nodes, and what went wrong on the way.

The journal is a run of records, each with its own length in front. Only that chain is followed step by step; the fixed
heads of all records are then read as one structured array.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The head of a version 2 record, the mark of a folder, and the part of a reference that is no sequence number.
HEAD = np.dtype([
    ("length", "<u4"), ("major", "<u2"), ("minor", "<u2"), ("file_id", "<i8"), ("parent_id", "<i8"), ("other", "V28"),
    ("attributes", "<u4"), ("name_size", "<u2"), ("name_at", "<u2"),
])
FOLDER = 0x10
REFERENCE_MASK = (1 << 48) - 1
HEADER = HEAD.itemsize
NODE, MALFORMED, UNSUPPORTED = "node", "malformed", "unsupported"
SCHEMA = "kind string, file_id long, parent_id long, name string, is_dir boolean"
ARROW = pa.schema([("kind", pa.string()), ("file_id", pa.int64()), ("parent_id", pa.int64()), ("name", pa.string()), ("is_dir", pa.bool_())])


def chain(buffer: bytes) -> tuple[list[int], bytes]:
    """Where the records begin, and what no record takes: from a length on that is too short or reaches too far."""
    length = struct.Struct("<I").unpack_from
    starts, at = [], 0
    while len(buffer) - at >= 4 and HEADER <= (n := length(buffer, at)[0]) <= len(buffer) - at:
        starts.append(at)
        at += n
    return starts, buffer[at:]


def records(buffer: bytes, mask: bool = False) -> pa.RecordBatch:
    return records_of([buffer], mask)


def records_of(buffers: list[bytes], mask: bool = False) -> pa.RecordBatch:
    """A row for each record: a node, or (with nothing but its kind) one that is malformed or of another version.

    What is left behind the last record of a buffer is one malformed row, unless it is shorter than a length or just a
    length of zero. A name must lie behind the head, within its record, in whole units; empty names, ``.`` and ``..`` are
    left out, broken UTF-16 is replaced. ``mask`` takes the sequence number off the references.
    """
    whole, base, starts, of, torn = b"".join(buffers), 0, [], [], []
    for k, buffer in enumerate(buffers):
        own, rest = chain(buffer)
        starts += [base + at for at in own]
        of += [k] * len(own)
        if len(rest) >= 4 and rest != bytes(4):
            torn.append(k)
        base += len(buffer)
    begin = np.array(starts, np.int64)
    heads = np.frombuffer(whole, np.uint8)[begin[:, None] + np.arange(HEADER)].copy().view(HEAD)[:, 0] if starts else np.zeros(0, HEAD)
    at, size = heads["name_at"].astype(np.int64), heads["name_size"].astype(np.int64)
    known = heads["major"] == 2
    sound = known & (at >= HEADER) & (at + size <= heads["length"]) & (size % 2 == 0)
    names = [whole[b : b + n].decode("utf-16-le", errors="replace") if ok else None for b, n, ok in zip((begin + at).tolist(), size.tolist(), sound.tolist())]
    references = REFERENCE_MASK if mask else -1
    columns = [
        pa.array(np.where(sound, NODE, np.where(known, MALFORMED, UNSUPPORTED)).tolist(), pa.string()),
        pa.array(heads["file_id"] & references, pa.int64(), mask=~sound),
        pa.array(heads["parent_id"] & references, pa.int64(), mask=~sound),
        pa.array(names, pa.string()),
        pa.array((heads["attributes"] & FOLDER) != 0, pa.bool_(), mask=~sound),
    ]
    rows = pa.RecordBatch.from_arrays(columns, schema=ARROW)
    named = np.array([n not in ("", ".", "..") for n in names], bool)
    if not torn:
        return rows.filter(pa.array(named, pa.bool_()))
    rows = pa.Table.from_batches([rows.filter(pa.array(named, pa.bool_())), pa.RecordBatch.from_pylist([{"kind": MALFORMED}] * len(torn), schema=ARROW)])
    order = np.argsort(np.concatenate([np.array(of, np.int64)[named], np.array(torn, np.int64)]), kind="stable")  # behind its buffer's records
    return rows.take(pa.array(order)).combine_chunks().to_batches()[0]


def pieces(column, most: int = 1 << 22):
    """The buffers that are not null, in lists of at most so many bytes, or of one buffer."""
    out, size = [], 0
    for buffer in column:
        if not buffer.is_valid:
            continue
        buffer = buffer.as_py()
        if out and size + len(buffer) > most:
            yield out
            out, size = [], 0
        out.append(buffer)
        size += len(buffer)
    if out:
        yield out


def decode(buffers: DataFrame, column: str = "content", mask: bool = False) -> DataFrame:
    """All records of all buffers, short buffers many at a time; a null buffer has none."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch[column]):
                yield records_of(piece, mask)

    return buffers.select(F.col(column).cast("binary").alias(column)).mapInArrow(run, SCHEMA)


def encode_column(file_id, parent_id, name, is_dir):
    """The bytes of one record, as a Column: for tests and for data that Spark derives."""

    def little(c, size: int):
        digits = F.lpad(F.hex(c.cast("long")), 16, "0")
        pairs = [F.substring(digits, 17 - 2 * k, 2) for k in range(1, size + 1)]
        return F.concat(*pairs)

    raw = F.encode(name, "UTF-16LE")
    length = F.length(raw) + HEADER
    attributes = F.when(is_dir, F.lit(FOLDER)).otherwise(F.lit(0))
    head = F.concat(little(length, 4), little(F.lit(2), 2), F.lit("0000"), little(file_id, 8), little(parent_id, 8), F.lit("00" * 28), little(attributes, 4), little(F.length(raw), 2), little(F.lit(HEADER), 2))
    return F.concat(F.unhex(head), raw)


def nodes(decoded: DataFrame) -> DataFrame:
    return decoded.filter("kind = 'node'").select("file_id", "parent_id", "name", "is_dir")


def stats(decoded: DataFrame) -> DataFrame:
    return decoded.agg(F.count_if(F.col("kind") == "node").alias("nodes"), F.count_if(F.col("kind") == "malformed").alias("malformed"), F.count_if(F.col("kind") == "unsupported").alias("unsupported"))
