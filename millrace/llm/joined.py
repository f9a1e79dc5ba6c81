"""SHA-256 of the sorted, comma-joined values of each group, for groups of any size.

Rows are range-partitioned by group and value, so a large group spreads over many tasks, each of which joins its values into strings of bounded size.
Those strings, a small part of the rows, meet by group, and one task hands them to the hash in turn: it holds one batch of strings at a time, never a group.
The hash itself takes its input in order, so the bytes of one group pass through one task; nothing else does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage

VALUES = 4_000  # joined into one string
PER_RANGE = 20_000  # rows, about


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in (group, value) order: the values of a group in strings of at most ``VALUES`` values."""
    group, held, first = None, [], None

    def flushed(out: list[tuple]) -> None:
        if held:
            out.append((group, first, len(held), ",".join(held)))

    for batch in batches:
        out: list[tuple] = []
        for g, order, text in zip(*(c.to_pylist() for c in batch.columns)):
            if g != group or len(held) >= VALUES:
                flushed(out)
                group, held, first = g, [], order
            held.append(text)
        yield _rows(out)
    out = []
    flushed(out)
    yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.string())
    columns = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["group", "first", "n", "joined"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From strings in (group, first) order: one row per group."""
    group, n, sha = None, 0, None
    for batch in batches:
        out: list[tuple] = []
        for g, _, more, joined in zip(*(c.to_pylist() for c in batch.columns)):
            if g != group:
                if sha is not None:
                    out.append((group, n, sha.hexdigest()))
                group, n, sha = g, 0, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(joined.encode())
            n += more
        yield _hashed(out)
    yield _hashed([(group, n, sha.hexdigest())] if sha is not None else [])


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string()))], ["group", "n", "sha256"])


def joined_sha256(rows: DataFrame) -> DataFrame:
    """``group``, ``n`` and ``sha256`` (lowercase hex) for rows of ``group`` (binary), ``order`` (binary, sorts as the values do) and ``value`` (string).

    Groups without a row have none here either. Equal rows are all joined.
    """
    rows = cut_lineage(rows.select("group", "order", "value"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PER_RANGE))
    strings = rows.repartitionByRange(parts, "group", "order").sortWithinPartitions("group", "order")
    strings = strings.mapInArrow(_join, "group binary, first binary, n long, joined string")
    return strings.repartition(parts, "group").sortWithinPartitions("group", "first").mapInArrow(_hash, "group binary, n long, sha256 string")


def sortable(number: Column) -> Column:
    """A long as 8 bytes that sort as the numbers do."""
    return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
