"""Plumbing shared by the Arrow-based operators of this package.

Operators that need many small postings per record ship them as packed binary blobs: one row per
(input batch, slice) instead of one row per posting. A slice is a bounded unit of work; the number
of slices grows with the data, so no task ever holds an unbounded group.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOB = "slice long, blob binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalise(text: str | None) -> str:
    """NFKC, lower case, white space trimmed and inner runs made one space; null gives ''."""
    if not text:
        return ""
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def normalised_set(items: list[str | None] | None) -> list[str]:
    """Distinct normalised items in first-seen order, without null and blank ones."""
    return list(dict.fromkeys(x for x in map(normalise, items or ()) if x))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary: a header of lengths and types, then the data."""
    head = [len(arrays)]
    for a in arrays:
        head += [a.size, ord(a.dtype.kind), a.dtype.itemsize]
    return np.array(head, dtype=np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 3 * n, 8).reshape(n, 3)
    out, at = [], 8 + 24 * n
    for size, kind, width in head.tolist():
        out.append(np.frombuffer(blob, np.dtype(f"{chr(kind)}{width}"), size, at))
        at += size * width
    return out


def batch_of(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


BLOB_SCHEMA = pa.schema([("slice", pa.int64()), ("blob", pa.binary())])


def blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return batch_of({"slice": [k for k, _ in rows], "blob": [b for _, b in rows]}, BLOB_SCHEMA)


def over_slices(
    df: DataFrame,
    partitions: int,
    each: Callable[[int, list[list[np.ndarray]]], Iterator[pa.RecordBatch]],
    schema: str,
    broadcasts: object = None,
) -> DataFrame:
    """Bring the blobs of each slice together and run ``each(slice, unpacked blobs)`` on it. Slices are dealt to
    the partitions in turn, so that no two meet by chance of a hash while another partition is empty."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            values = batch.column(1)
            for i, key in enumerate(keys):
                if key != now and held:
                    yield from each(now, held)
                    held = []
                now = key
                held.append(unpack(values[i].as_py()))
        if held:
            yield from each(now, held)

    n = max(1, partitions)
    dealt = df.repartitionById(n, F.pmod("slice", F.lit(n)).cast("int"))
    return dealt.sortWithinPartitions("slice").mapInArrow(run, schema)


def summed(df: DataFrame, fan: int = 64) -> DataFrame:
    """Blobs of one shape added up by slice, in two levels: each slice's in ``fan`` parts, then the parts'
    sums, so no task reads more than a part of the blobs nor holds more than one sum."""

    def numbered(batches):
        part = TaskContext.get().partitionId() % fan
        for batch in batches:
            yield blobs([(k * fan + part, b.as_py()) for k, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)])

    def whole(batches):
        for batch in batches:
            yield blobs([(k // fan, b.as_py()) for k, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)])

    def add(batches):
        now, total = None, []
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = unpack(blob.as_py())
                if key == now:
                    total = [x + y for x, y in zip(total, own, strict=True)]
                    continue
                if now is not None:
                    yield blobs([(now, pack(*total))])
                now, total = key, own
        if now is not None:
            yield blobs([(now, pack(*total))])

    for step in (numbered, whole):
        df = df.mapInArrow(step, BLOB).repartition("slice").sortWithinPartitions("slice").mapInArrow(add, BLOB)
    return df


def partitions_for(spark: SparkSession, units: int) -> int:
    """Shuffle partitions for ``units`` slices: one each, but no fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(units, 100_000))


def flat_pairs(start: np.ndarray, stop: np.ndarray, limit: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with start[i] <= j < stop[i], in chunks of about ``limit`` pairs."""
    count = np.maximum(stop - start, 0)
    total = np.cumsum(count)
    lo = 0
    while lo < len(count):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + limit, "right")))
        c = count[lo:hi]
        m = int(c.sum())
        if m:
            i = np.repeat(np.arange(lo, hi), c)
            j = np.arange(m) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[lo:hi], c)
            yield i, j
        lo = hi


def distinct_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
