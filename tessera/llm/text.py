"""Vectorised text kernels over Arrow string buffers.

All kernels see whole texts. A batch is cut between rows only, into chunks of about ``CHUNK`` bytes, so memory follows
the chunk (or the longest single text), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Base of the polynomial hashes (odd, so it has an inverse modulo 2^64) and a random value for each byte.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n at least; kept for the worker's life."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        with np.errstate(over="ignore"):
            _powers["up"] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, BASE, np.uint64))]).astype(np.uint64)
            inverse = np.uint64(pow(int(BASE), -1, 2**64))
            _powers["down"] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, inverse, np.uint64))]).astype(np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def parts(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each chunk of a string column."""
    raw, offsets = utf8(column)
    for a, b in chunks(offsets, most):
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~SPACE[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    first[1:] = ~ink[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] = True
    starts = np.flatnonzero(ink & first)
    last = np.empty(len(raw), bool)
    last[-1] = True
    last[:-1] = ~ink[1:]
    last[inner - 1] = True
    ends = np.flatnonzero(ink & last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; ``span_hash`` turns two of them into the hash of the bytes between."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[raw] * up[: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal spans hash equally wherever they stand."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all spans of ``width`` bytes."""
    _, down = powers(len(prefix))
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix((prefix[width:] - prefix[:n]) * down[:n])


def word_shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct ``size``-word shingles, A-Z lower-cased, sorted by row and hash.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    low = LOWER[raw]
    starts, ends, rows = words(low, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = span_hash(prefix_hash(low), starts, ends)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    take = np.minimum(np.maximum(count - size + 1, 1), count)
    row = np.repeat(np.arange(len(count)), take)
    at = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take) + first[row]
    length = np.minimum(count, size)[row]
    value = np.zeros(len(row), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = k < length
            step = mix(value * np.uint64(0xD6E8FEB86659FD93) + word[np.minimum(at + k, len(word) - 1)] + np.uint64(k + 1))
            value = np.where(inside, step, value)
    order = np.lexsort((value, row)) if len(row) < 2 else _row_sort(row, value, take)
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _row_sort(row: np.ndarray, value: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Order by row, then value; rows come in order already, so sort by value and restore rows stably."""
    order = np.argsort(value)
    kind = np.uint16 if len(take) <= 65535 else np.int64
    return order[np.argsort(row[order].astype(kind), kind="stable")]


def shared_dir(spark) -> str:
    """A folder that driver and executors share: the session's checkpoint folder; a local one only where none is set.

    The setting is read from the session each time, so a cluster's folder always wins.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        import os
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{os.path.join(tempfile.gettempdir(), 'tessera-shared')}"
    return at


def written(df, name: str):
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Bits of the filter that ``among`` broadcasts: 4 MB whatever the input.
FILTER_BITS = 1 << 25


_HIT = "getbit(cast(conv(hex(substring(marks__, cast((slot__ % 32768) div 8 as int) + 1, 1)), 16, 10) as bigint), cast(slot__ % 8 as int)) = 1"


def _asked(df, column: str, ids, how: str):
    from pyspark.sql import functions as F

    slot = lambda name: F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    marks = ids.select(slot(ids.columns[0]).alias("slot")).distinct().select(F.shiftright("slot", 15).alias("chunk__"), (F.col("slot") % 32768).alias("at"))
    marks = marks.repartition("chunk__").groupBy("chunk__").agg(F.bitmap_construct_agg("at").alias("marks__"))
    asked = df.withColumn("slot__", slot(column)).withColumn("chunk__", F.shiftright("slot__", 15))
    return asked.join(F.broadcast(marks), "chunk__", how)


def among(df, column: str, ids):
    """Rows of ``df`` whose ``column`` may be one of ``ids``, a table of one column; rows that pass by chance are for a join to drop.

    A bitmap of ``FILTER_BITS`` hashed ids is broadcast, so a join by id that follows shuffles little else than what it keeps.
    With many more ids than bits the bitmap fills up and the join shuffles everything, as it would without it.
    """
    return _asked(df, column, ids, "inner").where(_HIT).select(*df.columns)


def marked(df, column: str, ids, flag: str):
    """``df`` with ``flag``: whether ``column`` may be one of ``ids``; see ``among``. False is certain."""
    from pyspark.sql import functions as F

    return _asked(df, column, ids, "left").select(*df.columns, F.coalesce(F.expr(_HIT), F.lit(False)).alias(flag))


def removed(spark, *paths: str) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
