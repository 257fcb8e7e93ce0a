"""What the operators of this subpackage share: Arrow text access, hashing,
checkpoints in the folder that all executors see, and exact global positions.

Text is read straight from Arrow's buffers as UTF-8 bytes, a bounded number of
bytes at a time, so that the numpy temporaries of a task don't grow with its
partition.  A document is never cut: one that is longer than a slice is a slice
of its own.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_pows: dict[int, np.ndarray] = {}

#: ASCII upper case to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 1 for ASCII white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster,
    whose machines would each have another, that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        given = tempfile.mkdtemp(prefix="inkwell-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder, without its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive rows; a null is an empty text."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if not len(col):
        return
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def powers(inverse: bool, n: int) -> np.ndarray:
    """The first n powers of the hash's base, or of its inverse, modulo 2**64."""
    have = _pows.get(inverse)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        out = np.full(size, _P_INV if inverse else _P, dtype=np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if size > 1 << 22:
            return out[:n]  # a very long text's powers aren't kept
        _pows[inverse] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, in order, and the offsets of each text's words.

    A word is a run of bytes that aren't ASCII white space, with ASCII letters
    in lower case.  Equal words have equal hashes wherever they stand.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(False, n), out=total[1:])
    h = (total[ends + 1] - total[starts]) * powers(True, n)[starts]
    return mix(h ^ (ends - starts).astype(np.uint64)), np.searchsorted(starts, at, side="left")


def segment_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]] for every i, empty ones 0; values may have further axes."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), dtype=values.dtype)
    full = at[1:] > at[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, at[:-1][full], axis=0)
    return out


def ranked(df: DataFrame, order: list[Column], weight: Column | None = None) -> DataFrame:
    """df with the exact sum `before` of the weights (1 each unless given) of all rows ahead of each in the order.

    One range shuffle of df; the per-partition totals are all that is added up
    in one place, a row for each partition.  df should be slim.  It is written
    to the checkpoint folder in sorted partitions.
    """
    w = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    parts = df.withColumn("ink_w", w).repartitionByRange(*order).withColumn("ink_p", F.spark_partition_id())
    parts = cut(parts)
    totals = parts.groupBy("ink_p").agg(F.sum("ink_w").alias("ink_t"))
    ahead = totals.select("ink_p", (F.sum("ink_t").over(Window.orderBy("ink_p")) - F.col("ink_t")).alias("ink_o"))
    inner = Window.partitionBy("ink_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.withColumn("ink_s", F.sum("ink_w").over(inner))
        .join(ahead, "ink_p")
        .withColumn("before", F.col("ink_o") + F.col("ink_s") - F.col("ink_w"))
        .drop("ink_p", "ink_w", "ink_s", "ink_o")
    )


def with_all(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, so that others can't clash with the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def boxed(df: DataFrame) -> Column:
    """All columns of df in one, ink_row, so that none can clash with an operator's own; select("ink_row.*") gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("ink_row")


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df (already cut), marked for broadcast only if it has no more than so many (narrow) rows; else joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
