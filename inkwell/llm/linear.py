"""Linear models fitted to rows that stay where they are.

L-BFGS runs on the driver and only holds vectors as long as the model is wide;
each of its steps sends the weights to the rows' partitions, which give back
the sums that it needs.  No partition's rows are gathered anywhere.  Where there
are many partitions their sums are added up in groups before the driver gets
them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Sums that the driver adds up itself.
SUMS = 32


def _add(table: pa.Table) -> pa.Table:
    total, sums = None, 0.0
    for number, raw in zip(table.column("number").to_pylist(), table.column("sums"), strict=True):
        x = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64)
        total, sums = x if total is None else total + x, sums + np.array(number)
    return pa.table({"g": table.column("g")[:1], "number": pa.array([np.atleast_1d(sums).tolist()], pa.list_(pa.float64())), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def summed(rows: DataFrame, state: Any, work: Callable[[Iterator[pa.RecordBatch], Any], tuple[list[float], np.ndarray]], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums over all partitions of what `work` makes of each: some numbers, and a long vector (sent as float32)."""
    sent = rows.sparkSession.sparkContext.broadcast(state)
    groups = max(1, parts // SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sums = work(batches, sent.value)
        g = TaskContext.get().partitionId() % groups
        yield pa.record_batch([pa.array([g], pa.int32()), pa.array([number], pa.list_(pa.float64())), pa.array([sums.astype(np.float32).tobytes()], pa.binary())], names=["g", "number", "sums"])

    form = "g int, number array<double>, sums binary"
    made = rows.mapInArrow(run, form)
    if groups > 1:
        made = made.groupBy("g").applyInArrow(_add, form)
    numbers, vector = None, None
    for r in made.collect():
        x, n = np.frombuffer(r["sums"], np.float32).astype(np.float64), np.array(r["number"])
        numbers, vector = (n, x) if numbers is None else (numbers + n, vector + x)
    sent.destroy()
    return numbers, vector


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = 8, tolerance: float = 1e-4, enough: float = 0.0) -> np.ndarray:
    """L-BFGS with backtracking; it ends when a step lowers the loss by less than a share `tolerance`, or by less than `enough`."""
    f, g = loss(w)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, back = -g, []
        for s, y in reversed(kept):
            a = s @ d / (s @ y)
            back.append(a)
            d = d - a * y
        if kept:
            s, y = kept[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(kept, reversed(back), strict=True):
            d = d + (a - y @ d / (s @ y)) * s
        if d @ g >= 0:
            d = -g
        t = 1.0 if kept else 1.0 / max(1e-12, np.sqrt(g @ g))
        while True:
            new = w + t * d
            f2, g2 = loss(new)
            if f2 <= f + 1e-4 * t * (d @ g) or t < 1e-10:
                break
            t /= 2
        s, y = new - w, g2 - g
        if s @ y > 1e-10:
            kept = [*kept[-memory + 1 :], (s, y)]
        done = f - f2 < max(enough, tolerance * max(1.0, abs(f)))
        w, f, g = new, f2, g2
        if done:
            break
    return w


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]] for every i."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def blocks(column: pa.Array, kind: type, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, numbers, offsets from 0) of rows of packed numbers, so that temporaries stay small."""
    column = column.cast(pa.large_binary())
    width = np.dtype(kind).itemsize
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // width
    data = np.frombuffer(column.buffers()[2], kind) if column.buffers()[2] is not None else np.zeros(0, kind)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
