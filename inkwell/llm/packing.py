"""Packing along a space-filling curve.

A document's words are hashed to buckets; the vector of log(1 + count), scaled
to length 1, is projected to a few dimensions by fixed random numbers.  Each
dimension is standardised over the whole table and cut into equal steps of its
share, and a Hilbert curve through these cells gives the document's key.
Documents are range-sorted by key and laid end to end, and the line is cut
every `capacity` words: all packs but the last are full, a pack's documents are
neighbours, and no word is lost.  Only (key, identifier, words) is sorted, and
places follow from the partitions' totals, so the packs don't depend on how the
table is partitioned.

Cases: a text without words (empty, null) is at the curve's middle, with 0
words in the pack where the next document begins; a document longer than a
pack goes on in the following ones; equal keys are ordered by identifier and
words, null identifiers first, and repeated rows are packed as often as they
occur; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, ranked, text_slices, word_hashes

CAPACITY = 2048
DIMENSIONS = 4
BITS = 12
BUCKETS = 1 << 16
SEED = 2


def vectors(texts: pa.Array, dimensions: int, buckets: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Projected vectors, and the number of words, of each text."""
    table = np.random.default_rng(seed).standard_normal((buckets, dimensions)).astype(np.float32)
    out, words = np.zeros((len(texts), dimensions), np.float32), np.zeros(len(texts), np.int64)
    for lo, hi, data, at in text_slices(texts):
        h, w_at = word_hashes(data, at)
        n = np.diff(w_at)
        words[lo:hi] = n
        if not len(h):
            continue
        key = np.repeat(np.arange(hi - lo, dtype=np.uint64), n) * np.uint64(buckets) + h % np.uint64(buckets)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        v = np.log1p(np.diff(np.append(first, len(key)))).astype(np.float32)
        row, bucket = np.divmod(key[first], np.uint64(buckets))
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        got = row[begin].astype(np.int64) + lo
        long = np.sqrt(np.add.reduceat(v * v, begin))[:, None]
        out[got] = np.add.reduceat(table[bucket.astype(np.int64)] * v[:, None], begin, axis=0) / long
    return out, words


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of points with coordinates below 2**bits; cells has a row for each."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def cells_of(v: np.ndarray, mean: np.ndarray, deviation: np.ndarray, bits: int) -> np.ndarray:
    """Cells of standardised vectors: equal shares of a normal distribution, about."""
    z = (v.astype(np.float64) - mean) / np.where(deviation > 0, deviation, 1)
    return np.minimum((1 << bits) - 1, np.floor((1 << bits) / (1 + np.exp(-1.702 * z)))).astype(np.int64)


def curve_keys(docs: DataFrame, text: str, doc_id: str, dimensions: int, bits: int, buckets: int, seed: int) -> DataFrame:
    """(i, n, key): identifier, number of words and place on the curve of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t"))
    names = [f"x{k}" for k in range(dimensions)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, n = vectors(b.column(1), dimensions, buckets, seed)
            yield pa.record_batch([b.column(0), pa.array(n), *(pa.array(v[:, k]) for k in range(dimensions))], names=["i", "n", *names])

    slim = cut(rows.mapInArrow(project, ", ".join(["i bigint", "n bigint", *(f"{x} float" for x in names)])))
    # decimals, so that the sums don't depend on the order of the rows
    sums = slim.agg(*[f(F.expr(f"cast({e} as decimal(28, 12))")).alias(f"{x}_{k}") for x in names for k, e, f in (("s", x, F.sum), ("q", f"double({x}) * double({x})", F.sum))], F.count(F.lit(1)).alias("n")).first()
    count = max(1, sums["n"])
    mean = np.array([float(sums[f"{x}_s"] or 0) / count for x in names])
    deviation = np.sqrt(np.maximum(0, np.array([float(sums[f"{x}_q"] or 0) / count for x in names]) - mean**2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.stack([b.column(2 + k).to_numpy() for k in range(dimensions)], axis=1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(hilbert(cells_of(v, mean, deviation, bits), bits))], names=["i", "n", "key"])

    return slim.mapInArrow(place, "i bigint, n bigint, key bigint")


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, dimensions: int = DIMENSIONS, bits: int = BITS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(pack_id, pack_start, doc_id, doc_start, words, curve_key): a row for each piece of a document in a pack.

    pack_start and doc_start count words from the pack's and the document's begin.
    """
    keyed = curve_keys(docs, text, doc_id, dimensions, bits, buckets, seed)
    line = ranked(keyed, [F.col("key"), F.col("i"), F.col("n")], F.col("n"))
    first, last = F.floor(F.col("before") / capacity), F.floor((F.col("before") + F.greatest(F.col("n"), F.lit(1)) - 1) / capacity)
    pieces = line.withColumn("pack_id", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("before"), F.col("pack_id") * capacity)
    end = F.least(F.col("before") + F.col("n"), (F.col("pack_id") + 1) * capacity)
    return pieces.select(
        "pack_id", (start - F.col("pack_id") * capacity).alias("pack_start"), F.col("i").alias("doc_id"),
        (start - F.col("before")).alias("doc_start"), F.greatest(end - start, F.lit(0)).alias("words"), F.col("key").alias("curve_key"),
    )
