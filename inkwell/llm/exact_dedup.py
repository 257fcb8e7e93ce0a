"""Exact dedup: a tree merge of sorted digest runs.

Every partition turns its rows into runs, sorted by digest and already without
copies of their own.  Partitions then exchange runs in rounds: in round r each
run is split by its digests' r-th group of bits, and the parts of the runs that
differ only in the r-th digit of their number meet and are merged, several at
once.  After the last round the digests that share all those bits lie in one
run.  Rounds exchange 40 bytes or so for each distinct text that is left, never
a text, and no run holds more than its share however many rows there are.

A text is identified by 128 bits of its SHA-256 digest, by which runs are
sorted; equal ones are verified at every level by the digest's other 128 bits
and the text's length before the smaller identifier is kept.

Cases: a very long text is hashed whole; a null text is no copy of anything, and its row stays; empty texts are
copies of one another; a null identifier counts as larger than any other, so
such a row stays only if no copy has an identifier; of rows that are equal in
identifier and text one stays; an empty table gives an empty result; columns
other than the two that are named are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import boxed, cut, small, with_all

BITS = 3
#: Rows that a last run has, about; sets the number of rounds.
RUN_ROWS = 16_384
#: Rows of a first run at most; a partition of more makes several.
FIRST_ROWS = 262_144
NO_ID = np.iinfo(np.int64).max
_RUN = np.dtype([("a", "<u8"), ("b", "<u8"), ("c", "<u8"), ("d", "<u8"), ("len", "<i8"), ("id", "<i8"), ("n", "<i8"), ("twins", "<i8")])
_SCHEMA = "slot int, data binary"
_ARROW = pa.schema([("slot", pa.int32()), ("data", pa.binary())])


def merge(runs: np.ndarray) -> np.ndarray:
    """One sorted run of several that follow each other, the smallest identifier and all copies counted for each text."""
    if not len(runs):
        return runs
    s = runs[np.argsort(runs["a"], kind="stable")]  # a merge of the runs, as they are sorted
    same = s["a"][1:] == s["a"][:-1]
    rest = same.copy()
    for k in ("b", "c", "d", "len"):
        rest &= s[k][1:] == s[k][:-1]
    if (same & ~rest).any():  # one prefix of several texts: order those by the whole digest
        s = s[np.lexsort((s["len"], s["d"], s["c"], s["b"], s["a"]))]
        rest = s["a"][1:] == s["a"][:-1]
        for k in ("b", "c", "d", "len"):
            rest &= s[k][1:] == s[k][:-1]
    first = np.flatnonzero(np.concatenate([[True], ~rest]))
    out = s[first]
    out["id"] = np.minimum.reduceat(s["id"], first)
    out["n"] = np.add.reduceat(s["n"], first)
    least = np.repeat(out["id"], np.diff(np.append(first, len(s))))
    out["twins"] = np.add.reduceat(np.where(s["id"] == least, s["twins"], 0), first)
    return out


def _batch(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p for p, _ in parts], pa.int32()), pa.array([r.tobytes() for _, r in parts], pa.binary())], schema=_ARROW)


def _split(slot: int, run: np.ndarray, r: int) -> list[tuple[int, np.ndarray]]:
    """The parts of a sorted run for round r, with the slots that they go to."""
    shift = BITS * r
    digit = (run["a"] >> np.uint64(64 - BITS * (r + 1))) & np.uint64((1 << BITS) - 1)
    base = slot & ~(((1 << BITS) - 1) << shift)
    out = []
    for j in np.unique(digit):
        out.append((base | int(j) << shift, run[digit == j]))
    return out


def runs_of(batches: Iterator[pa.RecordBatch], rounds: int) -> Iterator[pa.RecordBatch]:
    slot = TaskContext.get().partitionId() % (1 << BITS * rounds)
    held: list[np.ndarray] = []
    for b in batches:
        digest = b.column(0)
        raw = np.frombuffer(b"".join(digest.to_pylist()), dtype=">u8").reshape(-1, 4)
        run = np.empty(len(raw), dtype=_RUN)
        for i, k in enumerate("abcd"):
            run[k] = raw[:, i]
        run["len"] = b.column(1).to_numpy()
        run["id"] = b.column(2).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        run["n"] = run["twins"] = 1
        held.append(run)
        if sum(map(len, held)) >= FIRST_ROWS:
            yield _batch(_split(slot, merge(np.concatenate(held)), 0))
            held = []
    if held:
        yield _batch(_split(slot, merge(np.concatenate(held)), 0))


def _meet(following: int | None) -> Callable[[tuple, pa.Table], pa.Table]:
    """Merges the runs that met in a slot, and splits the result for the following round or gives its rows."""

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        run = merge(np.concatenate([np.frombuffer(x, dtype=_RUN) for x in table.column("data").to_pylist()]))
        if following is not None:
            return pa.Table.from_batches([_batch(_split(key[0].as_py(), run, following))])
        raw = np.stack([run[k] for k in "abcd"], axis=1).astype(">u8").tobytes()
        digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(run), [None, pa.py_buffer(raw)]).cast(pa.binary())
        ids = pa.array(run["id"], mask=run["id"] == NO_ID)
        return pa.table({"ink_digest": digests, "ink_id": ids, "copies": run["n"], "twins": run["twins"]})

    return meet


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int | None = None) -> DataFrame:
    """ink_digest (of 32 bytes), ink_id, copies and twins of every distinct text that isn't null.

    copies: how many rows have the text; twins: how many of these have the identifier that stays.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")
    if rounds is None:
        rounds = max(2, math.ceil(math.log(max(1, docs.count() / RUN_ROWS)) / math.log(1 << BITS)))
    n_rounds = rounds
    slim = rows.select(F.unhex(F.sha2("t", 256)).alias("g"), F.octet_length("t").cast("bigint").alias("l"), "i")
    parts = slim.mapInArrow(lambda it: runs_of(it, n_rounds), _SCHEMA)
    for r in range(rounds):
        last = r == rounds - 1
        parts = parts.groupBy("slot").applyInArrow(_meet(None if last else r + 1), "ink_digest binary, ink_id bigint, copies bigint, twins bigint" if last else _SCHEMA)
    return parts


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int | None = None) -> DataFrame:
    """(doc_id, copies) of the rows that stay: the smallest identifier of each distinct text, and how many rows have that text."""
    kept = survivors(docs, text, doc_id, rounds).select(F.col("ink_id").alias("doc_id"), "copies")
    lone = with_all(docs, [doc_id, text]).where(F.col(f"`{text}`").isNull())
    return kept.unionByName(lone.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.lit(1).cast("bigint").alias("copies")))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, in its columns; of rows equal in identifier and text any one.

    Only the digests of texts that occur more than once are joined; where they are few, as checked, no text is shuffled.
    """
    found = cut(survivors(docs, text, doc_id).where("copies > 1").select("ink_digest", "ink_id", "twins"))
    digest, i = F.unhex(F.sha2(F.col(f"`{text}`"), 256)), F.col(f"`{doc_id}`").cast("bigint")
    rows = docs.select(boxed(docs), digest.alias("ink_d"), i.alias("ink_i"))
    met = rows.join(small(found), F.col("ink_d") == F.col("ink_digest"), "left").where(F.col("ink_digest").isNull() | F.col("ink_i").eqNullSafe(F.col("ink_id")))
    one = met.where("ink_digest is null or twins = 1").select("ink_row.*")
    if found.where("twins > 1").isEmpty():
        return one
    several = met.where("twins > 1").groupBy("ink_d").agg(F.first("ink_row").alias("ink_row"))  # partial sums: no list of equal rows
    return one.unionByName(several.select("ink_row.*"))


SQL = """
SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL SELECT doc_id, CAST(1 AS BIGINT) AS copies FROM documents WHERE text IS NULL
"""
