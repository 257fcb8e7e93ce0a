"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids (half the square root of the number of rows, rounded up) are
found by Lloyd's iterations over a sample of the rows, and so is a codebook for
each part of the rows' residuals to their centroids.  The sample is what bounds
the fit: about FIT_ROWS rows, or FIT_LIST for each list where that is more, all
rows where there are fewer; chosen by their identifiers' hashes.  Every row is
indexed: it is kept in its centroid's list with its code and itself.

Queries are the rows whose identifier `every` divides, against all rows.  Each
goes to the lists of its `probes` nearest centroids (of more, where these lists
hold fewer than k others), where a table of the distances between its
residual's parts and the codebooks gives the asymmetric distance to each code;
the `rerank` best of a list, of equally good ones those of the smallest
identifiers, are compared exactly, and the best of all lists are the query's
neighbours.

Residuals are cut into `parts` of equal width (as many parts as dimensions
where these are fewer).  Where the dimensions can't be divided so, they are
followed by zeros, which are the same for all rows and change no distance.

How many lists must be probed depends on the data: few where it has clusters,
many where it has none.  How many codes of a list must be reranked depends on
how well codes tell its rows apart, and grows with the list.  Unless given, both
are tuned together: the true neighbours of `tuned_on` rows are found by
comparing these with all rows, and each one's place among its list's codes by
going through the codes.  Of the numbers at which a share `reach` of them is
found by the whole search, those of the least work are taken.

Lists and their queries meet in pieces of bounded size, however large or sought
a list is.  Centroids and codebooks, which every executor gets, grow with the
square root of the rows.

Cases: rows without identifier or embedding, with a missing or infinite value,
or of another dimension than most rows have (of equally frequent ones the
largest) are neither queries nor neighbours; of rows of one identifier the one
with the smallest embedding counts; equal distances are ordered by identifier;
no row is its own neighbour; with fewer rows than k there are fewer
neighbours; vectors of thousands of dimensions are compared whole; an empty
table, or one without a query, gives an empty result; other columns aren't
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, small

K = 10
REACH = 0.95
TUNED_ON = 400
PARTS = 16
CODES = 256
STEPS = 8
EVERY = 50
FIT_ROWS, FIT_LIST = 65_536, 64
#: Rows of a list, and queries, that meet at once.
LIST_ROWS, QUERY_ROWS = 32_768, 8_192
#: Numbers of reranked rows that are held at once.
EXACT = 1 << 20
BLOCK = 64
SEED = 8


def usable(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the rows that count, v an array of floats."""
    rows = table.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{embedding}`").cast("array<float>").alias("v"))
    rows = rows.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = float('inf'))")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (size["d"] if size else 0))
    return cut(rows.groupBy("id").agg(F.min("v").alias("v")))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float32).reshape(len(column), -1)


def nearest(x: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    out = np.empty((len(x), min(n, len(centroids))), np.int32)
    half = (centroids.astype(np.float64) ** 2).sum(axis=1) / 2
    for lo in range(0, len(x), 4096):
        d = half - x[lo : lo + 4096].astype(np.float64) @ centroids.T.astype(np.float64)
        if n == 1:
            out[lo : lo + 4096, 0] = d.argmin(axis=1)
        else:
            some = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
            order = np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable")
            out[lo : lo + 4096] = np.take_along_axis(some, order, axis=1)
    return out


def padded(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows as (rows, parts, width), followed by zeros where parts of one width need more dimensions."""
    width = -(-x.shape[1] // parts)
    more = width * parts - x.shape[1]
    return (np.pad(x, ((0, 0), (0, more))) if more else x).reshape(len(x), parts, width)


def sample(rows: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """About so many of n rows, chosen by their identifiers' hashes."""
    if n <= size:
        return rows
    return cut(rows.where(F.pmod(F.xxhash64(F.lit(seed + 3), "id"), F.lit(1 << 30)) < int(size / n * (1 << 30))))


def _chosen(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """n rows in the order of their identifiers' hashes."""
    got = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n).select("v").toArrow()
    return np.concatenate([matrix(c) for c in got.column("v").chunks])


def _add(table: pa.Table) -> pa.Table:
    """Sums of blocks of centroids: from every task, as they come."""
    sums = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
    return pa.table({"block": table.column("block")[:1], "sums": [sums.tobytes()]})


def _lloyd(rows: DataFrame, start: np.ndarray, coarse: np.ndarray | None, steps: int) -> np.ndarray:
    """Centroids (groups, codes, dimensions): of whole rows (one group) or of the parts of residuals to the coarse ones."""
    centroids = start
    groups, codes, width = start.shape
    for _ in range(steps):
        sent = rows.sparkSession.sparkContext.broadcast((centroids, coarse))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, lists = sent.value  # noqa: B023
            total = np.zeros((groups, codes, width + 1))
            for b in batches:
                x = matrix(b.column(0))
                if lists is not None:
                    x = x - lists[nearest(x, lists)[:, 0]]
                x = padded(x, groups)
                for g in range(groups):
                    to = nearest(x[:, g], c[g])[:, 0]
                    total[g, :, width] += np.bincount(to, minlength=codes)
                    for d in range(width):
                        total[g, :, d] += np.bincount(to, weights=x[:, g, d], minlength=codes)
            flat = total.reshape(groups * codes, width + 1)
            blocks = range(0, len(flat), BLOCK)
            yield pa.record_batch([pa.array([k // BLOCK for k in blocks], pa.int32()), pa.array([flat[k : k + BLOCK].tobytes() for k in blocks], pa.binary())], names=["block", "sums"])

        sums = rows.select("v").mapInArrow(assign, "block int, sums binary").groupBy("block").applyInArrow(_add, "block int, sums binary").collect()
        total = np.concatenate([np.frombuffer(r["sums"], np.float64) for r in sorted(sums, key=lambda r: r["block"])]).reshape(groups, codes, width + 1)
        n = total[:, :, width:]
        centroids = np.where(n > 0, total[:, :, :width] / np.maximum(n, 1), centroids).astype(np.float32)  # an empty one stays
        sent.unpersist()
    return centroids


def index(rows: DataFrame, parts: int, codes: int, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coarse centroids (lists, dimensions) and codebooks (parts, codes, width of a part)."""
    n = rows.count()
    lists = math.ceil(math.sqrt(n) / 2)
    some = sample(rows, n, max(FIT_ROWS, FIT_LIST * lists), seed)
    coarse = _lloyd(some, _chosen(some, lists, seed)[None], None, steps)[0]
    first = _chosen(some, min(codes, n), seed + 1)
    first = padded(first - coarse[nearest(first, coarse)[:, 0]], parts).transpose(1, 0, 2)
    return coarse, _lloyd(some, np.ascontiguousarray(first), coarse, steps)


def code_distances(r: np.ndarray, books: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Squared distances of residuals (rows, parts, dimensions of a part) to codes."""
    d = np.zeros((len(r), len(code)), np.float32)
    for p in range(len(books)):
        tables = ((r[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
        d += tables[:, code[:, p]]
    return d


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def places(coded: DataFrame, coarse: np.ndarray, books: np.ndarray, k: int, tuned_on: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the true neighbours of some rows: the place of the list among the row's lists, and of the code among those of the list's other rows."""
    parts = len(books)
    some = coded.select("id", "v").orderBy(F.xxhash64(F.lit(seed + 2), "id"), "id").limit(tuned_on).toArrow()
    q_ids, q = some.column("id").to_numpy(), np.concatenate([matrix(c) for c in some.column("v").chunks])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                part = part.take(pa.array(np.argsort(part.column(0).to_numpy())))
                ids, x, lists = part.column(0).to_numpy(), matrix(part.column(1)), part.column(2).to_numpy()
                d = (q.astype(np.float64) ** 2).sum(axis=1)[:, None] + (x.astype(np.float64) ** 2).sum(axis=1) - 2 * q.astype(np.float64) @ x.T.astype(np.float64)
                d[q_ids[:, None] == ids] = np.inf
                best = smallest(d, min(k, len(ids)))
                d = np.take_along_axis(d, best, axis=1)
                row, col = np.nonzero(np.isfinite(d))
                at = best[row, col]
                yield pa.record_batch([row.astype(np.int32), d[row, col], ids[at], lists[at], part.column(3).take(pa.array(at))], names=["q", "d", "id", "list", "code"])

    near = coded.select("id", "v", "list", "code").mapInArrow(compare, "q int, d double, id bigint, list int, code binary")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("r") <= k)
    near = near.orderBy("list", "q", "id").toArrow().combine_chunks()
    if not near.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, who, held_in = (near.column(c).to_numpy() for c in ("q", "id", "list"))
    begins = np.append(np.unique(held_in, return_index=True)[1], len(held_in))
    wanted = {int(held_in[a]): slice(a, b) for a, b in zip(begins, begins[1:], strict=False)}
    own_code, own = _codes(near.column("code"), parts), np.empty(len(of), np.float32)
    for j, at in wanted.items():
        askers, row = np.unique(of[at], return_inverse=True)
        own[at] = code_distances(padded(q[askers] - coarse[j], parts), books, own_code[at])[row, np.arange(len(row))]
    sent = coded.sparkSession.sparkContext.broadcast((coarse, books, q_ids, q))

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows of a list come before a neighbour: of every task, to be added up."""
        c, book, asker_ids, asker = sent.value
        n = np.zeros(len(of), np.int64)
        for b in batches:
            ids, lists, code = b.column(0).to_numpy(), b.column(1).to_numpy(), _codes(b.column(2), parts)
            order = np.argsort(lists, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
                if not len(rows) or (at := wanted.get(int(lists[rows[0]]))) is None:
                    continue
                askers, row = np.unique(of[at], return_inverse=True)
                for lo in range(0, len(rows), 1024):
                    some = rows[lo : lo + 1024]
                    d = code_distances(padded(asker[askers] - c[lists[rows[0]]], parts), book, code[some])
                    d[asker_ids[askers][:, None] == ids[some]] = np.inf
                    d = d[row]
                    n[at] += ((d < own[at, None]) | ((d == own[at, None]) & (ids[some] < who[at, None]))).sum(axis=1)
        yield pa.record_batch([pa.array(np.arange(len(n))), pa.array(n)], names=["at", "n"])

    ranks = np.zeros(len(of), np.int64)
    for r in coded.select("id", "list", "code").mapInArrow(ahead, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        ranks[r["at"]] = r["n"]
    order = np.argsort(nearest(q, coarse, len(coarse)), axis=1)  # each list's place among a row's lists
    return order[of, held_in].astype(np.int64), ranks


def tuned(place: np.ndarray, rank: np.ndarray, rows: float, dims: int, parts: int, k: int, reach: float, probes: int | None, rerank: int | None) -> tuple[int, int]:
    """(lists probed, codes reranked), as given or of the least work for lists of so many rows, by which a share `reach` of the neighbours is found.

    At least k of a list are reranked, so that there are k neighbours.  Where what
    is given doesn't let so many be found, all that it lets be found are wanted."""
    best = (math.inf, 1, k)
    needed = math.ceil(reach * len(place))
    may = (place < (probes or math.inf)) & (rank < (rerank or math.inf))
    needed = min(needed, int(may.sum()))
    for p in [probes] if probes else range(1, int(place.max(initial=0)) + 2):
        at = np.sort(rank[may & (place < p)])
        if len(at) >= needed:
            r = rerank or max(k, int(at[needed - 1]) + 1 if needed else k)
            best = min(best, (p * (rows * parts + 2 * (r + k) * dims), p, r))
    return best[1:]


def lists_of(q: np.ndarray, coarse: np.ndarray, sizes: np.ndarray, n_probes: int, k: int) -> pa.ListArray:
    """Each row's nearest lists, as many as are probed; more where these don't hold k other rows."""
    near = nearest(q, coarse, n_probes)
    rows = list(near)
    for r in np.flatnonzero(sizes[near].sum(axis=1) <= k):
        order = nearest(q[r : r + 1], coarse, len(coarse))[0]
        rows[r] = order[: int(np.searchsorted(np.cumsum(sizes[order]), k, side="right")) + 1]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate(rows or [np.zeros(0, np.int32)]).astype(np.int32)))


def smallest(d: np.ndarray, take: int) -> np.ndarray:
    """The places of each row's `take` smallest; of equal ones the first."""
    best = np.argpartition(d, take - 1, axis=1)[:, :take]
    last = np.take_along_axis(d, best, axis=1).max(axis=1, keepdims=True)
    more = np.flatnonzero((d <= last).sum(axis=1) > take)
    best[more] = np.argsort(d[more], axis=1, kind="stable")[:, :take]
    return best


def search_list(ids: np.ndarray, x: np.ndarray, code: np.ndarray, q_ids: np.ndarray, q: np.ndarray, centroid: np.ndarray, books: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, identifier, squared distance) of each query's best k in a list, by exact distance among its `rerank` best codes."""
    parts = len(books)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    by_id = np.argsort(ids)
    ids, x, code = ids[by_id], x[by_id], code[by_id]
    take = min(rerank + 1, len(ids))
    step = max(1, min(256, EXACT // (take * q.shape[1])))
    for lo in range(0, len(q), step):
        some = q[lo : lo + step]
        d = code_distances(padded(some - centroid, parts), books, code)
        best = smallest(d, take)
        exact = ((x[best].astype(np.float64) - some[:, None, :].astype(np.float64)) ** 2).sum(axis=2)
        who = ids[best]
        exact[who == q_ids[lo : lo + step, None]] = np.inf
        order = np.lexsort((who, exact), axis=1)[:, :k]
        exact, who = np.take_along_axis(exact, order, axis=1), np.take_along_axis(who, order, axis=1)
        row, col = np.nonzero(np.isfinite(exact))
        out.append((row + lo, who[row, col], exact[row, col]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def neighbours(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, every: int = EVERY, probes: int | None = None, rerank: int | None = None, reach: float = REACH, tuned_on: int = TUNED_ON, parts: int = PARTS, codes: int = CODES, steps: int = STEPS, seed: int = SEED) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest rows of every row whose identifier `every` divides, by Euclidean distance."""
    rows = usable(table, vec_id, embedding)
    spark = table.sparkSession
    form = "vec_id bigint, rank int, neighbour_id bigint, distance double"
    first = rows.first()
    if first is None:
        return spark.createDataFrame([], form)
    parts = min(parts, len(first["v"]))
    coarse, books = index(rows, parts, codes, steps, seed)
    sent = spark.sparkContext.broadcast((coarse, books))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, book = sent.value
        for b in batches:
            x = matrix(b.column(1))
            near = nearest(x, c)[:, 0]
            r = padded(x - c[near], parts)
            code = np.stack([nearest(r[:, p], book[p])[:, 0] for p in range(parts)], axis=1).astype(np.uint8)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([row.tobytes() for row in code], pa.binary()), pa.array(near)], names=["id", "v", "code", "list"])

    coded = cut(rows.mapInArrow(encode, "id bigint, v array<float>, code binary, list int"))
    held_by = dict(coded.groupBy("list").count().collect())  # a row for each list
    n_probes, n_rerank = probes, rerank
    if probes is None or rerank is None:
        place, rank = places(coded, coarse, books, k, tuned_on, seed)
        n_probes, n_rerank = tuned(place, rank, sum(held_by.values()) / len(held_by), coarse.shape[1], parts, k, reach, probes, rerank)

    sizes = np.array([held_by.get(j, 0) for j in range(len(coarse))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), lists_of(matrix(b.column(1)), sent.value[0], sizes, n_probes, k)], names=["q_id", "q_v", "lists"])

    asked = coded.where(F.col("id") % every == 0).select("id", "v").mapInArrow(ask, "q_id bigint, q_v array<float>, lists array<int>").select("q_id", "q_v", F.explode("lists").alias("list"))
    asked_of = dict(asked.groupBy("list").count().collect())
    size = {j: (max(1, math.ceil(held_by[j] / LIST_ROWS)), max(1, math.ceil(n / QUERY_ROWS))) for j, n in asked_of.items() if j in held_by}
    split = small(spark.createDataFrame([(a, *b) for a, b in size.items()], "list int, segments int, chunks int"))
    held = coded.select("id", "v", "code", "list").join(split, "list")
    held = held.withColumn("segment", F.pmod(F.xxhash64("id"), F.col("segments")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asked = asked.join(split, "list")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("q_id"), F.col("chunks")).cast("int")).withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        none = {"q": pa.array([], pa.int64()), "found": pa.array([], pa.list_(pa.struct([("d", pa.float64()), ("i", pa.int64())])))}
        if not left.num_rows or not right.num_rows:
            return pa.table(none)
        c, book = sent.value
        code = _codes(left.column("code"), parts)
        x, q = (matrix(c.combine_chunks()) for c in (left.column("v"), right.column("q_v")))
        q_ids = right.column("q_id").to_numpy()
        row, who, d = search_list(left.column("id").to_numpy(), x, code, q_ids, q, c[key[0].as_py()], book, k, n_rerank)
        used, begin = np.unique(row, return_index=True)
        found = pa.ListArray.from_arrays(np.append(begin, len(row)).astype(np.int32), pa.StructArray.from_arrays([pa.array(d), pa.array(who)], names=["d", "i"]))
        return pa.table({"q": q_ids[used], "found": found})

    keys = ["list", "segment", "chunk"]
    held = held.select(*[F.col(c).alias(f"l_{c}") for c in keys], "id", "v", "code")
    met = held.groupBy(*[f"l_{c}" for c in keys]).cogroup(asked.select(*keys, "q_id", "q_v").groupBy(*keys)).applyInArrow(meet, "q bigint, found array<struct<d: double, i: bigint>>")
    best = met.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    return best.select("q", F.posexplode("found").alias("p", "f")).select(
        F.col("q").alias("vec_id"), (F.col("p") + 1).alias("rank"), F.col("f.i").alias("neighbour_id"), F.sqrt("f.d").alias("distance")
    )
