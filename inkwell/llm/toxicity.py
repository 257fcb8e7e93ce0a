"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct character n-grams of several lengths, in
lower case, hashed to buckets.  From labelled texts each bucket gets the log
ratio r of the shares of the toxic and of the other documents that have it,
both smoothed towards its share of all, so that what is rare tells little; a
logistic regression is then trained on features worth r instead of 1.  r is
folded into its weights, so scoring a text is one sum over its features.  The
labels' own odds are taken off the score: it is the evidence in the text, the
log of how much likelier it is if toxic than if not.

Whole texts are scored, wherever in them the n-grams stand.  Training uses at
most about `max_labelled` labelled rows, chosen by their identifiers' hashes;
their features stay in the executors' partitions, and the weights have a fixed
size (a number for each bucket).

Cases: an empty, very short or null text has no features, the score of the bias
alone, and isn't toxic, as any text whose n-grams don't speak for it; a very long text is trained on and scored whole, in
memory that grows with that one text; rows without identifier are scored, with a null one; repeated rows are scored
each; labels that are null, or whose document is missing, aren't used; several
labels of a document count each; where there are not both kinds of labels,
every score is 0 and nothing is toxic; an empty table gives an empty result;
other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import linear
from inkwell.llm.common import cut, text_slices

LENGTHS = (3, 4, 5, 6, 7)
BUCKETS = 1 << 20
MAX_LABELLED = 5_000
#: A text whose score, the log of a likelihood ratio, is at least this is toxic.
CUT = 0.0
#: Documents that the smoothing counts as.
ALPHA = 10.0
L2, STEPS, TOLERANCE = 20.0, 40, 1e-4
#: Buckets of a range, and bytes of a stretch of a range's features.
PART, STRETCH = 1 << 16, 1 << 24
_LOWER = np.array([ord(chr(c).lower()) if not 0xD800 <= c < 0xE000 and len(chr(c).lower()) == 1 else c for c in range(0x10000)], dtype=np.uint32)


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case of some UTF-8 texts, and each text's offsets among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.where(points < 0x10000, _LOWER[np.minimum(points, 0xFFFF)], points), begins[at]


def features(data: np.ndarray, at: np.ndarray, lengths: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features (buckets, a power of 2 up to 2**24) of some texts, one text's after another's, and the texts' offsets."""
    points, c_at = characters(data, at)
    n, bits = np.diff(c_at), buckets.bit_length() - 1
    kind = np.uint32 if len(n) <= 1 << (32 - bits) else np.uint64
    rows = np.repeat(np.arange(len(n), dtype=kind) << kind(bits), n)
    left = np.repeat(c_at[1:].astype(np.int32), n) - np.arange(len(points), dtype=np.int32)  # characters to the text's end
    h, keys = np.zeros(len(points), np.uint32), []
    for k in range(min(max(lengths, default=0), len(points))):
        h = h[: len(points) - k] * np.uint32(0x9E3779B1) + points[k:] + np.uint32(1)
        if k + 1 in lengths:
            m = (h ^ (h >> np.uint32(15)) ^ np.uint32(k * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            m = ((m ^ (m >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
            keys.append((rows[: len(h)] | m)[left[: len(h)] > k])
    key = np.concatenate(keys) if keys else np.zeros(0, kind)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    row_at = np.searchsorted(key, np.arange(len(n), dtype=np.uint64) << np.uint64(bits) if kind == np.uint64 else np.arange(len(n), dtype=kind) << kind(bits))
    return (key & kind(buckets - 1)).astype(np.uint32), np.append(row_at, len(key))


def labelled(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, lengths: tuple[int, ...], buckets: int, max_labelled: int) -> tuple[DataFrame, np.ndarray]:
    """(part, rows, n, f) and labels: the features of at most about max_labelled labelled rows, by ranges of 2**16 buckets.

    A row of the table holds a stretch of a range's features (f, 2 bytes each), and how many (n) each of some labelled rows has of them.
    """
    y = labels.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), (F.col(f"`{label}`") > 0).cast("int").alias("y")).where("i is not null and y is not null")
    share = min(1.0, max_labelled / max(1, y.count()))
    y = y.where((F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < int(share * (1 << 20))))
    x = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")
    parts = max(1, min(32, docs.sparkSession.sparkContext.defaultParallelism))
    rows = x.join(y, "i").repartition(parts, "i").select("y", "t")

    n_parts = max(1, buckets // PART)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi, data, at in text_slices(b.column(1)):
                f, f_at = features(data, at, lengths, buckets)
                raw, n = (f & (PART - 1)).astype(np.uint16), hi - lo
                cell = np.repeat(np.arange(n), np.diff(f_at)) * n_parts + f // PART
                ends = np.append(0, np.cumsum(np.bincount(cell, minlength=n * n_parts))) * 2
                packs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n * n_parts, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
                each = np.repeat(np.arange(n), n_parts)
                yield pa.record_batch([pa.array(np.tile(np.arange(n_parts, dtype=np.int32), n)), pa.array(key + each), b.column(0)[lo:hi].take(pa.array(each)), packs], names=["part", "k", "y", "f"])
                key += n

    split = cut(rows.mapInArrow(extract, "part int, k bigint, y int, f binary"))
    known = split.where("part = 0").select("k", "y").orderBy("k").toArrow()  # at most about max_labelled
    keys = known.column("k").to_numpy()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        size: dict[int, int] = {}

        def made(part: int) -> pa.RecordBatch:
            own = held.pop(part)
            size.pop(part)
            n = np.array([len(f) // 2 for _, f in own], np.int32)
            at = np.searchsorted(keys, [k for k, _ in own]).astype(np.int32)
            return pa.record_batch([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (at.tobytes(), n.tobytes(), b"".join(f for _, f in own)))], names=["part", "rows", "n", "f"])

        for b in batches:
            for part, k, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held.setdefault(part, []).append((k, f))
                size[part] = size.get(part, 0) + len(f)
                if size[part] > STRETCH:
                    yield made(part)
        for part in list(held):
            yield made(part)

    ranges = split.select("part", "k", "f").repartitionById(n_parts, "part").mapInArrow(packed, "part int, rows binary, n binary, f binary")
    return cut(ranges), known.column("y").to_numpy()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(range, rows, offsets, buckets within the range) of every stretch."""
    for b in batches:
        for part, rows, n, f in zip(b.column(0).to_pylist(), *(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
            yield part, np.frombuffer(rows, np.int32), np.append(0, np.cumsum(np.frombuffer(n, np.int32), dtype=np.int64)), np.frombuffer(f, np.uint16).astype(np.int64)


def _held(batches: Iterator[pa.RecordBatch], weight: np.ndarray) -> dict[int, tuple[list, np.ndarray]]:
    """Of each range: its stretches, and the sums of its rows' weights by bucket."""
    out: dict[int, tuple[list, np.ndarray]] = {}
    for part, rows, at, f in _stretches(batches):
        stretches, total = out.setdefault(part, ([], np.zeros(PART)))
        total += np.bincount(f, weights=np.repeat(weight[rows], np.diff(at)), minlength=PART)
        stretches.append((rows, at, f))
    return out


def _of_ranges(ranges: DataFrame, weight: np.ndarray, buckets: int) -> np.ndarray:
    """The sums of the rows' weights by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, total) in _held(batches, weight).items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    out = np.zeros(max(buckets, PART))
    for r in ranges.mapInArrow(run, "part int, sums binary").collect():
        out[r["part"] * PART : (r["part"] + 1) * PART] += np.frombuffer(r["sums"])
    return out[:buckets]


def fit(ranges: DataFrame, y: np.ndarray, buckets: int) -> tuple[np.ndarray, float] | None:
    """Weights with the log-count ratios folded in, and the bias; None where there is one kind of rows alone.

    The optimum is a weighted sum of the rows, w = r * X'a, so that the search is
    for a, with a number for each row.  In each step the executors multiply one
    vector by X r r X', a range of buckets at a time; the loss is then minimised
    over all vectors multiplied so far, which needs no further pass.
    """
    share = float((y > 0).mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return None
    toxic = _of_ranges(ranges, (y > 0).astype(float), buckets)
    others = _of_ranges(ranges, (y <= 0).astype(float), buckets)
    r = np.log((toxic + ALPHA * share) / share) - np.log((others + ALPHA * (1 - share)) / (1 - share))
    sent = ranges.sparkSession.sparkContext.broadcast((r**2).astype(np.float32))
    sign, n = np.where(y > 0, 1.0, -1.0), len(y)

    def times(a: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            square, out = sent.value, np.zeros(n)
            for part, (stretches, total) in _held(batches, a).items():
                own = square[part * PART : (part + 1) * PART]
                total = (total[: len(own)] * own).astype(np.float32)
                for rows, at, f in stretches:
                    out[rows] += linear.row_sums(total[f], at)
            yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        return sum(np.frombuffer(x["sums"]) for x in ranges.mapInArrow(run, "sums binary").collect())

    a, bias, margin, best = np.zeros(n), 0.0, np.zeros(n), n * np.log(2)
    basis, images = np.zeros((n, 0)), np.zeros((n, 0))
    c = np.zeros(0)
    for _ in range(STEPS):
        new = L2 * a - sign / (1 + np.exp(np.minimum(sign * margin, 500)))  # the gradient, as a sum of rows
        image = times(new)
        for _ in range(2):  # orthogonal to the vectors before it
            along = images.T @ new
            new, image = new - basis @ along, image - images @ along
        size = float(new @ image)
        if size <= 1e-12:
            break
        basis, images, c = np.column_stack([basis, new / np.sqrt(size)]), np.column_stack([images, image / np.sqrt(size)]), np.append(c, 0.0)
        c, bias, loss = _least(images, sign, c, bias)
        a, margin = basis @ c, images @ c + bias
        done = best - loss < TOLERANCE * max(1.0, abs(best))
        best = loss
        if done:
            break
    w = _of_ranges(ranges, a, buckets) * r**2
    sent.destroy()
    return w.astype(np.float32), float(bias - np.log(share / (1 - share)))


def _least(images: np.ndarray, sign: np.ndarray, c: np.ndarray, bias: float) -> tuple[np.ndarray, float, float]:
    """The minimum of the loss over combinations of the vectors multiplied so far, by Newton's method."""
    x = np.column_stack([images, np.ones(len(sign))])
    ridge = np.append(np.full(len(c), L2), 1e-9)
    of = lambda v: float(np.logaddexp(0, -sign * (x @ v)).sum() + (ridge * v * v).sum() / 2)
    v = np.append(c, bias)
    loss = of(v)
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(sign * (x @ v), -500, 500)))
        grad = -x.T @ (sign * p) + ridge * v
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        t = 1.0
        while (new := of(v - t * step)) > loss - 1e-4 * t * float(grad @ step) and t > 1e-8:
            t /= 2
        if new >= loss:
            break
        v, before, loss = v - t * step, loss, new
        if before - loss < 1e-9 * max(1.0, abs(before)):
            break
    return v[:-1], float(v[-1]), loss


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", lengths: tuple[int, ...] = LENGTHS, buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Weights (one for each bucket) and bias, from at most about max_labelled labelled rows."""
    made = fit(*labelled(docs, labels, text, doc_id, label, lengths, buckets, max_labelled), buckets)
    return (np.zeros(buckets, np.float32), float("-inf")) if made is None else made


def scores(texts: pa.Array, w: np.ndarray, b: float, lengths: tuple[int, ...], buckets: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Each text's score, and whether it is toxic; one whose features don't speak for it isn't, whatever the bias."""
    out, toxic = np.zeros(len(texts)), np.zeros(len(texts), bool)
    if b == float("-inf"):
        return out, toxic
    for lo, hi, data, at in text_slices(texts):
        f, f_at = features(data, at, lengths, buckets)
        evidence = linear.row_sums(w[f], f_at)
        out[lo:hi] = b + evidence
        toxic[lo:hi] = (out[lo:hi] >= cut) & (evidence > 0)
    return out, toxic


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", lengths: tuple[int, ...] = LENGTHS, buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED, cut: float = CUT) -> DataFrame:
    """(doc_id, score, toxic) of every document."""
    w, b = train(docs, labels, text, doc_id, label, lengths, buckets, max_labelled)
    sent = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            s, toxic = scores(x.column(1), sent.value, b, lengths, buckets, cut)
            yield pa.record_batch([x.column(0), pa.array(s), pa.array(toxic)], names=["doc_id", "score", "toxic"])

    return docs.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`")).mapInArrow(run, "doc_id bigint, score double, toxic boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", lengths: tuple[int, ...] = LENGTHS, buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED, cut: float = CUT) -> DataFrame:
    """The rows of docs that aren't toxic, in its columns; no shuffle of texts."""
    w, b = train(docs, labels, text, doc_id, label, lengths, buckets, max_labelled)
    if b == float("-inf"):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(w)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(~scores(x.column(where), sent.value, b, lengths, buckets, cut)[1]))

    return docs.mapInArrow(run, docs.schema)
