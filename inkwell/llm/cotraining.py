"""Quality classifier by co-training of two views of a document.

The text view is a vector of measures of its characters, words and lines, byte
pairs' shares, and the sets of its words and of its character 4-grams (those of
a fixed eighth of all 4-grams, by their hashes), in WORDS hashed buckets each; the metadata view knows only its source, language
and recorded size, each value a feature of its own (hashed to META buckets, of
which a number of values that is small against it shares none).  Each has a
logistic regression.  In every round both are trained on the labelled documents
and on the unlabelled ones of which the other view was confident in the round
before (at least `sure` for a class), at a lower weight.  After the last round
each view's log-odds are calibrated on labelled documents held back from
training, and the calibrated views are combined as independent evidence: their
log-odds are added and the labels' own log-odds, counted twice by that, taken
off once.

All documents are scored, and all unlabelled ones may become pseudo-labels.
Features stay in the executors' partitions; models have a fixed size.  Rows of
equal metadata are added up before the metadata view is trained.

Cases: an empty or null text has no feature but the bias; a very long text
counts whole, in memory that grows with that one text; null metadata is a value
of its own; rows without identifier are scored, and unlabelled; several labels
of a document count as their majority, a tie as good; labels that are null or
without document aren't used; where there are not both kinds of labels, no
score is known (null) and every document is kept; repeated rows are scored
each; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import linear
from inkwell.llm.common import LOWER, SPACE, cut, mix, text_slices, word_hashes

PAIRS = 64
MEASURES = 12
#: Buckets of words and of 4-grams (16 bits), and of metadata.
WORDS, META = 1 << 16, 1 << 18
GRAM, SIZES = 4, 12
DENSE = MEASURES + PAIRS
#: Regularisation of the text view's dense and set features, and of the metadata view; steps of a fit.
L2_DENSE, L2_SETS, L2_META, STEPS = 0.01, 2.0, 0.1, 40
#: A fit ends when a step lowers the loss by less than this for each labelled document.
GAIN = 1e-3
#: Different combinations of metadata up to which these are trained on where they are collected.
FEW = 200_000
#: Labelled rows that calibration uses at most, about.
MAX_HELD = 200_000
ROUNDS = 3
SURE = 0.95
WEIGHT = 0.5
#: A document is kept if its score, the probability of being good, is at least this.
KEEP = 0.5
SEED = 9
_CLASS = np.full(256, 5, np.uint8)  # other bytes
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 13, 32), b".,;:'\"!?()-")):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 6


def text_vectors(texts: pa.Array) -> np.ndarray:
    """(rows, MEASURES + PAIRS): shares of kinds of bytes, words' and lines' habits, and byte pairs' shares."""
    out = np.zeros((len(texts), MEASURES + PAIRS), np.float32)
    for lo, hi, data, at in text_slices(texts):
        n = np.diff(at).astype(np.float64)
        some = np.maximum(n, 1)
        rows = np.repeat(np.arange(hi - lo), np.diff(at))
        if not len(data):
            continue
        kinds = np.bincount(rows * 8 + _CLASS[data], minlength=(hi - lo) * 8).reshape(-1, 8)[:, :7]
        out[lo:hi, :7] = kinds / some[:, None]
        h, w_at = word_hashes(data, at)
        words = np.diff(w_at)
        key = np.repeat(np.arange(hi - lo, dtype=np.uint64), words) << np.uint64(40) | h >> np.uint64(24)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        row = (key[first] >> np.uint64(40)).astype(np.int64)
        times = np.diff(np.append(first, len(key)))
        different = np.bincount(row, minlength=hi - lo)
        most = np.zeros(hi - lo)
        np.maximum.at(most, row, times)
        lines = np.bincount(rows[data == 10], minlength=hi - lo) + 1
        out[lo:hi, 7] = np.log1p(words) / 8
        out[lo:hi, 8] = n / np.maximum(words, 1) / 16
        out[lo:hi, 9] = different / np.maximum(words, 1)
        out[lo:hi, 10] = most / np.maximum(words, 1)
        out[lo:hi, 11] = np.log1p(words / lines) / 4
        inside = rows[1:] == rows[:-1]
        pair = _PAIR[data[:-1].astype(np.int64) << 8 | data[1:]]
        share = np.bincount((rows[1:] * PAIRS + pair)[inside], minlength=(hi - lo) * PAIRS).reshape(-1, PAIRS)
        out[lo:hi, MEASURES:] = np.sqrt(share / some[:, None])
        out[lo:hi][n == 0] = 0
    return out


_PAIR = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(PAIRS)).astype(np.int64)


def text_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct words (buckets 0 to WORDS) and 4-grams of words (WORDS to 2 * WORDS), one text's after another's, and the offsets."""
    out, sizes = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
    for lo, hi, data, at in text_slices(texts):
        h, w_at = word_hashes(data, at)
        words = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(w_at)) << np.uint64(32) | h >> np.uint64(48)
        rows = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(at))
        low = LOWER[data].astype(np.uint64)
        low[SPACE[data]] = 32
        grams = np.zeros(0, np.uint64)
        if len(data) >= GRAM:
            n = len(data) - GRAM + 1
            code = low[:n] | low[1 : n + 1] << np.uint64(8) | low[2 : n + 2] << np.uint64(16) | low[3 : n + 3] << np.uint64(24)
            inside = rows[:n] == rows[GRAM - 1 :]
            code, of = mix(code[inside]), rows[:n][inside]
            some = code & np.uint64(7) == 0
            grams = of[some] << np.uint64(32) | np.uint64(WORDS) | code[some] >> np.uint64(48)
        key = np.sort(np.concatenate([words, grams]))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        out.append((key & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        sizes.append(np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=hi - lo))
    return np.concatenate(out), np.cumsum(np.concatenate(sizes))


def views(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, source: str, lang: str, size: str, label: str) -> DataFrame:
    """(i, y, held, m, x, f): identifier, label, whether it is held back for calibration, buckets of metadata, measures, and packed sets.

    The sets are packed as numbers of two bytes: how many words there are, then words and 4-grams.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t"), F.col(f"`{source}`").cast("string").alias("s"), F.col(f"`{lang}`").cast("string").alias("l"), F.col(f"`{size}`").cast("double").alias("z"))
    steps = F.when(F.col("z").isNull() | (F.col("z") < 1), 0).otherwise(F.least(F.floor(F.log2("z") / 1.5) + 1, F.lit(SIZES - 1)))
    place = lambda kind, c: F.pmod(F.xxhash64(F.lit(kind), c.cast("string"), c.isNull()), F.lit(META)).cast("int")
    slim = rows.select("i", "t", F.array(place("source", F.col("s")), place("lang", F.col("l")), place("size", steps)).alias("m"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                some = b.slice(lo, 512)
                v = text_vectors(some.column(1))
                f, at = text_sets(some.column(1))
                packs = [f[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([some.column(0), some.column(2), pa.array([r.tobytes() for r in v], pa.binary()), pa.array([_pack(np.frombuffer(p, np.uint32)) for p in packs], pa.binary())], names=["i", "m", "x", "f"])

    made = slim.mapInArrow(measure, "i bigint, m array<int>, x binary, f binary")
    y = labels.select(F.col(f"`{doc_id}`").cast("bigint").alias("li"), (F.col(f"`{label}`") > 0).cast("double").alias("q"))
    y = y.where("li is not null and q is not null").groupBy("li").agg((F.avg("q") >= 0.5).cast("double").alias("y"))
    held = F.coalesce((F.pmod(F.xxhash64(F.lit(SEED), "i"), F.lit(5)) == 0) & F.col("y").isNotNull(), F.lit(False))
    return cut(slim_join(made, y).select("i", "y", held.alias("held"), "m", "x", "f"))


def slim_join(made: DataFrame, y: DataFrame) -> DataFrame:
    """made with y of its identifier; labels are sent to all where they are few, as checked, so that no features are shuffled."""
    few = y.limit(FEW + 1).count() <= FEW
    return made.join(F.broadcast(y) if few else y, F.col("i") == F.col("li"), "left")


def _pack(f: np.ndarray) -> bytes:
    words = int(np.searchsorted(f, WORDS))
    return np.uint32(words).tobytes() + (f & np.uint32(0xFFFF)).astype(np.uint16).tobytes()


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of some rows, laid end to end, and their offsets."""
    raw = column.cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // 2
    data = np.frombuffer(raw.buffers()[2], np.uint16)[at[0] : at[-1]] if len(raw) else np.zeros(0, np.uint16)
    at = at - at[0]
    words = data[at[:-1]].astype(np.int64) | data[at[:-1] + 1].astype(np.int64) << 16
    keep = np.ones(len(data), bool)
    keep[at[:-1]] = keep[at[:-1] + 1] = False
    f = data.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(at[:-1] + 2, np.diff(at))
    f += WORDS * (place >= np.repeat(words, np.diff(at)))
    return f[keep], at - 2 * np.arange(len(at))


class TextView:
    """Weights of measures (standardised), of sets (each feature worth 1 over the root of the row's number), and the bias last."""

    def __init__(self, w: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> None:
        self.w, self.mean, self.deviation = w, mean, deviation

    def parts(self, x: pa.Array, f: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        dense = np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(-1, DENSE)
        dense = (dense - self.mean) / self.deviation
        sets, at = _unpacked(f)
        return dense, sets, at, 1 / np.sqrt(np.maximum(1, np.diff(at)))

    def odds(self, dense: np.ndarray, sets: np.ndarray, at: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return dense @ self.w[:DENSE] + linear.row_sums(self.w[DENSE:-1][sets], at) * scale + self.w[-1]


def _metadata(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)


def _goals(y: np.ndarray, held: np.ndarray, other: np.ndarray | None, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(-1 or 1, weight): labels, and the other view's confident guesses where there is none; weight 0 for rows that aren't trained on."""
    known = ~np.isnan(y)
    goal, weight = np.where(y > 0, 1.0, -1.0), np.where(known, 1.0, 0.0)
    if other is not None:
        goal = np.where(known, goal, np.sign(other))
        weight = np.where(known, 1.0, np.where(np.abs(other) >= limit, WEIGHT, 0.0))
    return goal, np.where(held, 0.0, weight)


def _labels(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column(1).to_numpy(zero_copy_only=False).astype(np.float64), b.column(2).to_numpy(zero_copy_only=False)


def fit_text(rows: DataFrame, start: np.ndarray, mean: np.ndarray, deviation: np.ndarray, meta: np.ndarray | None, limit: float, parts: int, labelled: int) -> np.ndarray:
    """The text view's weights, from labels and the metadata view's guesses."""
    ridge = np.concatenate([np.full(DENSE, L2_DENSE), np.full(2 * WORDS, L2_SETS), [0.0]])

    def work(batches: Iterator[pa.RecordBatch], state: tuple) -> tuple[list[float], np.ndarray]:
        w, other = state
        view, total, grad = TextView(w, mean, deviation), 0.0, np.zeros(len(w))
        for b in batches:
            y, held = _labels(b)
            goal, weight = _goals(y, held, None if other is None else other[_metadata(b.column(3))].sum(axis=1) + other[META], limit)
            some = np.flatnonzero(weight)
            if not len(some):
                continue
            for lo in range(0, len(some), 512):
                at_ = pa.array(some[lo : lo + 512])
                own = view.parts(b.column(4).take(at_), b.column(5).take(at_))
                g, v = goal[some[lo : lo + 512]], weight[some[lo : lo + 512]]
                m = g * view.odds(*own)
                slope = -g * v / (1 + np.exp(np.minimum(m, 500)))
                grad[:DENSE] += own[0].T @ slope
                grad[DENSE:-1] += np.bincount(own[1], weights=np.repeat(slope * own[3], np.diff(own[2])), minlength=2 * WORDS)
                grad[-1] += slope.sum()
                total += float((v * np.logaddexp(0, -m)).sum())
        return [total], grad

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        (total,), grad = linear.summed(rows, (w.astype(np.float32), meta), work, parts)
        return total + float((ridge * w * w).sum()) / 2, grad + ridge * w

    return linear.minimise(loss, start, STEPS, tolerance=1e-3, enough=GAIN * labelled)


def fit_meta(rows: DataFrame, text: TextView | None, limit: float) -> np.ndarray:
    """The metadata view's weights (the bias last), from labels and the text view's guesses: rows of equal metadata are added up first."""
    sent = rows.sparkSession.sparkContext.broadcast(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view, found = sent.value, {}
        for b in batches:
            y, held = _labels(b)
            other = None if view is None else np.concatenate([view.odds(*view.parts(b.column(4).slice(lo, 512), b.column(5).slice(lo, 512))) for lo in range(0, b.num_rows, 512)] or [np.zeros(0)])
            goal, weight = _goals(y, held, other, limit)
            some = weight > 0
            keys, which = np.unique(_metadata(b.column(3))[some], axis=0, return_inverse=True)
            good, bad = (np.bincount(which.ravel(), weights=weight[some] * (goal[some] == k), minlength=len(keys)) for k in (1, -1))
            for key, p, q in zip(map(tuple, keys.tolist()), good, bad, strict=True):
                was = found.get(key, (0.0, 0.0))
                found[key] = (was[0] + p, was[1] + q)
        yield pa.record_batch([pa.array([list(k) for k in found], pa.list_(pa.int32())), pa.array([v[0] for v in found.values()], pa.float64()), pa.array([v[1] for v in found.values()], pa.float64())], names=["m", "good", "bad"])

    few = cut(rows.mapInArrow(run, "m array<int>, good double, bad double").groupBy("m").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))

    def slope(m: np.ndarray, good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        odds = w[m].sum(axis=1) + w[META]
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        g = (good + bad) * p - good
        grad = np.bincount(m.ravel(), weights=np.repeat(g, 3), minlength=META + 1)
        grad[META] = g.sum()
        return float((good * np.logaddexp(0, -odds) + bad * np.logaddexp(0, odds)).sum()), grad

    n = few.count()
    if n <= FEW:
        held = few.orderBy("m").toArrow()
        m, good, bad = _metadata(held.column("m").combine_chunks()) if n else np.zeros((0, 3), int), held.column("good").to_numpy(), held.column("bad").to_numpy()
        of = lambda w: slope(m, good, bad, w)
    else:

        def work(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> tuple[list[float], np.ndarray]:
            total, grad = 0.0, np.zeros(META + 1)
            for b in batches:
                t, g = slope(_metadata(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy(), w)
                total, grad = total + t, grad + g
            return [total], grad

        many = few.rdd.getNumPartitions()

        def of(w: np.ndarray) -> tuple[float, np.ndarray]:
            (total,), grad = linear.summed(few, w, work, many)
            return total, grad

    ridge = np.append(np.full(META, L2_META), 0.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        total, grad = of(w)
        return total + float((ridge * w * w).sum()) / 2, grad + ridge * w

    return linear.minimise(loss, np.zeros(META + 1), STEPS)


def _calibrated(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Factor and summand by which a view's log-odds fit labels that it wasn't trained on."""
    sign = np.where(y > 0, 1.0, -1.0)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        m = sign * (v[0] * odds + v[1])
        g = -sign / (1 + np.exp(np.minimum(m, 500)))
        return float(np.logaddexp(0, -m).sum() + 1e-3 * (v @ v)), np.array([g @ odds, g.sum()]) + 2e-3 * v

    v = linear.minimise(loss, np.array([1.0, 0.0]), 100, tolerance=1e-9)
    return float(v[0]), float(v[1])


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang", size: str = "n_chars", label: str = "quality", rounds: int = ROUNDS, sure: float = SURE, keep: float = KEEP) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of every document."""
    rows = views(docs, labels, text, doc_id, source, lang, size, label)
    # a class needs documents on both sides of the split
    kinds = {(r["y"], r["held"]): r["count"] for r in rows.where("y is not null").groupBy("y", "held").count().collect()}
    if not all(kinds.get((c, h)) for c in (0.0, 1.0) for h in (False, True)):
        none = F.lit(None).cast("double")
        return rows.select(F.col("i").alias("doc_id"), none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("keep"))
    good, bad = (sum(n for (c, _), n in kinds.items() if c == k) for k in (1.0, 0.0))
    prior, limit = math.log(good / bad), math.log(sure / (1 - sure))
    parts = rows.rdd.getNumPartitions()

    def moments(batches: Iterator[pa.RecordBatch], _: None) -> tuple[list[float], np.ndarray]:
        n, total = 0.0, np.zeros((2, DENSE))
        for b in batches:
            x = np.frombuffer(b"".join(b.column(4).to_pylist()), np.float32).reshape(-1, DENSE).astype(np.float64)
            n, total = n + len(x), total + [x.sum(axis=0), (x * x).sum(axis=0)]
        return [n], total.ravel()

    (n,), sums = linear.summed(rows, None, moments, parts)
    mean = sums[:DENSE] / n
    deviation = np.sqrt(np.maximum(sums[DENSE:] / n - mean**2, 0))
    deviation = np.where(deviation > 1e-6, deviation, 1.0)
    known = cut(rows.where("y is not null"))
    w, m = fit_text(known, np.zeros(DENSE + 2 * WORDS + 1), mean, deviation, None, limit, parts, good + bad), fit_meta(known, None, limit)
    for _ in range(1, rounds):  # each learns from what the other knew before
        w, m = fit_text(rows, w, mean, deviation, m, limit, parts, good + bad), fit_meta(rows, TextView(w.astype(np.float32), mean, deviation), limit)
    sent = docs.sparkSession.sparkContext.broadcast((TextView(w.astype(np.float32), mean, deviation), m))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view, meta = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                some = b.slice(lo, 512)
                yield pa.record_batch([some.column(0), some.column(1), some.column(2), pa.array(view.odds(*view.parts(some.column(4), some.column(5)))), pa.array(meta[_metadata(some.column(3))].sum(axis=1) + meta[META])], names=["i", "y", "held", "xo", "mo"])

    odds = rows.mapInArrow(both, "i bigint, y double, held boolean, xo double, mo double")
    # two numbers for calibration need no more than so many of the rows held back
    share = min(1.0, MAX_HELD / max(1, sum(c for (_, h), c in kinds.items() if h)))
    held = known.where(F.col("held") & (F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < int(share * (1 << 20)))).mapInArrow(both, "i bigint, y double, held boolean, xo double, mo double").select("y", "xo", "mo").toArrow()
    y = held.column("y").to_numpy()
    of = {}
    for c in ("xo", "mo"):
        a, b = _calibrated(held.column(c).to_numpy(), y)
        of[c] = F.col(c) * a + b
    chance = lambda o: 1 / (1 + F.exp(-o))
    total = chance(of["xo"] + of["mo"] - prior)
    return odds.select(F.col("i").alias("doc_id"), chance(of["xo"]).alias("text_score"), chance(of["mo"]).alias("meta_score"), total.alias("score"), (total >= keep).alias("keep"))
