"""LM scoring by a probabilistic suffix tree over the bytes of texts.

Every document's symbols are its UTF-8 bytes and an end; before its begin
stands a begin symbol as often as a context is deep.  How often each symbol
follows each context of full depth is counted over all documents (sorted
per task, added up by Spark); shorter contexts' counts are sums of these.

A context is retained as a state of the tree if it occurs `min_count` times and
its next-symbol distribution diverges from that of the context one symbol
shorter: count * KL divergence >= `divergence` nats.  With a state all its
suffixes are states; contexts of no or one symbol always are.  The tree is
built in parallel, a subtree for each two last symbols, in as many groups of
subtrees as the number of counted contexts asks for.  A state's distribution
is smoothed: each of the 256 symbols gets `gamma`, and the counts share what is
left.  A symbol is scored by the longest suffix of its past that is a state.

The states are sent to all executors only if they are at most `broadcast_rows`.
Else documents are put into batches of some megabytes, each batch's distinct
contexts are joined to their probabilities, and the batch is scored with these:
a context that every document has is joined once for a batch, not for a
document.  Both ways look probabilities up in float64; scores only differ by the
order in which they are added.

Cases: an empty text has one symbol, its end; a very long text is counted and
scored whole, in memory that grows with that one text; a null text has null scores and 0
symbols, and isn't counted; null identifiers are passed on; repeated rows are
counted and scored each; a text may contain any character; an empty table gives
an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, text_slices

DEPTH = 5
MIN_COUNT = 24
DIVERGENCE = 12.0
GAMMA = 1e-4
BROADCAST_ROWS = 6_000_000
BEGIN, END = 0xFF, 0xFE  # bytes that UTF-8 never has
#: Groups of subtrees at least, and counts that a group has at most, about, until each subtree is a group.
SUBTREES, GROUP = 128, 500_000
#: Bytes of a batch of documents.
BATCH = 4 << 20
#: Counts that a task holds before it passes them on.
HELD = 4_000_000


def grams(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol, the symbol lowest, of every place of some texts, and the texts' offsets (an end each)."""
    n = np.diff(at)
    ends = np.cumsum(n + depth + 1)
    s = np.full(int(ends[-1]) + 7 if len(n) else 7, BEGIN, np.uint8)
    begins = ends - n - 1 + 7 if len(n) else ends
    s[np.arange(len(data)) + np.repeat(begins - at[:-1], n)] = data
    s[ends + 6] = END
    windows = np.ndarray(len(s) - 7, dtype=">u8", buffer=s, strides=(1,)).astype(np.uint64) & np.uint64((1 << 8 * (depth + 1)) - 1)
    own = np.ones(len(windows), bool)
    pads = (begins - 7 - depth)[:, None] + np.arange(depth)
    own[pads.ravel()] = False
    return windows[own], np.concatenate([[0], np.cumsum(n + 1)])


def distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts' sums."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")


def counted(docs: DataFrame, text: str, doc_id: str, depth: int) -> DataFrame:
    """(g, n): how often each context of full depth and symbol occur in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            for _, _, data, at in text_slices(b.column(0), 4 << 20):
                held.append(distinct(grams(data, at, depth)[0]))
                size += len(held[-1][0])
                if size > HELD:
                    one = distinct(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
                    held, size = [one], len(one[0])
                    if size > HELD // 2:
                        yield pa.record_batch([one[0].view(np.int64), one[1]], names=["g", "n"])
                        held, size = [], 0
        if held:
            k, n = distinct(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            yield pa.record_batch([k.view(np.int64), n], names=["g", "n"])

    return _texts(docs, text, doc_id).select("t").mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))


def grow(gram: np.ndarray, n: np.ndarray, pairs: np.ndarray, depth: int, min_count: int, divergence: float, gamma: float, states: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subtrees of full contexts that share their two last symbols, of which all are given.

    pairs: counts of (last symbol, next symbol) in all documents.  With states:
    (depth, context and symbol, log probability) of every state of at least
    two symbols; else depth, key and log probability of each gram given, by its
    longest suffix state.
    """
    mask = [np.uint64((1 << 8 * (k + 1)) - 1) for k in range(depth + 1)]
    keys, counts, up = [None] * (depth + 1), [None] * (depth + 1), [None] * (depth + 1)
    order = np.argsort(gram)
    keys[depth], counts[depth] = gram[order], n[order].astype(np.int64)
    for k in range(depth - 1, 1, -1):
        keys[k], up[k + 1] = np.unique(keys[k + 1] & mask[k], return_inverse=True)
        counts[k] = np.bincount(up[k + 1], weights=counts[k + 1]).astype(np.int64)
    share = 1 - 256 * gamma
    last, after = (keys[min(2, depth)] >> np.uint64(8) & np.uint64(255)).astype(int), (keys[min(2, depth)] & np.uint64(255)).astype(int)
    context, total, kept = {}, {}, {}
    for k in range(2, depth + 1):
        first = np.flatnonzero(np.concatenate([[True], keys[k][1:] >> np.uint64(8) != keys[k][:-1] >> np.uint64(8)]))
        context[k] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys[k]))))
        total[k] = np.add.reduceat(counts[k], first)
        p = counts[k] / total[k][context[k]]
        q = pairs[last, after] / pairs.sum(axis=1)[last] if k == 2 else (counts[k - 1] / total[k - 1][context[k - 1]])[up[k]]
        kl = np.add.reduceat(p * np.log(p / q), first)
        kept[k] = (total[k] >= min_count) & (total[k] * kl >= divergence)
    for k in range(depth, 2, -1):  # suffixes of states are states
        child = np.zeros(len(total[k - 1]), bool)
        child[context[k - 1][up[k][kept[k][context[k]]]]] = True
        kept[k - 1] |= child
    own = {k: np.log(share * counts[k] / total[k][context[k]] + gamma) for k in range(2, depth + 1)}
    if states:
        rows = {k: kept[k][context[k]] for k in range(2, depth + 1)}
        return np.concatenate([np.full(int(r.sum()), k, np.int32) for k, r in rows.items()]), np.concatenate([keys[k][r] for k, r in rows.items()]), np.concatenate([own[k][r] for k, r in rows.items()])
    best, deep = np.log(share * pairs[last, after] / pairs.sum(axis=1)[last] + gamma), np.ones(len(last), np.int32)
    for k in range(2, depth + 1):
        if k > 2:
            best, deep = best[up[k]], deep[up[k]]
        best, deep = np.where(kept[k][context[k]], own[k], best), np.where(kept[k][context[k]], k, deep)
    return deep.astype(np.int32), keys[depth], best


class Tree:
    """Log probabilities by the longest suffix that is a state."""

    def __init__(self, k: np.ndarray, key: np.ndarray, logp: np.ndarray, pairs: np.ndarray, depth: int, gamma: float) -> None:
        self.depth, self.gamma, self.levels = depth, gamma, {}
        for d in range(2, depth + 1):
            mine = k == d
            order = np.argsort(key[mine])
            entries = key[mine][order]
            self.levels[d] = (np.unique(entries >> np.uint64(8)), entries, logp[mine][order])
        total = pairs.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.pairs = np.where(total > 0, np.log((1 - 256 * gamma) * pairs / np.maximum(total, 1) + gamma), np.log(gamma))

    def of(self, gram: np.ndarray) -> np.ndarray:
        """Log probabilities of distinct grams."""
        out = self.pairs[(gram >> np.uint64(8) & np.uint64(255)).astype(int), (gram & np.uint64(255)).astype(int)]
        open_ = np.arange(len(gram))
        for d in range(self.depth, 1, -1):
            contexts, entries, logp = self.levels[d]
            if not len(contexts) or not len(open_):
                continue
            g = gram[open_] & np.uint64((1 << 8 * (d + 1)) - 1)
            c = g >> np.uint64(8)
            is_state = contexts[np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)] == c
            g, at = g[is_state], open_[is_state]
            place = np.minimum(np.searchsorted(entries, g), len(entries) - 1)
            out[at] = np.where(entries[place] == g, logp[place], np.log(self.gamma))
            open_ = open_[~is_state]
        return out


def _subtrees(counts: DataFrame, pairs: np.ndarray, depth: int, min_count: int, divergence: float, gamma: float, states: bool) -> DataFrame:
    groups = min(1 << 16, max(SUBTREES, counts.count() // GROUP))
    sent = counts.sparkSession.sparkContext.broadcast(pairs)  # 65,536 numbers

    def run(table: pa.Table) -> pa.Table:
        g, n = table.column("g").to_numpy().view(np.uint64), table.column("n").to_numpy()
        k, key, logp = grow(g, n, sent.value, depth, min_count, divergence, gamma, states)
        return pa.table({"k": k, "g": key.view(np.int64), "logp": logp})

    subtree = F.pmod(F.xxhash64(F.expr("shiftright(g, 8) & 65535")), F.lit(groups))
    return counts.withColumn("subtree", subtree).groupBy("subtree").applyInArrow(run, "k int, g bigint, logp double")


def _by_batches(rows: DataFrame, known: DataFrame, depth: int) -> DataFrame:
    """(doc_id, symbols, log_prob) of rows (i, t), each batch with the probabilities of the contexts that it has."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, size = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            length = pc.binary_length(b.column(1).cast(pa.large_binary())).to_numpy()
            which = np.empty(len(length), np.int64)
            for k, n in enumerate(length.tolist()):
                if size and size + n > BATCH:
                    of, size = of + 1, 0
                which[k], size = of, size + n + 1
            yield pa.record_batch([pa.array(which), b.column(0), b.column(1)], names=["b", "i", "t"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which = b.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            for lo, hi in zip(edges, np.append(edges[1:], len(which)), strict=True):
                for _, _, data, at in text_slices(b.column(2).slice(lo, hi - lo), BATCH):
                    keys = distinct(grams(data, at, depth)[0])[0]
                    yield pa.record_batch([np.full(len(keys), which[lo]), keys.view(np.int64)], names=["b", "g"])

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        g = right.column("g").to_numpy().view(np.uint64)
        order = np.argsort(g)
        g, logp = g[order], right.column("logp").to_numpy()[order]
        symbols, total = [], []
        for chunk in left.column("t").chunks:
            for _, _, data, at in text_slices(chunk, 2 << 20):
                own, g_at = grams(data, at, depth)
                symbols.append(np.diff(g_at))
                total.append(np.add.reduceat(logp[np.searchsorted(g, own)], g_at[:-1]))
        return pa.table({"doc_id": left.column("i"), "symbols": np.concatenate(symbols), "log_prob": np.concatenate(total)})

    # written once: batches must stay as they are when a task is repeated
    texts = cut(rows.mapInArrow(number, "b bigint, i bigint, t string"))
    needed = texts.mapInArrow(contexts, "b bigint, g bigint").join(known, "g").select(F.col("b").alias("c"), "g", "logp")
    return texts.groupBy("b").cogroup(needed.groupBy("c")).applyInArrow(meet, "doc_id bigint, symbols bigint, log_prob double")


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH, min_count: int = MIN_COUNT, divergence: float = DIVERGENCE, gamma: float = GAMMA, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, symbols, log_prob, bits_per_symbol) of every document.  depth: 2 to 7."""
    spark = docs.sparkSession
    counts = cut(counted(docs, text, doc_id, depth))
    pairs = np.zeros((256, 256), np.int64)
    for row in counts.groupBy(F.expr("cast(g & 65535 as int)").alias("p")).agg(F.sum("n").alias("n")).collect():  # at most 65,536
        pairs[row["p"] >> 8, row["p"] & 255] = row["n"]
    states = cut(_subtrees(counts, pairs, depth, min_count, divergence, gamma, True))
    rows = _texts(docs, text, doc_id)
    if states.count() <= broadcast_rows:
        table = states.toArrow()
        parts = (table.column("k").to_numpy().astype(np.int8), table.column("g").to_numpy().view(np.uint64), table.column("logp").to_numpy())
        sent = spark.sparkContext.broadcast(parts)
        del table

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = None
            for b in batches:
                tree = tree or Tree(*sent.value, pairs, depth, gamma)
                symbols, total = [], []
                for _, _, data, at in text_slices(b.column(1), 2 << 20):
                    g, g_at = grams(data, at, depth)
                    order = np.argsort(g)
                    s = g[order]
                    new = np.concatenate([[True], s[1:] != s[:-1]])
                    each = np.empty(len(g))
                    each[order] = tree.of(s[new])[np.cumsum(new) - 1]
                    symbols.append(np.diff(g_at))
                    total.append(np.add.reduceat(each, g_at[:-1]))
                yield pa.record_batch([b.column(0), np.concatenate(symbols or [np.zeros(0, int)]), np.concatenate(total or [np.zeros(0)])], names=["doc_id", "symbols", "log_prob"])

        out = rows.mapInArrow(run, "doc_id bigint, symbols bigint, log_prob double")
    else:
        known = _subtrees(counts, pairs, depth, min_count, divergence, gamma, False).select("g", "logp")
        out = _by_batches(rows, known, depth)
    out = out.withColumn("bits_per_symbol", -F.col("log_prob") / F.col("symbols") / float(np.log(2)))
    silent = docs.where(F.col(f"`{text}`").isNull()).select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("symbols"), F.lit(None).cast("double").alias("log_prob"), F.lit(None).cast("double").alias("bits_per_symbol"))
    return out.unionByName(silent)


def _sql() -> str:
    """The tree and the scores in DuckDB: contexts and symbols are hexadecimal digits, two for each byte."""
    d = DEPTH
    lags = " || ".join([f"lag(b, {k}, '{BEGIN:X}') OVER w" for k in range(d, 0, -1)] + ["b"])
    parts = [
        "docs AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS rid FROM documents WHERE text IS NOT NULL)",
        f"bytes AS (SELECT rid, unnest(l) AS b, generate_subscripts(l, 1) AS pos FROM (SELECT rid, regexp_extract_all(hex(encode(text)) || '{END:X}', '..') AS l FROM docs))",
        f"g AS (SELECT rid, {lags} AS g FROM bytes WINDOW w AS (PARTITION BY rid ORDER BY pos))",
        f"c{d} AS (SELECT g, count(*) AS n FROM g GROUP BY g)",
        *[f"c{k} AS (SELECT substr(g, 3) AS g, sum(n) AS n FROM c{k + 1} GROUP BY ALL)" for k in range(d - 1, 0, -1)],
        *[f"x{k} AS (SELECT g, n::DOUBLE / sum(n) OVER (PARTITION BY left(g, {2 * k})) AS p, sum(n) OVER (PARTITION BY left(g, {2 * k})) AS total FROM c{k})" for k in range(1, d + 1)],
        *[f"t{k} AS (SELECT left(a.g, {2 * k}) AS c, any_value(a.total) AS total, sum(a.p * ln(a.p / b.p)) AS kl FROM x{k} a JOIN x{k - 1} b ON substr(a.g, 3) = b.g GROUP BY ALL)" for k in range(2, d + 1)],
    ]
    for k in range(d, 1, -1):
        more = f" OR c IN (SELECT substr(c, 3) FROM s{k + 1})" if k < d else ""
        parts.append(f"s{k} AS (SELECT c FROM t{k} WHERE total >= {MIN_COUNT} AND total * kl >= {DIVERGENCE}{more})")
    joins = " ".join(f"JOIN x{k} ON substr(c{d}.g, {2 * (d - k) + 1}) = x{k}.g" + (f" LEFT JOIN s{k} ON substr(left(c{d}.g, {2 * d}), {2 * (d - k) + 1}) = s{k}.c" if k > 1 else "") for k in range(1, d + 1))
    chosen = " ".join(f"WHEN s{k}.c IS NOT NULL THEN x{k}.p" for k in range(d, 1, -1))
    parts.append(f"lp AS (SELECT c{d}.g, ln({1 - 256 * GAMMA}::DOUBLE * CASE {chosen} ELSE x1.p END + {GAMMA}::DOUBLE) AS logp FROM c{d} {joins})")
    parts.append("each AS (SELECT rid, count(*) AS symbols, sum(logp) AS log_prob FROM g JOIN lp USING (g) GROUP BY rid)")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, symbols, round(log_prob, 4) AS log_prob, round(-log_prob / symbols / ln(2), 6) AS bits_per_symbol FROM each JOIN docs USING (rid)
UNION ALL SELECT doc_id, 0, NULL, NULL FROM documents WHERE text IS NULL"""


#: For scores rounded to 4 and 6 digits, as sums of floating numbers depend on their order.
SQL = _sql()
