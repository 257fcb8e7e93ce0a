"""MinHash near-dedup: an inverted join on signature coordinates.

A document's signature has `coordinates` minima of its word shingles under as
many random functions.  Each coordinate-value pair is a posting list of the
documents that have it.  Two documents match if at least `threshold` of their
coordinates collide, and every match is found:

- documents with the same signature are posted once, by the smallest of their
  identifiers (any two of them match at every coordinate, and match other
  documents as that one does);
- prefix merging: coordinates are ordered by the length of their posting list,
  rarest first, and a document is posted only under the first
  coordinates - threshold + 1.  A pair that shares none of these can't reach
  the threshold.  Coordinates that nobody shares come first and cost nothing,
  so documents that have only a passage in common are mostly not posted;
- skip merging: the pairs that met are counted block by block of coordinates,
  and a pair is skipped as soon as what is left can't take it to the threshold;
- pairs are only made of lists of at most LIST documents.  The documents of a
  longer list are cut into blocks by their identifiers' hashes, and blocks are
  compared with one another, two at a time, without writing down their pairs:
  a cell gives each document's number of matches and a root for each of its
  groups.  A pair that meets in several lists is counted in one.

No list is cut short and no number of partners is capped.  The result has a row
for each document: its class (all that are connected by matches, named by the
smallest identifier) and how many others it matches.

Cases: a text of fewer words than a shingle is one shingle; a very long text is
signed whole, in memory that grows with that one text; a text without any word,
empty or null, matches nothing; a row without identifier is in no class and
stays; rows of one identifier are one document: they don't match each other,
join the classes of all their texts, have all these texts' matches, and stay or
go together; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import boxed, cut, mix, small, text_slices, word_hashes

#: Near copies have a Jaccard similarity from about 0.58 on, texts with a passage in common up to 0.55: the cut is between
#: them, and so many coordinates that few pairs of either kind are estimated beyond it.
COORDINATES = 128
THRESHOLD = 74
SHINGLE = 2
SEED = 20
#: Documents of a posting list that is joined with itself, and of a block of a longer one.
LIST, BLOCK = 64, 1024
#: Pairs of a cell that are compared at once.
CELLS = 1 << 19
#: Signatures whose postings are in one batch: a batch of Spark's 10,000 would be 20 MB, held by a worker and its executor.
POSTED = 512


def functions_of(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of the coordinates' functions, modulo 2**32."""
    r = np.random.default_rng(seed)
    a = r.integers(0, 1 << 32, coordinates, dtype=np.uint64) | np.uint64(1)
    return a.astype(np.uint32), r.integers(0, 1 << 32, coordinates, dtype=np.uint64).astype(np.uint32)


def shingle_hashes(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words (a shorter text's whole run), and each text's offsets among them."""
    h, words = word_hashes(data, at)
    n = np.diff(words)
    all_words = n < size
    some = np.maximum(n - size + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(some)])
    begin = np.repeat(words[:-1], some) + np.arange(out_at[-1]) - np.repeat(out_at[:-1], some)
    stop = np.repeat(words[1:], some)
    s = h[begin]
    for j in range(1, size):
        more = begin + j < stop
        s = s * np.uint64(0x9E3779B97F4A7C15)
        s[more] += h[begin[more] + j]
    if all_words.any():  # so that "a b" isn't a shingle of "a b c" cut short
        s = s ^ np.repeat(all_words.astype(np.uint64), some)
    return mix(s), out_at


def signatures(texts: pa.Array, coordinates: int, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, coordinates) of uint32, and which rows have any shingle."""
    a, b = functions_of(coordinates, seed)
    sig = np.zeros((len(texts), coordinates), np.uint32)
    has = np.zeros(len(texts), bool)
    for lo, hi, data, at in text_slices(texts):
        s, s_at = shingle_hashes(data, at, shingle)
        full = np.flatnonzero(s_at[1:] > s_at[:-1])
        if not len(full):
            continue
        has[lo + full] = True
        s32, first = (s >> np.uint64(32)).astype(np.uint32), s_at[full]
        for k in range(coordinates):
            sig[lo + full, k] = np.minimum.reduceat(s32 * a[k] + b[k], first)
    return sig, has


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _signed(rows: pa.Array, coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), np.uint32).reshape(-1, coordinates)


def classes_of(docs: DataFrame, text: str, doc_id: str, coordinates: int, shingle: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(i, p): documents and the numbers of their signatures; (p, sig, rep, members): signatures, each one's smallest identifier and number of these."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t")).where("i is not null and t is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, has = signatures(b.column(1), coordinates, shingle, seed)
            yield pa.record_batch([b.column(0).filter(pa.array(has)), _binary(sig[has])], names=["i", "sig"])

    signed = cut(rows.mapInArrow(sign, "i bigint, sig binary").withColumn("h", F.unhex(F.md5("sig"))))
    # one signature may be that of a third of all rows: partial sums, and no list of its documents
    slim = signed.select("i", "h").distinct()
    first = slim.groupBy("h").agg(F.min("i").alias("rep"), F.count(F.lit(1)).alias("members"))
    all_of = cut(signed.groupBy("h").agg(F.first("sig").alias("sig")).join(first, "h").withColumn("p", F.monotonically_increasing_id()))
    return slim.join(all_of.select("h", "p"), "h").select("i", "p"), all_of.select("p", "sig", "rep", "members")


def postings(b: pa.RecordBatch, coordinates: int) -> Iterator[pa.RecordBatch]:
    """(p, key) of every coordinate of some signatures, POSTED signatures at a time."""
    order = np.arange(coordinates, dtype=np.int64) << 32
    for lo in range(0, b.num_rows, POSTED):
        some = b.slice(lo, POSTED)
        sig = _signed(some.column(1), coordinates)
        yield pa.record_batch([np.repeat(some.column(0).to_numpy(), coordinates), (sig.astype(np.int64) | order).ravel()], names=["p", "key"])


def posted(signed: DataFrame, coordinates: int, threshold: int) -> DataFrame:
    """(p, k, key, n): the coordinates under which signatures are posted, and how many have that value there."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return itertools.chain.from_iterable(postings(b, coordinates) for b in batches)

    each = signed.select("p", "sig").mapInArrow(post, "p bigint, key bigint")
    lists = each.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = each.join(lists, F.col("key") == F.col("of")).drop("of")
    mine = Window.partitionBy("p")  # of at most so many rows as there are coordinates
    return (
        shared.withColumns({"r": F.row_number().over(mine.orderBy("n", "key")), "all": F.count(F.lit(1)).over(mine)})
        .where(F.col("r") <= F.col("all") - (threshold - 1))
        .select("p", F.shiftright("key", 32).cast("int").alias("k"), "key", "n")
    )


def _short(lists: DataFrame, signed: DataFrame, coordinates: int, threshold: int) -> DataFrame:
    """(a, b): the matches among pairs that meet in a list of at most LIST, once each."""
    some = lists.where(F.col("n") <= LIST)
    met = some.select("key", F.col("p").alias("a")).join(some.select("key", F.col("p").alias("b")), "key").where("a < b").select("a", "b").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _signed(b.column(2), coordinates), _signed(b.column(3), coordinates)
            left, n = np.arange(len(x)), np.zeros(len(x), np.int32)
            for k in range(0, coordinates, 16):
                n[left] += (x[left, k : k + 16] == y[left, k : k + 16]).sum(axis=1, dtype=np.int32)
                left = left[n[left] + max(0, coordinates - k - 16) >= threshold]
            yield pa.record_batch([b.column(0).take(pa.array(left)), b.column(1).take(pa.array(left))], names=["a", "b"])

    both = (
        met.join(signed.select(F.col("p").alias("a"), F.col("sig").alias("sa")), "a")
        .join(signed.select(F.col("p").alias("b"), F.col("sig").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
    )
    return both.mapInArrow(count, "a bigint, b bigint")


def _bits(which: Column, coordinates: int) -> Column:
    """Aggregate: the coordinates of some postings as bits, 32 to a number."""
    of = lambda lo: F.bit_or(F.when((F.col("k") >= lo) & (F.col("k") < lo + 32) & which, F.expr(f"shiftleft(1L, k - {lo})")))
    return F.array(*[F.coalesce(of(lo), F.lit(0).cast("bigint")) for lo in range(0, coordinates, 32)])


def compared(left: tuple, right: tuple, k: int, coordinates: int, threshold: int, same: bool) -> np.ndarray:
    """Which pairs of two blocks match and are to be counted in the list of coordinate k; same: they are one block.

    A block: signatures, and bits of the coordinates under which they are in short and in long lists.
    """
    near = np.zeros((len(left[0]), len(right[0])), bool)
    step = max(1, CELLS // max(1, len(right[0])))
    for lo in range(0, len(left[0]), step):
        a = slice(lo, lo + step)
        n = np.zeros(near[a].shape, np.uint16)
        elsewhere = np.zeros(n.shape, bool)  # both are in one short list, or in an earlier long one
        for c in range(coordinates):
            equal = left[0][a, c, None] == right[0][None, :, c]
            n += equal
            for kind in (1, 2) if c < k else (1,):
                mine, its = (b[kind][:, c // 32] >> np.int64(c % 32) & 1 for b in (left, right))
                if mine[a].any() and its.any():
                    elsewhere |= equal & mine[a, None].astype(bool) & its[None].astype(bool)
        near[a] = (n >= threshold) & ~elsewhere
    return np.triu(near, 1) if same else near


def roots(near: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The smallest number of each one's group among the matches of two blocks."""
    most = np.iinfo(np.int64).max
    while True:
        b1 = np.minimum(b, np.where(near, a[:, None], most).min(axis=0, initial=most))
        a1 = np.minimum(a, np.where(near, b1[None], most).min(axis=1, initial=most))
        if same:
            a1 = b1 = np.minimum(a1, b1)
        if (a1 == a).all() and (b1 == b).all():
            return a, b
        a, b = a1, b1


def _long(lists: DataFrame, signed: DataFrame, coordinates: int, threshold: int) -> DataFrame:
    """(p, root, links): what the pairs that meet in lists of more than LIST, and in no other, add: by cells of two blocks."""
    long = F.col("n") > LIST
    posts = lists.groupBy("p").agg(_bits(~long, coordinates).alias("short"), _bits(long, coordinates).alias("long"), F.collect_list(F.when(long, F.struct("key", "n"))).alias("of"))
    posts = posts.where(F.size("of") > 0).join(signed, "p").select("p", "sig", "members", "short", "long", F.explode("of").alias("of"))
    blocks = F.ceil(F.col("of.n") / BLOCK).cast("int")
    posts = posts.withColumns({"key": F.col("of.key"), "own": F.pmod(F.xxhash64("p"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    cells = posts.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "p", "sig", "members", "short", "long")
    words = len(range(0, coordinates, 32))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        k, x, y = (v.as_py() for v in key)
        sides = [table.filter(pc.equal(table.column("own"), z)) for z in (x, y)]
        blocks = [(_signed(t.column("sig"), coordinates), *(np.array([list(v) for v in t.column(c).to_pylist()], np.int64).reshape(-1, words) for c in ("short", "long"))) for t in sides]
        near = compared(*blocks, k >> 32, coordinates, threshold, x == y)
        p, weight = ([t.column(c).to_numpy() for t in sides] for c in ("p", "members"))
        links = [near @ weight[1], weight[0] @ near]
        found = list(zip(p, roots(near, *p, x == y), links, strict=True))
        if x == y:
            found = [(p[0], found[0][1], links[0] + links[1])]
        out = [np.concatenate([c[f[2] > 0] for f in found for c in [f[j]]]) for j in range(3)]
        return pa.table({"p": out[0], "root": out[1], "links": out[2]})

    return cells.groupBy("key", "x", "y").applyInArrow(meet, "p bigint, root bigint, links bigint")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of an edge with the smallest node that it is connected to, by alternating stars."""
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    least = lambda df: df.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        lower = large.unionByName(e.select("u", "v")).distinct()
        low = least(lower)
        small_ = lower.join(low, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("of").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small_)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", coordinates: int = COORDINATES, threshold: int = THRESHOLD, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, class_id, links) of every identifier: its class's smallest identifier, and how many other documents it matches."""
    of, signed = classes_of(docs, text, doc_id, coordinates, shingle, seed)
    of, lists = cut(of), cut(posted(signed, coordinates, threshold))
    short, long = cut(_short(lists, signed, coordinates, threshold)), cut(_long(lists, signed, coordinates, threshold))
    several = of.groupBy("i").agg(F.min("p").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = short.unionByName(long.select(F.col("p").alias("a"), F.col("root").alias("b"))).unionByName(of.join(several, "i").select("a", F.col("p").alias("b")))
    root = components(edges, "a", "b")
    weight = signed.select("p", "members")
    ends = short.select(F.col("a").alias("p"), F.col("b").alias("q")).unionByName(short.select(F.col("b").alias("p"), F.col("a").alias("q")))
    links = ends.join(weight.select(F.col("p").alias("q"), F.col("members").alias("links")), "q").select("p", "links").unionByName(long.select("p", "links"))
    links = links.groupBy("p").agg(F.sum("links").alias("links"))
    all_of = signed.select("p", "rep", "members").join(root, F.col("p") == F.col("node"), "left").join(links, "p", "left")
    all_of = all_of.select("p", "rep", F.coalesce("root", "p").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"))
    named = all_of.join(all_of.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("p", "class_id", "links")
    found = of.join(named, "p").groupBy("i").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
    every = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    return every.join(found, F.col("doc_id") == F.col("i"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how: int) -> DataFrame:
    """The rows of docs without those of documents that are connected by matches to one of a smaller identifier."""
    gone = cut(near_classes(docs, text, doc_id, **how).where("class_id <> doc_id").select(F.col("doc_id").alias("ink_node")))
    rows = docs.select(boxed(docs), F.col(f"`{doc_id}`").cast("bigint").alias("ink_i"))
    # where they are few, as checked, no text is shuffled
    return rows.join(small(gone), F.col("ink_i") == F.col("ink_node"), "left_anti").select("ink_row.*")
