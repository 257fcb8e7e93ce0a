from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from inkwell.llm import near_dedup as N

KIND = "doc_id bigint, text string, key bigint, sig string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], KIND)


def made(seed=0):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    shared = " ".join(rng.choices(words, k=60))
    for g in range(25):
        base = rng.choices(words, k=rng.randint(30, 400))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 % 101, " ".join(copy) + (" " + shared if g % 3 == 0 else "")))
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    rng.shuffle(rows)
    return rows + [(500, ""), (501, None), (None, "a b c"), (502, " \n"), (503, "one"), (504, "ONE"), (505, "a b c"), (506, "a b c"), (507, "a  b\nc"), (508, "long " * 50_000), (509, "long " * 50_001)]


def brute(rows, threshold=N.THRESHOLD):
    rows = sorted((i, t) for i, t in rows if i is not None and t and t.split())
    sig, has = N.signatures(pa.array([t for _, t in rows]), N.COORDINATES, N.SHINGLE, N.SEED)
    assert has.all()
    return {(a[0], b[0]): int(n) for (x, a), (y, b) in itertools.combinations(enumerate(rows), 2) if (n := (sig[x] == sig[y]).sum()) >= threshold}


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def links(rows):
    """How many (identifier, signature) each identifier's texts match."""
    texts = sorted({(i, t) for i, t in rows if i is not None and t and t.split()})
    sig, _ = N.signatures(pa.array([t for _, t in texts]), N.COORDINATES, N.SHINGLE, N.SEED)
    entries = sorted({(i, s.tobytes()) for (i, _), s in zip(texts, sig, strict=True)})
    at = np.array([np.frombuffer(s, np.uint32) for _, s in entries])
    out = {}
    for k, (i, _) in enumerate(entries):
        out[i] = out.get(i, 0) + int(((at == at[k]).sum(axis=1) >= N.THRESHOLD).sum()) - 1
    return out


def check(spark, rows, parts=3):
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in N.near_classes(table(spark, rows).repartition(parts)).collect()}
    want, n = groups(brute(rows)), links(rows)
    assert got == {i: (want.get(i, i), n.get(i, 0)) for i, _ in rows if i is not None}
    kept = sorted(str(r["doc_id"]) for r in N.near_dedup(table(spark, rows)).collect())
    assert kept == sorted(str(i) for i, _ in rows if want.get(i, i) == i)


@pytest.mark.parametrize(("seed", "size"), [(0, (64, 1024)), (1, (3, 4)), (0, (0, 2))])
def test_all_matches_and_their_classes(spark, monkeypatch, seed, size):
    monkeypatch.setattr(N, "LIST", size[0])
    monkeypatch.setattr(N, "BLOCK", size[1])
    monkeypatch.setattr(N, "CELLS", 16)
    check(spark, made(seed))


def test_a_large_group_of_near_copies(spark):
    """Lists of some hundred documents, and signatures of a third of all rows."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 40)):
            copy[rng.randrange(300)] = rng.choice(base)
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, "one text that many have") for k in range(150)] + [(2000 + k, " ".join(rng.choices(base, k=50))) for k in range(50)]
    check(spark, rows)


def test_the_driver_s_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in N.near_classes(docs).collect()}
    want = groups(brute(rows))
    assert got == {i: want.get(i, i) for i, _ in rows}


def test_signatures_are_those_of_plain_integers():
    """Words, shingles and minima by Python's own integers, modulo 2**64 and 2**32."""
    full, golden, base = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15 | 1

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        return h ^ h >> 31

    def word(w):
        return mixed(sum((b + 32 * (65 <= b <= 90) + 1) * pow(base, j, 1 << 64) for j, b in enumerate(w)) % (1 << 64) ^ (len(w) - 1))

    texts = ["a b c d", "B  c\nd\te", "one", "zürich 日本 Zürich " * 5, "x" * 3000 + " y"]
    sig, has = N.signatures(pa.array([*texts, "", None, " "]), N.COORDINATES, 2, N.SEED)
    a, b = N.functions_of(N.COORDINATES, N.SEED)
    assert has.tolist() == [True] * 5 + [False] * 3
    for t, got in zip(texts, sig, strict=False):
        h = [word(w) for w in t.encode().split()]
        s = [mixed((x * golden + y) & full) for x, y in itertools.pairwise(h)] if len(h) > 1 else [mixed(h[0] * golden & full ^ 1)]
        assert got.tolist() == [min(((x >> 32) * int(a[k]) + int(b[k])) % (1 << 32) for x in s) for k in range(N.COORDINATES)]


def test_postings_come_in_bounded_batches():
    """All coordinates of all signatures, a bounded number of rows at a time however many Spark sends at once."""
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 1 << 32, (10_000, N.COORDINATES), dtype=np.uint64).astype(np.uint32)
    b = pa.record_batch([pa.array(range(10_000), pa.int64()), N._binary(sig)], names=["p", "sig"])
    batches = list(N.postings(b.slice(1), N.COORDINATES))
    assert max(x.num_rows for x in batches) <= 1 << 16
    p, key = (np.concatenate([x.column(k).to_numpy() for x in batches]) for k in range(2))
    assert (p == np.repeat(np.arange(1, 10_000), N.COORDINATES)).all()
    assert (key >> 32 == np.tile(np.arange(N.COORDINATES), 9999)).all() and (key & 0xFFFFFFFF == sig[1:].ravel()).all()


def pairs(df):
    """Pairs of documents of one class; only for classes of two."""
    of = {}
    for r in df.collect():
        of.setdefault(r["class_id"], []).append(r["doc_id"])
    return {tuple(sorted(c)) for c in of.values() if len(c) == 2}


def test_copies_with_few_words_changed_are_found(spark):
    rng = random.Random(5)
    rows, planted = [], []
    for k in range(60):
        words = [f"v{rng.randrange(5000)}" for _ in range(200)]
        copy = list(words)
        for j in rng.sample(range(200), 8):
            copy[j] = f"v{rng.randrange(5000)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        planted.append((2 * k, 2 * k + 1))
    got = pairs(N.near_classes(table(spark, rows)))
    assert len(got & set(planted)) >= 58 and not got - set(planted)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: r for x, r in groups((a, b) for a, b in edges if a != b).items() if x != r}


def test_one_identifier_on_several_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (2, "other words are here now"), (3, "other words are here now")]
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in N.near_classes(table(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1)}
    assert {r["doc_id"] for r in N.near_dedup(table(spark, rows)).collect()} == {1}
    assert N.near_classes(table(spark, [])).collect() == [] and N.near_dedup(table(spark, [])).collect() == []


def test_pairs_of_middling_similarity_against_exact_jaccard(spark):
    rng = random.Random(11)
    rows, near, far = [], set(), set()
    for k in range(300):
        words = [f"u{rng.randrange(50_000)}" for _ in range(rng.randint(300, 600))]
        copy = list(words)
        for j in rng.sample(range(len(words)), int(len(words) * rng.uniform(0.06, 0.26))):
            copy[j] = f"u{rng.randrange(50_000)}"
        a, b = ({*itertools.pairwise(w)} for w in (words, copy))
        jaccard = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        if 0.65 <= jaccard:
            near.add((2 * k, 2 * k + 1))
        elif jaccard < 0.45:
            far.add((2 * k, 2 * k + 1))
    got = pairs(N.near_classes(table(spark, rows)))
    assert len(near) > 60 and len(far) > 60
    assert len(near & got) >= 0.97 * len(near) and len(far & got) <= 0.03 * len(far)
