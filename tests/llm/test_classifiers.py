"""Held-out accuracy of the two classifiers, and rows of every kind."""

from __future__ import annotations

import numpy as np
import pytest

from inkwell.llm import cotraining as Q
from inkwell.llm import linear
from inkwell.llm import toxicity as X

DIR = "/root/testdata/sf0.1"


def halves(spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet").where("doc_id is not null")
    return labels.where("pmod(hash(doc_id), 2) = 0"), labels.where("pmod(hash(doc_id), 2) = 1")


def area(score, good):
    rank = np.argsort(np.argsort(score)) + 1
    n = good.sum()
    return (rank[good].sum() - n * (n + 1) / 2) / (n * (len(good) - n))


def test_toxic_documents_that_were_not_seen(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    learn, held = halves(spark)
    rows = X.score(docs, learn).join(held.selectExpr("doc_id", "toxic as y"), "doc_id").select("toxic", "y", "score").collect()
    got, y = np.array([r[0] for r in rows]), np.array([r["y"] for r in rows]) > 0
    assert y.sum() > 50
    # half of the labels have few examples of what is toxic in the rarer languages
    assert got[y].mean() > 0.8 and got[~y].mean() < 0.01
    assert area(np.array([r["score"] for r in rows]), y) > 0.95


def test_quality_of_documents_that_were_not_seen(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    learn, held = halves(spark)
    rows = Q.score(docs, learn).join(held, "doc_id").select("score", "text_score", "keep", "quality").collect()
    y = np.array([r["quality"] for r in rows]) > 0
    score, kept = np.array([r["score"] for r in rows]), np.array([r["keep"] for r in rows])
    assert area(score, y) > 0.98 and (kept == y).mean() > 0.98 > max(y.mean(), 1 - y.mean()) + 0.1
    assert ((score >= 0) & (score <= 1)).all()


DOCS = "doc_id bigint, text string, source string, lang string, n_chars bigint, w binary, s string, score double"


def docs(spark):
    rows = [(k, ("you vile hateful slurry filth " if k % 2 else "a kind calm river walk ") * (1 + k % 4), "ab"[k % 2], "en", 20) for k in range(60)]
    rows += [(100, None, None, None, None), (101, "", "a", "en", 0), (None, "you vile hateful slurry filth", "b", "en", 5), (None, "a kind calm river walk", "a", "en", 5), (102, "calm river " * 40_000 + "you vile hateful slurry filth " * 4, "a", "en", 9), (3, "you vile hateful slurry filth", "b", "en", 3)]
    return spark.createDataFrame([(*r, b"", "clash", 0.5) for r in rows], DOCS)


def labels(spark):
    rows = [(k, 1 - k % 2, k % 2) for k in range(60)] + [(None, 1, 1), (5, None, None), (999, 1, 1), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_toxicity_of_every_kind_of_row(spark):
    d = docs(spark)
    got = X.score(d, labels(spark)).collect()
    assert len(got) == d.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by[k]["toxic"] == bool(k % 2) for k in range(60)) and by[100]["score"] == by[101]["score"] and np.isfinite(by[100]["score"])
    kept = X.keep_clean(d, labels(spark))
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(str(r["doc_id"]) for r in got if not r["toxic"])
    assert X.score(d.limit(0), labels(spark)).collect() == []
    for some in (labels(spark).limit(0), labels(spark).where("toxic = 0")):
        assert {(r["score"], r["toxic"]) for r in X.score(d, some).collect()} == {(0.0, False)}
        assert X.keep_clean(d, some).count() == d.count()


def test_features_are_those_of_a_loop():
    import pyarrow as pa

    from inkwell.llm.common import text_slices

    texts = ["Ab", "abÄ", "", "ÄBab abc", "日本語テキスト", "aaaaaa", None]
    (_, _, data, at), = text_slices(pa.array(texts))
    f, f_at = X.features(data, at, (3, 4, 5), 1 << 20)
    grams = [{t.lower()[i : i + k] for k in (3, 4, 5) for i in range(len(t) - k + 1)} for t in (x or "" for x in texts)]
    assert np.diff(f_at).tolist() == [len(g) for g in grams]
    same = {}
    for t, a, b in zip(grams, f_at, f_at[1:], strict=False):
        same[frozenset(t)] = sorted(f[a:b].tolist())
    (_, _, data, at), = text_slices(pa.array(["xx abä yy"]))
    assert same[frozenset({"abä"})][0] in X.features(data, at, (3, 4, 5), 1 << 20)[0]


def test_minimise():
    a = np.diag([1.0, 10.0, 100.0])
    w = linear.minimise(lambda w: (0.5 * (w - 1) @ a @ (w - 1), a @ (w - 1)), np.zeros(3), 200)
    assert np.abs(w - 1).max() < 0.05


def test_toxicity_is_that_of_plain_numpy(spark):
    """Features by Python's sets, ratios, weights and scores by dense matrices and gradient steps."""
    import pyarrow as pa

    from inkwell.llm.common import text_slices

    rng = np.random.default_rng(3)
    words = [["vile", "filth", "calm", "river", "hateful", "kind", "tree", "hill", "slurry", "walk"][k] for k in rng.integers(0, 10, 900)]
    texts = [" ".join(words[k : k + 9]) for k in range(0, 900, 9)] + ["", "ab"]
    y = np.array([float(sum(t.count(x) for x in ("vile", "filth", "hateful", "slurry")) > 3) for t in texts])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in X.score(d, spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id bigint, toxic int")).collect()}
    grams = [{t[i : i + k] for k in X.LENGTHS for i in range(len(t) - k + 1)} for t in texts]
    known = {}

    def bucket(g):
        if g not in known:
            (_, _, data, at), = text_slices(pa.array([g]))
            known[g] = int(X.features(data, at, (len(g),), X.BUCKETS)[0][0])
        return known[g]

    x = np.zeros((len(texts), len({b for g in grams for b in map(bucket, g)})))
    place = {}
    for row, g in enumerate(grams):
        for b in {bucket(v) for v in g}:
            x[row, place.setdefault(b, len(place))] = 1
    share = y.mean()
    p, q = (y @ x + X.ALPHA * share) / share, ((1 - y) @ x + X.ALPHA * (1 - share)) / (1 - share)
    x = x * (np.log(p) - np.log(q))
    w, bias, sign = np.zeros(x.shape[1]), 0.0, 2 * y - 1
    step = 1 / (X.L2 + 0.25 * np.linalg.norm(x, 2) ** 2)
    for _ in range(20_000):
        g = -sign / (1 + np.exp(sign * (x @ w + bias)))
        w, bias = w - step * (x.T @ g + X.L2 * w), bias - 0.02 * g.sum()
    want = x @ w + bias - np.log(share / (1 - share))
    assert np.abs(np.array([got[k] for k in range(len(texts))]) - want).max() < 0.05


def test_long_texts_make_several_stretches(spark, monkeypatch):
    d, y = docs(spark), labels(spark)
    whole = {(r["doc_id"], r["score"]) for r in X.score(d, y).collect() if r["doc_id"] != 3}
    monkeypatch.setattr(X, "STRETCH", 4)
    parts = {r["doc_id"]: r["score"] for r in X.score(d, y).collect() if r["doc_id"] is not None}
    assert all(parts[i] == pytest.approx(s, abs=1e-4) for i, s in whole if i is not None)


def test_quality_of_every_kind_of_row(spark):
    d = docs(spark)
    got = Q.score(d, labels(spark)).collect()
    assert len(got) == d.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] != 3}
    assert sum(by[k]["keep"] == (k % 2 == 0) for k in range(60) if k != 3) > 55
    assert Q.score(d.limit(0), labels(spark)).collect() == []
    for some in (labels(spark).limit(0), labels(spark).where("quality = 1")):
        assert {(r["score"], r["keep"]) for r in Q.score(d, some).collect()} == {(None, True)}


def test_a_view_learns_what_the_other_knows(spark):
    """Few labels, all of one source of each class; most texts of a class share no word with these, but the source does."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice([*"etaoinshr"], 6)) for _ in range(80)]
    good, bad = words[:40], words[40:]
    rows = [(k, " ".join(rng.choice((bad, good)[k % 2][:10] if k < 80 else (bad, good)[k % 2], 12)), "xy"[k % 2], "en", 60) for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    y = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id bigint, quality int")
    unseen = {k for k, t, *_ in rows if k >= 80 and not {w for w in t.split()} & {*good[:10], *bad[:10]}}
    of = lambda n: {r["doc_id"]: r["text_score"] for r in Q.score(d, y, rounds=n, sure=0.7).collect()}
    right = lambda s: np.mean([(s[k] >= 0.5) == bool(k % 2) for k in unseen])
    assert len(unseen) > 10 and right(of(3)) > 0.95 > right(of(1))


def test_sets_are_those_of_a_loop():
    import pyarrow as pa

    from inkwell.llm.common import mix

    texts = ["Ab cd ab", "", None, "日本 a", "x" * 9, "one\ttwo three"]
    f, at = Q.text_sets(pa.array(texts))
    for k, t in enumerate(texts):
        raw = "".join(c.lower() if c.isascii() else c for c in t or "").replace("\t", " ").encode()
        codes = mix(np.array([int.from_bytes(raw[i : i + 4], "little") for i in range(len(raw) - 3)], np.uint64)) if len(raw) > 3 else np.zeros(0, np.uint64)
        grams = {int(c >> np.uint64(48)) + Q.WORDS for c in codes if int(c) % 8 == 0}
        own = f[at[k] : at[k + 1]].tolist()
        assert [x for x in own if x >= Q.WORDS] == sorted(grams) and len([x for x in own if x < Q.WORDS]) == len({w for w in raw.split()})
    packed = pa.array([Q._pack(f[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
    back, b_at = Q._unpacked(packed.slice(1))
    assert back.tolist() == f[at[1] :].tolist() and (b_at == at[1:] - at[1]).all()


def test_the_metadata_view_against_plain_newton(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, "t", "abc"[k % 3], "xy"[k % 2], 10) for k in range(300)]
    y = [(k, int(rng.random() < (0.9, 0.5, 0.2)[k % 3])) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    v = Q.views(d, spark.createDataFrame(y, "doc_id bigint, quality int"), "text", "doc_id", "source", "lang", "n_chars", "quality")
    got = Q.fit_meta(v, None, 1.0)
    monkeypatch.setattr(Q, "FEW", 0)
    assert np.abs(Q.fit_meta(v, None, 1.0) - got).max() < 1e-3
    train = [(r["m"], r["y"]) for r in v.collect() if not r["held"]]
    places = sorted({p for m, _ in train for p in m})
    x = np.array([[float(p in m) for p in places] + [1.0] for m, _ in train])
    sign, w = np.array([2 * q - 1 for _, q in train]), np.zeros(len(places) + 1)
    ridge = np.append(np.full(len(places), Q.L2_META), 1e-9)
    for _ in range(40):
        p = 1 / (1 + np.exp(sign * (x @ w)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), -x.T @ (sign * p) + ridge * w)
    want, have = x @ w, np.array([got[m].sum() + got[Q.META] for m, _ in train])
    assert np.abs(want - have).max() < 0.05


@pytest.mark.parametrize("text", ["a b c", "x" * 100_000, "日本\n語 " * 10])
def test_measures_don_t_depend_on_other_rows(text):
    import pyarrow as pa

    alone, among = Q.text_vectors(pa.array([text])), Q.text_vectors(pa.array(["other", text, None, ""]))
    assert np.allclose(alone[0], among[1]) and not among[2:].any()
