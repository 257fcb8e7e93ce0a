"""Scores against a tree that is grown and searched in plain Python."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from inkwell.llm import suffix_tree as S

TEXTS = ["the cat sat on the mat", "the cat ate the rat", "", None, "zürich zürich \x00 日本", "the cat sat on the mat", "aaaaaaaaaaaaaaaaaaaab", "b" * 3000, "x", " \n\t"]


def brute(texts, depth, least, divergence, gamma):
    counts = defaultdict(Counter)
    symbols = [[S.BEGIN] * depth + list(t.encode()) + [S.END] for t in texts if t is not None]
    for s in symbols:
        for i in range(depth, len(s)):
            for k in range(1, depth + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    p = lambda c, x: counts[c][x] / sum(counts[c].values())
    states = set()
    for c in counts:
        n = sum(counts[c].values())
        if len(c) > 1 and n >= least and n * sum(p(c, x) * math.log(p(c, x) / p(c[1:], x)) for x in counts[c]) >= divergence:
            states.update(c[j:] for j in range(len(c) - 1))
    out = []
    for t in texts:
        if t is None:
            out.append((0, None))
            continue
        s, total = [S.BEGIN] * depth + list(t.encode()) + [S.END], 0.0
        for i in range(depth, len(s)):
            c = next((tuple(s[i - k : i]) for k in range(depth, 1, -1) if tuple(s[i - k : i]) in states), (s[i - 1],))
            total += math.log((1 - 256 * gamma) * p(c, s[i]) + gamma)
        out.append((len(s) - depth, total))
    return out, states


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
@pytest.mark.parametrize("depth", [3, 5])
def test_scores_are_those_of_the_tree(spark, broadcast_rows, depth):
    want, states = brute(TEXTS, depth, 3, 2.0, 1e-4)
    assert len(states) > 5
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, g string").repartition(3)
    got = {r["doc_id"]: r for r in S.score(df, depth=depth, min_count=3, divergence=2.0, broadcast_rows=broadcast_rows).collect()}
    assert len(got) == len(TEXTS)
    for k, (n, total) in enumerate(want):
        assert got[k]["symbols"] == n
        assert got[k]["log_prob"] == (None if total is None else pytest.approx(total, rel=1e-9))
        if total is not None:
            assert got[k]["bits_per_symbol"] == pytest.approx(-total / n / math.log(2), rel=1e-9)


def test_rows_without_text_identifier_or_at_all(spark):
    kind = "doc_id bigint, text string"
    assert S.score(spark.createDataFrame([], kind)).collect() == []
    assert [tuple(r) for r in S.score(spark.createDataFrame([(1, None)], kind)).collect()] == [(1, 0, None, None)]
    rows = S.score(spark.createDataFrame([(None, "abc"), (None, "abc"), (7, "abc")], kind)).collect()
    assert sorted(r["doc_id"] is None for r in rows) == [False, True, True] and len({r["log_prob"] for r in rows}) == 1


def test_every_context_s_probabilities_sum_to_one(spark):
    import numpy as np

    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id bigint, text string")
    rows = S.counted(df, "text", "doc_id", 3).collect()
    g, n = np.array([r["g"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows])
    pairs = np.zeros((256, 256), np.int64)
    for x, c in zip(g.astype(int), n, strict=True):
        pairs[x >> 8 & 255, x & 255] += c
    tree = S.Tree(*S.grow(g, n, pairs, 3, 3, 2.0, 1e-4, True), pairs, 3, 1e-4)
    for context in (b"the", b"cat", b"\xff\xff\xff", b"aaa"):
        all_next = np.array([int.from_bytes(context + bytes([x])) for x in range(256)], np.uint64)
        assert np.exp(tree.of(all_next)).sum() == pytest.approx(1)


def test_what_is_like_the_corpus_scores_better(spark):
    plain = [(k, f"the river runs down to the sea and the sea is wide {k % 7}") for k in range(300)]
    odd = [(1000, "qx zvj wkq pfgh xxz jqv bzzt kwx vv qpw mnbv lkj zx qwp")]
    got = {r["doc_id"]: r["bits_per_symbol"] for r in S.score(spark.createDataFrame(plain + odd, "doc_id bigint, text string")).collect()}
    assert max(got[k] for k, _ in plain) < 1 < got[1000]


def test_many_batches_and_groups_change_no_score(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(2)
    want = {r["doc_id"]: r["log_prob"] for r in S.score(df, min_count=3, divergence=2.0).collect()}
    monkeypatch.setattr(S, "BATCH", 20)
    monkeypatch.setattr(S, "GROUP", 1)
    got = {r["doc_id"]: r["log_prob"] for r in S.score(df, min_count=3, divergence=2.0, broadcast_rows=0).collect()}
    assert got.keys() == want.keys() and all(got[k] == (None if want[k] is None else pytest.approx(want[k], rel=1e-12)) for k in got)


def test_the_switch_by_size_changes_no_score(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    a, b = ({r["doc_id"]: r["log_prob"] for r in S.score(df, min_count=3, divergence=2.0, broadcast_rows=n).collect()} for n in (10**6, 0))
    assert a.keys() == b.keys() and all(a[k] == (None if b[k] is None else pytest.approx(b[k], rel=1e-12)) for k in a)
