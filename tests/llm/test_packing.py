from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import packing as P


def test_the_curve_visits_every_cell_and_steps_to_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = P.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


TEXTS = ["a b c", "", None, "word " * 5000, "a b c", " \n ", "one", "日本 語", *(f"doc {k} has {k % 5} words like river {k % 3}" for k in range(60))]


def lay(rows, capacity):
    """rows in order: (key, id, words)."""
    out, at = [], 0
    for key, i, n in rows:
        done = 0
        while True:
            here = min(n - done, capacity - at % capacity)
            out.append((at // capacity, at % capacity, i, done, here, key))
            at, done = at + here, done + here
            if done == n:
                break
    return out


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("capacity", [7, 2048])
def test_packs_are_those_of_a_loop(spark, parts, capacity):
    rows = [(k if k != 5 else None, t, k) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], -1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key bigint").repartition(parts)
    keyed = [(r["key"], r["i"], r["n"]) for r in P.curve_keys(df, "text", "doc_id", 4, 12, 1 << 16, 2).collect()]
    assert sorted((-1 if i is None else i, n) for _, i, n in keyed) == sorted((-1 if i is None else i, len((t or "").split())) for i, t, _ in rows)
    keyed.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    got = sorted(P.pack(df, capacity=capacity).collect(), key=lambda r: (r["pack_id"], r["pack_start"], r["words"], r["doc_id"] is not None, r["doc_id"] or 0))
    want = sorted(lay(keyed, capacity), key=lambda r: (r[0], r[1], r[4], r[2] is not None, r[2] or 0))
    assert [tuple(r) for r in got] == want
    full = {}
    for r in got:
        full[r["pack_id"]] = full.get(r["pack_id"], 0) + r["words"]
    last = max(p for p, n in full.items() if n)
    assert all(n == capacity for p, n in full.items() if p < last) and sum(full.values()) == sum(len((t or "").split()) for _, t, _ in rows)


def test_like_documents_are_neighbours(spark):
    kinds = ["sea tide moon wave salt", "code loop stack heap byte", "bread flour oven yeast dough"]
    rows = [(k, " ".join(np.random.default_rng(k).choice(kinds[k % 3].split(), 40))) for k in range(240)]
    got = sorted(P.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=400).collect(), key=lambda r: (r["pack_id"], r["pack_start"]))
    order = [r["doc_id"] % 3 for r in got if r["doc_start"] == 0]
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) > 0.8 * len(order)


def test_an_empty_table_and_whole_texts(spark):
    assert P.pack(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    long = "same " * 100_000
    v, n = P.vectors(pa.array([long + "end", long + "other"]), 4, 1 << 16, 2)
    assert list(n) == [100_001] * 2 and (v[0] != v[1]).any()
