from __future__ import annotations

import numpy as np
import pytest

from inkwell.llm import exact_dedup as E

KIND = "doc_id bigint, text string, slot int, data string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], KIND)


def brute(rows):
    seen: dict[str, list] = {}
    for i, t in rows:
        if t is not None:
            seen.setdefault(t, []).append(i)
    kept = [(min((i for i in ids if i is not None), default=None), len(ids)) for ids in seen.values()] + [(i, 1) for i, t in rows if t is None]
    return sorted(kept, key=str)


ROWS = [(k, f"text {k * k % 37}") for k in range(300)] + [(1000, ""), (900, ""), (None, "text 0"), (None, "only here"), (None, "only here"), (5, None), (6, None), (7, "x" * 200_000), (3, "x" * 200_000), (3, "x" * 200_000), (8, "Text 0"), (9, "text 0 ")]


@pytest.mark.parametrize("rounds", [None, 1, 2, 4])
@pytest.mark.parametrize("parts", [1, 7])
def test_the_smallest_identifier_of_each_text(spark, rounds, parts):
    got = E.exact_dedup(table(spark, ROWS).repartition(parts), rounds=rounds).collect()
    assert sorted(((r["doc_id"], r["copies"]) for r in got), key=str) == brute(ROWS)


def test_rows_are_dropped_in_their_columns(spark):
    out = E.drop_copies(table(spark, ROWS).repartition(5))
    assert out.columns == ["doc_id", "text", "slot", "data"]
    rows = out.collect()
    assert sorted((str(r["doc_id"]) for r in rows)) == sorted(str(i) for i, _ in brute(ROWS))
    texts = [r["text"] for r in rows if r["text"] is not None]
    assert len(texts) == len(set(texts)) and sum(r["text"] is None for r in rows) == 2


def test_empty_tables(spark):
    assert E.exact_dedup(table(spark, [])).collect() == [] and E.drop_copies(table(spark, [])).collect() == []


def test_one_prefix_of_two_digests():
    runs = np.zeros(4, E._RUN)
    runs["a"], runs["b"], runs["id"], runs["n"] = 7, [1, 2, 1, 2], [4, 3, 2, 1], 1
    out = E.merge(runs)
    assert out["id"].tolist() == [2, 1] and out["n"].tolist() == [2, 2]
