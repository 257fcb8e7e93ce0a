from __future__ import annotations

from collections import Counter

import pytest

from inkwell.llm import mixing as M

KIND = "doc_id bigint, text string, source string, ink_u string, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND)


def copies(df):
    return {r["doc_id"]: r["copies"] for r in df.collect()}


def brute(rows, weights, budget, seed=M.SEED):
    import hashlib

    size = Counter()
    for _, t, s in rows:
        size[s] += len(t or "")
    total, all_w = sum(size.values()), sum(w for s, w in weights.items() if size[s])
    due = {s: round(budget * total * weights.get(s, 0) / all_w / size[s] * M.MICRO) if size[s] else M.MICRO for s in size}
    take = (sum(due[s] % M.MICRO for _, _, s in rows) + M.MICRO // 2) // M.MICRO
    rated = []
    for i, _, s in rows:
        p = due[s] % M.MICRO / M.MICRO
        u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        if p:
            rated.append((u / (1 - u) * ((1 - p) / p), i))
    chosen = {i for _, i in sorted(rated)[:take]}
    return {i: n for i, _, s in rows if (n := due[s] // M.MICRO + (i in chosen))}


@pytest.mark.parametrize("budget", [0.5, 1.0, 3.3])
@pytest.mark.parametrize("parts", [1, 4])
def test_samples_are_those_of_a_loop(spark, budget, parts):
    rows = [(k, "x" * (1 + k % 9), "abc"[k % 3] if k % 7 else "d") for k in range(400)]
    weights = {"a": 0.6, "b": 0.3, "c": 0.1}
    got = copies(M.sample_copies(table(spark, rows).repartition(parts), weights=weights, budget=budget))
    assert got == brute(rows, weights, budget)


def test_shares_come_near_their_targets(spark):
    rows = [(k, "x" * 10, "big" if k % 10 else "small") for k in range(3000)]
    got = copies(M.sample_copies(table(spark, rows), weights={"big": 0.5, "small": 0.5}))
    small = sum(n for i, n in got.items() if i % 10 == 0)
    assert abs(sum(got.values()) - 3000) <= 1 and abs(small - 1500) < 60
    assert all(n == 5 for i, n in got.items() if i % 10 == 0)


def test_without_a_budget_no_row_is_left_out(spark):
    rows = [(k, "x" * 10, "big" if k % 10 else "small") for k in range(500)]
    got = copies(M.sample_copies(table(spark, rows), budget=None))
    assert len(got) == 500 and all(got[k] == 1 for k in range(500) if k % 10) and all(got[k] >= 2 for k in range(0, 500, 10))


@pytest.mark.parametrize("parts", [1, 5])
def test_a_sample_has_its_size_whatever_repeats(spark, parts):
    none = [(None, "x" * 10, "ab"[k % 10 == 0]) for k in range(1000)]
    for rows in (none, [(7, t, s) for _, t, s in none], [(k % 3 or None, "x" * (10 + k % 2), s) for k, (_, _, s) in enumerate(none)]):
        got = Counter()
        for r in M.sample_copies(table(spark, rows).repartition(parts), weights={"a": 0.5, "b": 0.5}, budget=1.0).collect():
            got[r["doc_id"]] += r["copies"]
        size = Counter()
        for _, t, s in rows:
            size[s] += len(t)
        due = {s: round(sum(size.values()) / 2 / size[s] * M.MICRO) for s in size}
        assert sum(got.values()) == sum(due[s] // M.MICRO for _, _, s in rows) + (sum(due[s] % M.MICRO for _, _, s in rows) + M.MICRO // 2) // M.MICRO
        out = M.mixed(table(spark, rows).repartition(parts), weights={"a": 0.5, "b": 0.5}, budget=1.0)
        assert out.count() == sum(got.values()) and {r["source"] for r in out.select("source").distinct().collect()} == {"a", "b"}


def test_ties_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    rows = [(None if k % 3 else k % 5, "x" * (1 + k % 2), "abc"[k % 3]) for k in range(200)]
    table(spark, rows).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = Counter(con.execute(M.SQL).fetchall())
    assert Counter((r["doc_id"], r["copies"]) for r in M.sample_copies(table(spark, rows)).collect()) == want


def test_rows_of_every_kind(spark):
    rows = [(1, "abc", None), (2, None, "empty"), (3, "", "empty"), (None, "x", "a"), (4, "x" * 50_000, "a"), (4, "x", "a")]
    out = M.mixed(table(spark, rows), budget=None)
    assert out.columns == ["doc_id", "text", "source", "ink_u", "n"]
    assert sorted(str(r["doc_id"]) for r in out.select("doc_id").distinct().collect()) == ["1", "2", "3", "4", "None"]
    assert M.sample_copies(table(spark, rows), weights={"a": 1.0}).where("doc_id = 1").count() == 0
    assert M.sample_copies(table(spark, rows), weights={}).where("doc_id = 2").count() == 1
    assert M.sample_copies(table(spark, [])).collect() == [] and M.mixed(table(spark, [])).collect() == []
