"""The corpus pipeline, a stage at a time, against what each stage is to do."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
import pyarrow as pa
import pytest
from conftest import SMALL

from inkwell.llm import near_dedup, toxicity

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DIR}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        out.append(docs)
        stage(spark, docs, DIR).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return [*out, docs]


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_toxic_documents_go_and_no_others(spark, stages):
    said = {r["doc_id"]: r["toxic"] for r in toxicity.score(stages[0], spark.read.parquet(f"{DIR}/labels.parquet")).collect()}
    assert ids(stages[1]) == Counter(i for i in ids(stages[0]) if not said[i])
    labels = spark.read.parquet(f"{DIR}/labels.parquet").collect()
    clean = [r["doc_id"] for r in labels if not r["toxic"]]
    assert sum(said[i] for i in clean) < 0.03 * len(clean)
    toxic = [r["doc_id"] for r in labels if r["toxic"]]
    assert sum(said[i] for i in toxic) > 0.7 * len(toxic)


def test_one_of_each_text_stays(stages):
    first = {}
    for r in stages[1].collect():
        first[r["text"]] = min(r["doc_id"], first.get(r["text"], r["doc_id"]))
    assert ids(stages[2]) == Counter(first.values())


def test_one_of_each_group_of_near_copies_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    sig, has = near_dedup.signatures(pa.array([t for _, t in rows]), near_dedup.COORDINATES, near_dedup.SHINGLE, near_dedup.SEED)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in ((sig == sig[a]).sum(axis=1) >= near_dedup.THRESHOLD).nonzero()[0] if has[a] else []:
            if has[b]:
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    assert ids(stages[3]) == Counter(i for i in root if find(i) == i)


def test_small_sources_are_repeated_and_nothing_is_left_out(stages):
    before, after = stages[3].collect(), ids(stages[4])
    assert set(after) == {r["doc_id"] for r in before}
    size, n = Counter(), Counter()
    for r in before:
        size[r["source"]] += len(r["text"] or "")
        n[r["source"]] += after[r["doc_id"]] * len(r["text"] or "")
    total, weight = sum(n.values()), sum(s**0.7 for s in size.values())
    big = [s for s in size if size[s] > 0.02 * sum(size.values())]
    assert all(abs(n[s] / total - size[s] ** 0.7 / weight) < 0.25 * size[s] ** 0.7 / weight + 0.01 for s in big)


def test_every_word_is_packed(stages):
    words, packed, full = Counter(), Counter(), Counter()
    for r in stages[4].collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    for r in stages[5].collect():
        packed[r["doc_id"]] += r["words"]
        full[r["pack_id"]] += r["words"]
    assert +packed == +words and set(packed) == set(words)
    assert all(n == 2048 for p, n in full.items() if p < max(full))


def test_run_is_the_stages(spark):
    assert P.run(spark, SMALL).columns == ["pack_id", "pack_start", "doc_id", "doc_start", "words", "curve_key"]


def test_rows_of_every_kind(spark, tmp_path):
    insult = "you vile hateful slurry filth "
    # unlike one another: with fewer words of their own MinHash takes some for near copies
    calm = lambda k: f"a kind calm river walk number {k} by the {k * k} trees and hills of {k * 7} " + " ".join(f"meadow{k * 31 + j}" for j in range(20))
    rows = [(k, insult * 3 if k % 2 else calm(k), "s", "en", 20) for k in range(60)]
    rows += [(100, None, None, None, None), (101, "", "s", "en", 0), (102, "", "s", "en", 0), (None, "a quiet text of no name", "s", "en", 3), (103, "calm river " * 50_000, None, "en", 9), (104, "calm river " * 50_000, "t", "en", 9), (2, calm(2), "s", "en", 20)]
    kind = "doc_id bigint, text string, source string, lang string, n_chars bigint, ink_k string, i bigint, t string, ink_copies int, ink_source string, ink_node int"
    docs = spark.createDataFrame([(*r, "clash", 0, None, 7, "clash", 1) for r in rows], kind)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)] + [(None, None, None)], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter()
    for r in P.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["words"]
    assert all((k in got) == (k % 2 == 0) for k in range(60)) and {100, 101, None} <= set(got) and 102 not in got
    assert 103 in got and 104 not in got
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").collect() == []
