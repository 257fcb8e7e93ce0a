"""Batches of runs, as set operations, against runs taken one after another by a loop."""

from __future__ import annotations

import random

import pytest

from inkwell.operators import index, merge
from inkwell.sources import notes as N

FIELDS = ("published", "source_type")


def take(base, runs, materials, titles):
    """base: url -> note.  Each run is merged, then what it cites no longer is taken off."""
    pruned = {}
    for project, topic in runs:
        titles[project] = topic
        cited = set()
        for m in materials.get(project, []):
            old = base.get(m["url"])
            note = {"title": m["title"], "body": m["body"], "topics": list(old["topics"]) if old else [], "projects": list(old["projects"]) if old else [], "stem": old["stem"] if old else m["stem"]}
            for k, v in (("topics", topic), ("projects", project)):
                if v not in note[k]:
                    note[k].append(v)
            for f in FIELDS:
                note[f] = m[f] or (old or {}).get(f)
            base[m["url"]] = note
            cited.add(m["url"])
        for url in [u for u in base if u not in cited and project in base[u]["projects"]]:
            note = base[url]
            note["projects"].remove(project)
            if not note["projects"]:
                del base[url]
                pruned[project] = pruned.get(project, 0) + 1
                continue
            known = [titles[p] for p in note["projects"] if p in titles]
            if known:
                note["topics"] = list(dict.fromkeys(known))
    return pruned


@pytest.mark.parametrize("seed", range(4))
def test_batches_of_runs(spark, seed):
    rng = random.Random(seed)
    base, titles, existing = {}, {}, N.empty(spark)
    topic_of = {f"p{k}": f"t{k % 3}" for k in range(6)}
    for _ in range(3):
        runs = [(p, topic_of[p]) for p in sorted(rng.sample(sorted(topic_of), 4), key=lambda _: rng.random())]
        materials = {p: [{"url": f"https://u.test/{rng.randint(0, 12)}", "title": f"title {rng.randint(0, 9)}", "body": f"body {rng.random()}", "stem": f"{k:03d}-s{rng.randint(0, 99)}", "published": rng.choice(["", "2024-01-01", "2025-02-02"]), "source_type": rng.choice(["", "web"])} for k in range(rng.randint(0, 6))] for p, _ in runs}
        pruned = take(base, runs, materials, titles)
        table = spark.createDataFrame([(p, k, t) for k, (p, t) in enumerate(runs)], "project string, pseq bigint, topic string")
        rows = [(p, k, i, m["stem"], {"title": m["title"], "url": m["url"], **{f: m[f] for f in FIELDS}}, m["body"]) for k, (p, _) in enumerate(runs) for i, m in enumerate(materials[p])]
        staged = spark.createDataFrame(rows, "project string, pseq bigint, mseq bigint, stem string, meta map<string,string>, body string")
        known = spark.createDataFrame(list(titles.items()), "project string, title string")
        found, deleted = merge.merge_runs(existing, staged, table, known, "now")
        assert {r["project"]: r["pruned"] for r in deleted.collect()} == pruned
        existing = merge.cut(found)
        got = {r["url"]: r for r in existing.collect()}
        assert got.keys() == base.keys()
        for url, want in base.items():
            r = got[url]
            assert (r["title"], r["body"], r["projects"], r["topics"], r["corroboration"]) == (want["title"], want["body"], want["projects"], want["topics"], len(want["projects"])), url
            assert r["stem"].split("-", 1)[1] == want["stem"][4:]
            assert (r["published"] or None, r["source_type"] or None) == (want["published"] or None, want["source_type"] or None)


def notes_frame(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, stem string, meta map<string,string>, body string")


def test_free_notes(spark):
    rows = [
        (0, "a", {"url": "u", "title": "One", "topics": "x, y", "project": "p"}, " first "), (1, "b", {"url": "u", "topic": "y", "source": "q", "providers": "prov"}, "second"),
        (2, "c", {"url": "v"}, "third"), (3, "d", {"title": "Same Name"}, "old"), (4, "e", {"title": "same name!"}, "new"), (5, "f", {"project": "p"}, "by stem"),
    ]
    out = {r["url"]: r for r in merge.merge_notes(N.empty(spark), notes_frame(spark, rows), "now").collect()}
    u = out["u"]
    assert (u["title"], u["body"], u["topics"], u["projects"], u["providers"], u["description"]) == ("u", "second", ["x", "y"], ["p", "q"], "prov", None)
    assert out["v"]["topics"] == ["imported"] and out["v"]["projects"] == []
    again = merge.merge_notes(merge.merge_notes(N.empty(spark), notes_frame(spark, rows), "now"), notes_frame(spark, [(0, "z", {"url": "u", "title": "New", "providers": "other"}, "third")]), "later")
    u = {r["url"]: r for r in again.collect()}["u"]
    assert (u["title"], u["providers"], u["topics"], u["projects"], u["stem"]) == ("New", "prov", ["x", "y", "imported"], ["p", "q"], out["u"]["stem"])
    made = {r["stem"]: r["body"] for r in merge.imported_notes(notes_frame(spark, rows), "now").collect()}
    assert made == {"same-name": "new", "f": "by stem"}


def test_fields_that_free_notes_lack_are_dropped_or_kept(spark):
    row = dict.fromkeys(N.NOTE_COLUMNS) | {"path": "notes/sources/s.md", "stem": "s", "type": "source", "url": "u", "topics": ["t"], "projects": ["p"], "published": "2024-01-01", "corroboration": 1, "body": "b"}
    old = spark.createDataFrame([row], N.NOTE_SCHEMA)
    new = notes_frame(spark, [(0, "a", {"url": "u"}, "x")])
    assert merge.merge_notes(old, new, "now").first()["published"] is None
    assert merge.merge_notes(old, new, "now", preserve=True).first()["published"] == "2024-01-01"
    untouched = merge.merge_notes(old, new.limit(0), "now").first()
    assert (untouched["published"], untouched["body"], untouched["path"]) == ("2024-01-01", "b", "notes/sources/s.md")


def test_gates(spark):
    rows = [("a.md", {}, ""), ("b.md", {"url": "u"}, " \n"), ("c.md", {"url": "u"}, "x"), ("d.md", {"foo": "1"}, "x"), ("e.md", {"source": "s"}, "x")]
    df = spark.createDataFrame(rows, "name string, meta map<string,string>, body string")
    assert [r["reason"] for r in merge.gate_materials(df).orderBy("name").collect()] == ["materials/a.md: no 'url' in frontmatter", "materials/b.md: empty body", None, "materials/d.md: no 'url' in frontmatter", "materials/e.md: no 'url' in frontmatter"]
    assert [r["reason"] for r in merge.gate_notes(df).orderBy("name").collect()] == ["a.md: empty body", "b.md: empty body", None, "d.md: no provenance frontmatter (need url/project/title)", None]


def test_urls_with_one_digest_get_different_names(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(merge.T, "digest8", lambda c, digits=8: F.lit("00000000"))
    rows = spark.createDataFrame([("a", 0, "w-a"), ("b", 1, "w-b")], "url string, seq bigint, wanted string")
    none = rows.select("url").limit(0)
    got = {r["url"]: r["stem"] for r in merge.with_stems(rows, none).collect()}
    assert got["a"] == "w-a" and len(got["b"]) == 40
    later = {r["url"]: r["stem"] for r in merge.with_stems(rows, spark.createDataFrame([("z",)], "url string")).collect()}
    assert all(len(s) == 40 for s in later.values())


def test_index_and_topic_notes(spark):
    row = dict.fromkeys(N.NOTE_COLUMNS)
    notes = spark.createDataFrame([
        row | {"path": "notes/topics/b.md", "stem": "b", "type": "topic", "title": "B", "project": "q"}, row | {"path": "notes/topics/a.md", "stem": "a", "type": "topic", "title": "A", "project": "p"},
        row | {"path": "notes/sources/s2.md", "stem": "s2", "type": "source", "title": "S2", "url": "u2", "projects": ["p", "p"], "body": "# H\n\nProse."},
        row | {"path": "notes/sources/s1.md", "stem": "s1", "type": "source", "title": "S1", "url": "u1", "projects": ["x", "p"], "body": ""},
    ], N.NOTE_SCHEMA)
    assert [r["text"] for r in index.index_rows(notes).collect()] == ["\n## A (p)\n\n- [S1](u1) (`s1`)\n- [S2](u2) (`s2`) — Prose.\n", "\n## B (q)\n\n"]
    assert index.header(notes).first().asDict() == {"topics": 2, "sources": 2}
    runs = spark.createDataFrame([("p", 0, "T", " sum "), ("q", 1, "T", "")], "project string, pseq bigint, topic string, summary string")
    links = spark.createDataFrame([("p", 1, "s2", "S2"), ("p", 0, "s1", "S1")], "project string, mseq bigint, stem string, title string")
    made = {r["project"]: r for r in index.topic_notes(runs, links, "now").collect()}
    assert made["p"]["body"] == "sum\n\n## Sources\n\n- [[s1]] — S1\n- [[s2]] — S2" and made["p"]["source_count"] == 2
    assert made["q"]["body"] == "## Sources\n\n*(none downloaded)*" and made["q"]["stem"] != made["p"]["stem"]


@pytest.mark.parametrize("kind", ["notes", "runs"])
def test_texts_that_lose_stay_where_they_are_read(spark, kind):
    rows = [("p", 0, k, "s", {"url": f"https://{k % 2}.test"}, f"text {k}") for k in range(6)]
    texts = spark.createDataFrame(rows, "project string, pseq bigint, mseq bigint, stem string, meta map<string,string>, body string")
    if kind == "notes":
        out = merge.merge_notes(N.empty(spark), texts.withColumnRenamed("mseq", "seq"), "now")
    else:
        runs = spark.createDataFrame([("p", 0, "t")], "project string, pseq bigint, topic string")
        out = merge.merge_runs(N.empty(spark), texts, runs, index.run_titles(N.empty(spark)), "now")[0]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["body"] for r in out.collect()) == ["text 4", "text 5"]
