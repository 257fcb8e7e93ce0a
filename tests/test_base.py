"""Runs and notes on disk, taken in, listed, searched and taken in again."""

from __future__ import annotations

import json

import pytest

from inkwell import cli
from inkwell.base import KnowledgeBase
from inkwell.sources import projects
from inkwell.streaming import notes as streaming

LONG = "long enough to be kept as a section of a report"


def material(title, url, body="Some prose about tides.", **more):
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in {"title": title, "url": url, **more}.items()) + f"---\n\n{body}\n"


def project(at, topic, files, /, **result):
    (at / "materials").mkdir(parents=True)
    (at / "result.json").write_text(json.dumps({"topic": topic, "meta_summary": "What is known of tides.", **result}))
    for name, text in files.items():
        (at / "materials" / name).write_text(text)
    return at


@pytest.fixture
def base(spark, tmp_path):
    return KnowledgeBase(spark, tmp_path / "base")


def paths(base, kind):
    return sorted(str(p.relative_to(base.folder / "notes" / kind)) for p in (base.folder / "notes" / kind).glob("*.md"))


def test_runs_below_runs(base, tmp_path):
    top = project(tmp_path / "run", "tides", {"001-a.md": material("A", "https://a.test"), "002-none.md": "no front"}, topic="", overarching_topic="tides")
    project(top / "subprojects" / "one", "moon", {"001-a.md": material("A again", "https://a.test", published="2024-01-01")})
    (top / "subprojects" / "two").mkdir()
    (top / "report.md").write_text(f"## Findings\n{LONG}\n## Findings\n{LONG}\n")
    r = base.ingest_project(top, include_reports=True)
    assert (r.topic, r.source_notes, r.report_notes, r.skipped_sources) == ("tides", 1, 2, 1)
    assert r.skip_reasons == ["materials/002-none.md: no 'url' in frontmatter", "subprojects/two: no result.json (not run)"]
    assert [s.project for s in r.sub_reports] == ["run/one"] and r.sub_reports[0].source_notes == 1
    note = (base.folder / "notes/sources" / paths(base, "sources")[0]).read_text()
    assert "topics: tides, moon\nprojects: run, run/one\n" in note and "corroboration: 2\n" in note and "title: A again" in note
    assert len(paths(base, "topics")) == 2 and len(paths(base, "reports")) == 2
    index = (base.folder / "index.md").read_text()
    assert index.count("https://a.test") == 2 and "2 topics · 1 sources" in index
    log = (base.folder / "log.md").read_text().splitlines()
    assert "ingest run/one: 1 sources, 0 reports, 0 pruned, 0 skipped" in log[2] and "ingest run: 1 sources, 2 reports, 0 pruned, 1 skipped" in log[3]


def test_a_run_that_cites_less(base, tmp_path):
    files = {"1.md": material("A", "https://a.test"), "2.md": material("B", "https://b.test")}
    p, q = project(tmp_path / "p", "t", files), project(tmp_path / "q", "u", {"1.md": files["2.md"]})
    base.ingest_project(p)
    base.ingest_project(q)
    for f in (p / "materials").glob("*.md"):
        f.unlink()
    r = base.ingest_project(p)
    assert r.pruned_sources == 1 and len(paths(base, "sources")) == 1
    assert "projects: q\n" in (base.folder / "notes/sources" / paths(base, "sources")[0]).read_text()
    again = base.ingest_project(q)
    assert (again.source_notes, again.pruned_sources) == (1, 0) and base.version() == 4


@pytest.mark.parametrize("manifest", ["[", "[]", "{}", '{"entries": 1}', '{"entries": ["x"]}', '{"entries": [{"status": "fetched", "file": 3}]}', '{"entries": [{"status": "fetched", "file": ""}]}', '{"entries": [{"status": "fetched", "file": "gone.md"}]}'])
def test_a_wrong_manifest_changes_nothing(base, tmp_path, manifest):
    p = project(tmp_path / "p", "t", {"1.md": material("A", "https://a.test")})
    (p / "materials/index.json").write_text(manifest)
    with pytest.raises(ValueError):
        base.ingest_project(p)
    assert not base.folder.exists()


def test_a_manifest_names_files_in_its_order_and_in_the_folder_alone(base, tmp_path):
    p = project(tmp_path / "p", "t", {n: material(n, f"https://{n}.test") for n in ("a.md", "b.md", "c.md")})
    (tmp_path / "b.md").write_text(material("outside", "https://outside.test"))
    entries = [{"status": "failed"}, {"status": "fetched", "file": "..\\..\\c.md"}, {"status": "fetched", "file": "../../b.md"}]
    (p / "materials/index.json").write_text(json.dumps({"entries": entries}))
    base.ingest_project(p)
    topic = (base.folder / "notes/topics" / paths(base, "topics")[0]).read_text()
    assert topic.index("— c.md") < topic.index("— b.md") and "outside" not in topic and "a.md" not in topic


def test_results_that_are_missing_or_no_object(base, tmp_path):
    with pytest.raises(FileNotFoundError):
        base.ingest_project(tmp_path / "none")
    p = project(tmp_path / "p", "t", {})
    (p / "result.json").write_text("[]")
    with pytest.raises(ValueError):
        base.ingest_project(p)


def test_notes_and_the_command_line(spark, tmp_path, capsys):
    where, notes = ["--brain", str(tmp_path / "base")], tmp_path / "in"
    notes.mkdir()
    (notes / "a.md").write_text(material("A tide", "https://a.test", topic="t", published="2024-05-06", source_type="social"))
    (notes / "b.md").write_text("---\ntitle: Titled\n---\n\nThe tide again.\n")
    (notes / "c.md").write_text("---\nfoo: x\n---\n\ntext\n")
    run = lambda *a: cli.main([*a], spark)
    assert run(*where, "search", "tide") == 2
    assert run(*where, "ingest-notes", str(tmp_path / "gone")) == 1
    capsys.readouterr()
    assert run(*where, "-v", "ingest-notes", str(notes)) == 0
    assert "Ingested 2 notes (1 skipped)" in (said := capsys.readouterr().out) and "skipped c.md: no provenance" in said
    assert run("search", "tide", *where, "-n", "1") == 0
    assert capsys.readouterr().out.startswith("[3] A tide <https://a.test>\n    Some prose about tides.\n    note: ")
    assert run(*where, "search", "absent") == 1 and run(*where, "search", "x", "--limit", "-1") == 1
    capsys.readouterr()
    assert run(*where, "search", "again") == 0
    assert "[1] Titled (note: titled.md)\n    The tide again.\n" in capsys.readouterr().out
    assert run(*where, "list") == 0
    assert capsys.readouterr().out.splitlines()[-1].startswith("2 notes in")
    assert run(*where, "index") == 0 and (tmp_path / "base/index.md").is_file()
    (tmp_path / "base/notes/imported/titled.md").unlink()
    assert run(*where, "sync") == 0
    capsys.readouterr()
    assert run(*where, "list") == 0 and "1 notes in" in capsys.readouterr().out
    assert run() == 0 and run(*where, "ingest", str(tmp_path / "gone")) == 1


def test_pointers_are_replaced_not_repeated(tmp_path, capsys):
    target = tmp_path / "AGENTS.md"
    target.write_text("# Mine\n")
    for brain, said in (("a\\1", "added to"), ("a\\1", "unchanged in"), ("b", "renewed in")):
        assert cli.main(["--brain", brain, "pointer", "--write", str(target)]) == 0
        assert said in capsys.readouterr().out and f"`{brain}`" in target.read_text()
    assert target.read_text().count(cli.BEGIN) == 1 and target.read_text().startswith("# Mine\n")
    assert cli.main(["pointer"]) == 0 and "`brain`" in capsys.readouterr().out


def test_paths_are_sought_below_the_shell_s_folder(tmp_path, monkeypatch):
    (tmp_path / "x").mkdir()
    monkeypatch.setenv("PWD", str(tmp_path))
    assert cli.resolved("x") == (tmp_path / "x").resolve() and cli.resolved("nowhere").is_absolute()


def test_a_folder_with_markdown_alone_is_read(base, tmp_path):
    at = base.folder / "notes/sources"
    at.mkdir(parents=True)
    (at / "s.md").write_text("---\ntitle: Old tide\ntype: source\nurl: https://o.test\ntopics: t\nprojects: p\n---\n\ntext\n")
    assert [h.title for h in base.search("tide")] == ["Old tide"]
    (tmp_path / "n.md").write_text(material("New tide", "https://o.test", topic="u"))
    assert base.ingest_notes(tmp_path / "n.md") == (1, [])
    assert "title: New tide" in (text := (at / "s.md").read_text()) and "topics: t, u" in text


def test_files_that_keep_coming(base, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text(material("A", "https://a.test", topic="t"))
    streaming.watch(base, str(folder), str(tmp_path / "state")).awaitTermination()
    (folder / "b.md").write_text(material("B", "https://a.test", topic="u"))
    streaming.watch(base, str(folder), str(tmp_path / "state")).awaitTermination()
    row = base.notes().first()
    assert (row["title"], row["topics"], base.notes().count(), base.version()) == ("B", ["t", "u"], 1, 2)


def test_materials_are_found_without_joins(spark, tmp_path):
    p = project(tmp_path / "p", "t", {n: material(n, f"https://{n}.test") for n in ("b.md", "a.md")})
    q = project(p / "subprojects" / "q", "u", {n: material(n, f"https://{n}.test") for n in ("b.md", "a.md", ".md")})
    (q / "materials/index.json").write_text(json.dumps({"entries": [{"status": "fetched", "file": "b.md"}, {"status": "failed"}, {"status": "fetched", "file": "a.md"}]}))
    found = projects.material_files(spark, projects.discover(p))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["project"], r["pseq"], r["mseq"], r["path"].rpartition("/")[2]) for r in found.collect())
    assert got == [("p", 0, 0, "a.md"), ("p", 0, 1, "b.md"), ("p/q", 1, 0, "b.md"), ("p/q", 1, 2, "a.md")]
