from __future__ import annotations

import random

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.sources import notes as N


def parse(text):
    """A loop over lines, to hold the expressions against."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.startswith("---\n"):
        return {}, text
    end = text.find("\n---\n", 3)
    if end >= 0:
        block, body = text[4:end], text[end + 5 :]
    elif text.endswith("\n---"):
        block, body = text[4:-4], ""
    else:
        return {}, text
    meta = {}
    for line in block.splitlines():
        if ":" in line:
            k, v = line.split(":", 1)
            meta[k.strip()] = v.strip()
    return meta, body


CASES = ["no front", "", "---\n---\n", "---\n---\nbody", "---\ntitle: A: b\nno pair\ntitle:last\n---\n\nbody\n", "---\na: 1\n---", "---\na: 1\n----\nx", "---\r\na: 1\r\n---\r\n\r\nb", "---\n: x\n---\n\n\nc", "--- \na: 1\n---\n", "---\na: \x1cq\x1fz\n---\nbody\n---\nmore"]


def test_front_matter(spark):
    rng = random.Random(1)
    made = ["---\n" * rng.randint(0, 1) + "".join(rng.choice(["a: 1\n", "b:2", "\n", "---\n", "\n---", "c\r\n", " : ", "x", "é:  y\n", "\x0b"]) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    texts = CASES + made
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in N.parsed(df).collect():
        assert (r["meta"], r["body"]) == parse(texts[r["k"]]), texts[r["k"]]


def test_files_are_read_in_the_order_of_their_components(spark, tmp_path):
    for p in ("a/x.md", "a-b/x.md", "a/_hidden.md", "a/.dot.md", "b/c d+é.md", "b/no.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"---\r\ntitle: T\r\n---\r\n\r\ntext\r\n")
    paths = N.markdown_files(tmp_path)
    assert [p[len(str(tmp_path)) + 1 :] for p in paths] == ["a/.dot.md", "a/_hidden.md", "a/x.md", "a-b/x.md", "b/c d+é.md"]
    rows = N.read_notes(spark, tmp_path).orderBy(T.path_key(F.col("path"))).collect()
    assert [r["title"] for r in rows] == ["T"] * 5 and rows[0]["body"] == "\ntext\n"
    assert {r["path"].rpartition("/")[2] for r in N.scan_texts(spark, str(tmp_path)).collect()} == {"x.md", "c d+é.md"}
    assert N.read_notes(spark, tmp_path / "none").count() == 0


def test_what_is_rendered_is_read_back(spark, tmp_path):
    row = dict.fromkeys(N.NOTE_COLUMNS)
    row |= {"path": "notes/sources/s.md", "stem": "s", "slug": "s", "type": "source", "title": " two\nlines ", "url": "u", "topics": ["a", "b"], "projects": ["p"], "providers": "", "corroboration": 1, "ingested_at": "now", "body": "\n text \n"}
    text = N.rendered(spark.createDataFrame([row], N.NOTE_SCHEMA)).first()["text"]
    assert text == "---\ntitle: two lines\nslug: s\ntype: source\nurl: u\ntopics: a, b\nprojects: p\nproviders: \ncorroboration: 1\ningested_at: now\n---\n\ntext\n"
    (tmp_path / "s.md").write_text(text)
    back = N.read_notes(spark, tmp_path).first()
    assert (back["title"], back["topics"], back["corroboration"], back["body"]) == ("two lines", ["a", "b"], 1, "\ntext\n")
