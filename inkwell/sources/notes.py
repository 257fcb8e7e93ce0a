"""Notes: Markdown texts with a block of `key: value` lines in front, as rows."""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as T

#: A note's columns wherever notes are stored.  topics and projects are lists.
NOTE_SCHEMA = (
    "path string, stem string, type string, slug string, title string, url string, topics array<string>, projects array<string>, project string, "
    "providers string, description string, corroboration int, source_type string, content_kind string, published string, final_url string, "
    "content_digest string, source_count int, ingested_at string, body string"
)
NOTE_COLUMNS = [c.split()[0] for c in NOTE_SCHEMA.split(", ")]
#: The order of the keys in a written note, and the columns that are lists.
FRONT_KEYS = [c for c in NOTE_COLUMNS if c not in ("path", "stem", "body", "topics", "projects")]
PASSED_ON = ("source_type", "content_kind", "published", "final_url", "content_digest")
_FRONT = {
    "source": ["title", "slug", "type", "url", "topics", "projects", "providers", "description", "corroboration", *PASSED_ON, "ingested_at"],
    "topic": ["title", "slug", "type", "project", "source_count", "ingested_at"],
    "report": ["title", "slug", "type", "project", "topics", "ingested_at"],
    "note": ["title", "slug", "type", "topics", "project", "ingested_at"],
}
#: Keys that are written even when empty.
_ALWAYS = {"title", "slug", "type", "url", "topics", "projects", "providers", "project", "source_count", "ingested_at"}
FOLDERS = {"topic": "topics", "source": "sources", "report": "reports", "note": "imported"}


def front_and_body(text: Column) -> Column:
    """A struct of meta and body: a map, empty where there is no closed block in front, and what follows the block.

    The text is gone through once; only the block's lines are taken apart.  Of a key's values the last counts.
    """

    def taken_apart(text: Column) -> Column:
        inside = F.locate("\n---\n", text, 4)
        end = F.when(~text.startswith("---\n"), 0).when(inside > 0, inside).when(text.endswith("\n---"), F.char_length(text) - 3).otherwise(0)
        return T.let(end, lambda end: F.struct(_meta(F.when(end > 4, F.substr(text, F.lit(5), end - 5)).otherwise(F.lit(""))).alias("meta"), _rest(text, end).alias("body")))

    return T.let(text, taken_apart)


def _rest(text: Column, end: Column) -> Column:
    return F.when(end > 0, F.substr(text, end + 5)).otherwise(text)


def _meta(block: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(block, T.LINE_END, -1), lambda x: x.contains(":")),
        lambda x, i: F.struct(T.strip(F.substring_index(x, ":", 1)).alias("k"), i.alias("i"), T.strip(F.substr(x, F.locate(":", x) + 1)).alias("v")),
    )
    # sorted by key and line, so that a key's last line is the one before another key
    last = lambda ps: F.filter(ps, lambda p, i: F.coalesce(F.get(ps, i + 1)["k"] != p["k"], F.lit(True)))
    return F.map_from_entries(F.transform(T.let(F.array_sort(pairs), last), lambda p: F.struct(p["k"], p["v"])))


def parsed(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with meta and body instead of the text column."""
    return texts.withColumn("ink_note", front_and_body(T.newlines(F.col(text)))).withColumns({"meta": F.col("ink_note.meta"), "body": F.col("ink_note.body")}).drop(text, "ink_note")


def markdown_files(folder: str | Path, recursive: bool = True) -> list[str]:
    """Paths of *.md files, ordered by their components; names that begin with a dot or an underscore count too."""
    base = Path(folder)
    if not base.is_dir():
        return []
    found: list[str] = []
    waiting = [str(base)]
    while waiting:
        try:
            with os.scandir(waiting.pop()) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        waiting += [e.path] if recursive else []
                    elif e.name.endswith(".md") and e.name != ".md" and e.is_file():
                        found.append(e.path)
        except OSError:
            if not recursive:
                raise
    return sorted((p.removeprefix("./") for p in found), key=lambda p: p.split("/"))


def parts_of(files: int) -> int:
    """How many tasks read so many files: 1,024 files each, or 64 where there are few."""
    return max(1, min(files // 64, 64), files // 1024)


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(seq, path, text) of some files on a file system that all executors see.

    Executors read the files, so their texts don't pass through the driver; a
    file that isn't UTF-8 makes the job fail.
    """
    rows = spark.createDataFrame(pa.table({"seq": pa.array(range(len(paths)), pa.int64()), "path": pa.array(paths, pa.string())}))
    return texts_of(rows, parts_of(len(paths)))


def texts_of(rows: DataFrame, parts: int) -> DataFrame:
    """rows with the text of the file that each one's path names."""

    def load(batches):
        for b in batches:
            yield b.assign(text=[Path(p).read_bytes().decode("utf-8") for p in b["path"]])

    return rows.repartition(parts, "path").mapInPandas(load, rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", text string")


def scan_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of all *.md below a folder of any file system that Spark reads, listed by Spark.

    Spark leaves out names that begin with a dot or an underscore; read_texts doesn't.
    """
    at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(at.alias("path"), F.col("value").alias("text"))


def as_notes(texts: DataFrame) -> DataFrame:
    """Rows of NOTE_SCHEMA of (path, text)."""
    rows = parsed(texts)
    name = F.element_at(F.split("path", "/"), -1)
    get = lambda k: F.col("meta").getItem(k)
    whole = lambda k: get(k).try_cast("int")
    made = {
        "path": F.col("path"), "stem": F.regexp_replace(name, r"\.md\z", ""), "topics": F.coalesce(T.listed(get("topics")), F.array().cast("array<string>")),
        "projects": F.coalesce(T.listed(get("projects")), F.array().cast("array<string>")), "corroboration": whole("corroboration"), "source_count": whole("source_count"), "body": F.col("body"),
    }
    return rows.select(*[made.get(c, get(c)).alias(c) for c in NOTE_COLUMNS])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NOTE_SCHEMA)


def read_notes(spark: SparkSession, folder: str | Path) -> DataFrame:
    """All notes below a folder; none where it doesn't exist."""
    paths = markdown_files(folder)
    if not paths:
        return empty(spark)
    return as_notes(read_texts(spark, paths).drop("seq"))


def rendered(notes: DataFrame) -> DataFrame:
    """(path, text): notes as Markdown, each value of the front on one line and the body stripped."""

    def line(key: str) -> Column:
        value = T.joined(F.col(key)) if key in ("topics", "projects") else F.col(key).cast("string")
        value = T.collapse(F.coalesce(value, F.lit("")))
        shown = F.concat(F.lit(f"{key}: "), value)
        return shown if key in _ALWAYS else F.when(value != "", shown)

    front = F.lit(None).cast("string")
    for kind, keys in _FRONT.items():
        front = F.when(F.col("type") == kind, F.concat_ws("\n", *[line(k) for k in keys])).otherwise(front)
    text = F.concat(F.lit("---\n"), front, F.lit("\n---\n\n"), T.strip(F.coalesce("body", F.lit(""))), F.lit("\n"))
    return notes.where(F.col("type").isin(*_FRONT)).select("path", text.alias("text"))
