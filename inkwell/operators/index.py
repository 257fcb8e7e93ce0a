"""What is derived from notes: topic notes, the topic-to-source index, the listing and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.merge import shaped

_NO_LINES = "array<string>"


def topic_notes(runs: DataFrame, links: DataFrame, now: str) -> DataFrame:
    """A topic note for each of (project, pseq, topic, summary); links: (project, mseq, stem, title) of what each run wrote."""
    lines = links.select("project", F.struct("mseq", F.concat(F.lit("- [["), "stem", F.lit("]] — "), "title").alias("line")).alias("l"))
    lines = lines.groupBy("project").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    rows = runs.join(lines, "project", "left").withColumn("ls", F.transform(F.coalesce("ls", F.array().cast("array<struct<mseq: bigint, line: string>>")), lambda x: x["line"]))
    text = F.when(F.size("ls") > 0, F.array_join("ls", "\n")).otherwise("*(none downloaded)*")
    body = F.concat_ws("\n\n", T.blank(T.strip(F.coalesce("summary", F.lit("")))), F.lit("## Sources"), text)
    slug = T.topic_slug(F.col("topic"), F.col("project"))
    rows = rows.withColumns({"slug": slug, "n": F.size("ls"), "body": body})
    return shaped(rows.select(
        F.concat(F.lit("notes/topics/"), "slug", F.lit(".md")).alias("path"), F.col("slug").alias("stem"), F.lit("topic").alias("type"), "slug", T.collapse(F.col("topic")).alias("title"),
        "project", F.col("n").alias("source_count"), F.lit(now).alias("ingested_at"), "body",
    ))


def links(materials: DataFrame, sources: DataFrame) -> DataFrame:
    """(project, mseq, stem, title): what a run's topic note links to, a link for each material written."""
    url = F.col("meta").getItem("url")
    title = T.collapse(F.coalesce(F.col("meta").getItem("title"), url))
    rows = materials.select("project", "mseq", url.alias("url"), title.alias("own"))
    last = rows.groupBy("project", "url").agg(F.max_by("own", "mseq").alias("title"), F.collect_list("mseq").alias("at"))
    return last.join(sources.select("url", "stem"), "url").select("project", F.explode("at").alias("mseq"), "stem", "title")


def run_titles(topics: DataFrame) -> DataFrame:
    """(project, title): the title of each run's topic note, the last by path where there are several."""
    return topics.where(T.blank(F.col("project")).isNotNull()).groupBy("project").agg(F.max_by(F.coalesce("title", F.lit("")), T.path_key(F.col("path"))).alias("title"))


def members(notes: DataFrame) -> DataFrame:
    """(project, path, line) of every source and run, as the index shows it."""
    shown = T.description(F.coalesce("body", F.lit("")))
    about = T.let(shown, lambda x: F.when(x != "", F.concat(F.lit(" — "), x)).otherwise(""))
    line = F.concat(F.lit("- ["), F.coalesce("title", F.lit("")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(") (`"), "stem", F.lit("`)"), about)
    return notes.where("type = 'source'").select(F.explode(F.array_distinct("projects")).alias("project"), "path", line.alias("line"))


def index_entries(notes: DataFrame) -> DataFrame:
    """(path, heading, lines) of every topic: its heading and its sources' lines, in the order of their paths."""
    topics = notes.where("type = 'topic'").select("path", F.coalesce("project", F.lit("")).alias("project"), F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce("project", F.lit("")), F.lit(")")).alias("heading"))
    of = members(notes).groupBy("project").agg(F.array_sort(F.collect_list(F.struct(T.path_key(F.col("path")).alias("k"), "line"))).alias("ls"))
    lines = F.transform(F.coalesce("ls", F.array().cast("array<struct<k: array<string>, line: string>>")), lambda x: x["line"])
    return topics.join(of, "project", "left").select("path", "heading", lines.alias("lines"))


def header(notes: DataFrame) -> DataFrame:
    """(topics, sources): how many there are, by their metadata."""
    return notes.agg(F.count_if(F.col("type") == "topic").alias("topics"), F.count_if(F.col("type") == "source").alias("sources"))


def index_rows(notes: DataFrame) -> DataFrame:
    """(ord, text): the index's blocks in order, after its header."""
    text = F.concat(F.lit("\n"), "heading", F.lit("\n\n"), F.concat_ws("", F.transform("lines", lambda x: F.concat(x, F.lit("\n")))))
    return index_entries(notes).orderBy(T.path_key(F.col("path"))).select("path", text.alias("text"))


def padded(text: Column, size: int) -> Column:
    """text with spaces up to a width, never cut."""
    return F.when(F.char_length(text) < size, F.rpad(text, size, " ")).otherwise(text)


def listing(notes: DataFrame) -> DataFrame:
    """(path, line): a line for each note; order by path_key(path)."""
    line = F.concat(padded(F.coalesce("type", F.lit("?")), 7), F.lit(" "), padded(F.col("stem"), 40), F.lit(" "), F.substring(F.coalesce("title", F.lit("")), 1, 60))
    return notes.select("path", line.alias("line"))
