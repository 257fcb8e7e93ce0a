"""Provenance gates, and merging of incoming notes into existing ones by URL, as set operations.

Incoming notes have an order, and the result is what taking them one after
another would give.  A batch may hold many runs: what one run no longer cites
is taken off in the same pass (see `merge_runs`).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.sources.notes import NOTE_COLUMNS, NOTE_SCHEMA, PASSED_ON

#: Rows of a batch's table of runs up to which it is sent to all executors.
SMALL_ROWS = 100_000
_TYPES = dict(c.split() for c in NOTE_SCHEMA.split(", "))
_LIST = "array<string>"


def _sent_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def _wanted(bodies: DataFrame, keys: DataFrame, at: list[Column]) -> DataFrame:
    """bodies that keys name, left where they are read; where there are many keys, all bodies."""
    few = _sent_if_small(keys)
    return bodies if few is keys else bodies.join(few, at, "left_semi")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder in spark.checkpoint.dir, without its lineage.

    Where none is set, a local session gets a folder of its own; on a cluster,
    whose machines would each have another, that is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="inkwell-checkpoint-"))
    return df.checkpoint(eager=True)


def _value(key: str) -> Column:
    return F.coalesce(F.col("meta").getItem(key), F.lit(""))


def gate_materials(texts: DataFrame) -> DataFrame:
    """texts (with meta, body, name) and `reason`: null for those that may enter; a missing URL counts before an empty body."""
    reason = F.when(_value("url") == "", "no 'url' in frontmatter").when(T.strip(F.col("body")) == "", "empty body")
    return texts.withColumn("reason", F.concat(F.lit("materials/"), "name", F.lit(": "), reason))


def gate_notes(texts: DataFrame) -> DataFrame:
    """texts (with meta, body, name) and `reason`: an empty body counts before missing provenance."""
    nothing = (_value("url") == "") & (_value("project") == "") & (_value("source") == "") & (_value("title") == "")
    reason = F.when(T.strip(F.col("body")) == "", "empty body").when(nothing, "no provenance frontmatter (need url/project/title)")
    return texts.withColumn("reason", F.concat("name", F.lit(": "), reason))


def first_seen(items: Column, seq: Column, kind: str = "string") -> Column:
    """Aggregate: distinct items of lists, in the order in which they first occur."""
    lists = F.array_sort(F.collect_list(F.struct(seq.alias("s"), items.alias("x"))))
    return F.array_distinct(F.flatten(F.transform(lists, lambda r: r["x"]))).cast(f"array<{kind}>")


def newest(value: Column, seq: Column) -> Column:
    """Aggregate: the last value that isn't empty."""
    full = T.blank(value)
    return F.max_by(full, F.when(full.isNotNull(), seq))


def shaped(rows: DataFrame) -> DataFrame:
    """rows with the columns of NOTE_SCHEMA, null where they have none."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(_TYPES[c]).alias(c) for c in NOTE_COLUMNS])


def with_stems(rows: DataFrame, taken: DataFrame, digits: int = 8) -> DataFrame:
    """rows (url, seq, wanted) with `stem`: the wanted name, but of several URLs with one digest only the first has it.

    taken: (url) of notes that exist.  The others are named by the whole digest.
    """
    digests = rows.select("url", F.lit(0).alias("old"), "seq").unionByName(taken.select("url", F.lit(1).alias("old"), F.lit(None).alias("seq")))
    place = F.row_number().over(Window.partitionBy(T.digest8(F.col("url"), digits)).orderBy(F.desc("old"), "seq", "url"))
    later = digests.withColumn("r", place).where("r > 1 and old = 0").select(F.col("url").alias("clash"))
    joined = rows.join(later, rows["url"] == F.col("clash"), "left")
    return joined.withColumn("stem", F.when(F.col("clash").isNull(), F.col("wanted")).otherwise(F.sha1("url"))).drop("clash", "wanted")


def merge_runs(existing: DataFrame, materials: DataFrame, runs: DataFrame, topic_titles: DataFrame, now: str, digits: int = 8) -> tuple[DataFrame, DataFrame]:
    """(source notes, deletions) after some runs' materials are merged and what they cite no longer is taken off.

    existing: source notes.  materials: (project, pseq, mseq, stem, meta, body),
    those that passed the gate, each with numbers of its own.  runs: (project,
    pseq, topic), in the order in which they are taken.  topic_titles: (project,
    title) of all topic notes.  digits: of a URL's digest in a name.  deletions:
    (project, pruned).

    Who wins, lists and deletions are worked out without any text, and written
    to the checkpoint folder; the texts of what is left are joined once, last.

    For each URL: the newest title, text and providers, the union of topics and
    runs in the order in which they came, and of each passed-on field the newest
    value that isn't empty.  A note loses the runs of the batch that don't cite
    it any more; one that has none left before another run of the batch cites
    it is deleted, and made anew if one does.
    """
    runs = _sent_if_small(runs)
    seq = F.struct("pseq", "mseq")
    slim = materials.select(
        "project", "pseq", "mseq", "stem", _value("url").alias("url"), T.collapse(F.coalesce(F.col("meta").getItem("title"), _value("url"))).alias("title"), T.collapse(_value("providers")).alias("providers"),
        *[_value(f).alias(f) for f in PASSED_ON],
    )
    cited = (
        slim.join(runs.select("project", "topic"), "project")
        .groupBy("url")
        .agg(
            F.max_by(F.struct("title", "providers", "pseq", "mseq"), seq).alias("new"), F.min_by("stem", seq).alias("wanted"), F.min(seq).alias("seq"),
            F.array_sort(F.collect_set(F.struct("pseq", "project", "topic"))).alias("cites"), *[newest(F.col(f), seq).alias(f"new_{f}") for f in PASSED_ON],
        )
        .withColumn("wanted", T.source_slug(F.col("url"), F.col("wanted"), digits))
    )
    members = (
        existing.select("url", F.explode("projects").alias("project")).join(runs.select("project", "pseq"), "project")
        .groupBy(F.col("url").alias("m_url")).agg(F.collect_list(F.struct("pseq", "project")).alias("members"))
    )
    old = existing.select(*[F.col(c).alias(f"old_{c}") for c in NOTE_COLUMNS if c != "body"]).join(members, F.col("old_url") == F.col("m_url"), "left").drop("m_url")
    both = old.join(cited, F.col("old_url") == F.col("url"), "full_outer").withColumn("url", F.coalesce("url", "old_url"))

    no_cites = F.array().cast("array<struct<pseq: bigint, project: string, topic: string>>")
    both = both.withColumns({"cites": F.coalesce("cites", no_cites), "was": F.coalesce("old_projects", F.array().cast(_LIST)), "known": F.coalesce("old_topics", F.array().cast(_LIST))})
    both = both.withColumn("off", F.filter(F.coalesce("members", F.array().cast("array<struct<pseq: bigint, project: string>>")), lambda m: ~F.exists(F.col("cites"), lambda c: c["project"] == m["project"])))
    both = both.withColumn("left", F.filter("was", lambda p: ~F.exists(F.col("off"), lambda m: m["project"] == p)))
    both = both.withColumns({"last_off": F.array_max(F.transform("off", lambda m: m["pseq"])), "first_cite": F.get("cites", F.lit(0))["pseq"]})
    dead = (F.size("off") > 0) & (F.size("left") == 0) & (F.col("first_cite").isNull() | (F.col("last_off") < F.col("first_cite")))
    both = both.withColumn("dead", F.coalesce(dead, F.lit(False)))
    both = cut(both.withColumn("alive", F.col("old_url").isNotNull() & ~F.col("dead")))

    deleted = both.where("dead").select(F.explode("off").alias("m"), "last_off").where("m.pseq = last_off").groupBy(F.col("m.project").alias("project")).agg(F.count(F.lit(1)).alias("pruned"))
    kept = both.where(~F.col("dead") | (F.size("cites") > 0))

    # topics of notes that lost a run follow from the runs that are left
    titles = topic_titles.select("project", F.col("title").alias("run_title"))
    lost = kept.where(F.col("alive") & (F.size("off") > 0)).withColumn("then", F.concat("left", F.transform(F.filter("cites", lambda c: c["pseq"] < F.col("last_off")), lambda c: c["project"])))
    again = (
        lost.select("url", F.posexplode("then").alias("at", "project")).join(titles, "project")
        .groupBy(F.col("url").alias("a_url")).agg(F.array_sort(F.collect_list(F.struct("at", "run_title"))).alias("again"))
    )
    kept = kept.join(again, F.col("url") == F.col("a_url"), "left")
    before = F.filter("cites", lambda c: F.col("last_off").isNull() | (c["pseq"] < F.col("last_off")))
    after = F.filter("cites", lambda c: F.col("last_off").isNotNull() & (c["pseq"] >= F.col("last_off")))
    topics_of = lambda cites: F.transform(cites, lambda c: c["topic"])
    base = F.when(F.col("again").isNotNull(), F.array_distinct(F.transform("again", lambda a: a["run_title"]))).otherwise(F.array_distinct(F.concat("known", topics_of(before))))
    topics = F.when(F.col("alive"), F.array_distinct(F.concat(base, topics_of(after)))).otherwise(F.array_distinct(topics_of(F.col("cites"))))
    names = F.transform("cites", lambda c: c["project"])
    projects = F.when(F.col("alive"), F.array_distinct(F.concat("left", names))).otherwise(F.array_distinct(names))

    came = F.size("cites") > 0
    old_value = lambda c: F.when(F.col("alive"), F.col(f"old_{c}"))
    touched = came | (F.size("off") > 0)
    named = with_stems(kept.where(came & ~F.col("alive")).select("url", "seq", "wanted"), kept.where("alive").select("url"), digits).select(F.col("url").alias("n_url"), F.col("stem").alias("n_stem"))
    kept = kept.join(named, F.col("url") == F.col("n_url"), "left").withColumn("final_stem", F.coalesce(old_value("stem"), "n_stem"))
    new = lambda c: F.when(came, F.col(f"new.{c}")).otherwise(old_value(c))
    result = kept.select(
        F.when(F.col("alive"), F.col("old_path")).otherwise(F.concat(F.lit("notes/sources/"), "final_stem", F.lit(".md"))).alias("path"),
        F.col("final_stem").alias("stem"), F.lit("source").alias("type"), F.col("final_stem").alias("slug"), new("title").alias("title"), "url",
        F.when(touched, topics).otherwise(F.col("old_topics")).alias("topics"), F.when(touched, projects).otherwise(F.col("old_projects")).alias("projects"), old_value("project").alias("project"),
        new("providers").alias("providers"), old_value("description").alias("description"), F.when(touched, F.size(projects)).otherwise(old_value("corroboration")).alias("corroboration"),
        *[F.coalesce(f"new_{f}", old_value(f)).alias(f) for f in PASSED_ON],
        F.when(came, F.lit(now)).otherwise(old_value("ingested_at")).alias("ingested_at"), F.col("new.pseq").alias("at_pseq"), F.col("new.mseq").alias("at_mseq"), came.alias("came"),
    )
    result = cut(result)
    at = [F.col("at_pseq") == F.col("b_pseq"), F.col("at_mseq") == F.col("b_mseq")]
    bodies = materials.select(F.col("pseq").alias("b_pseq"), F.col("mseq").alias("b_mseq"), T.strip(F.col("body")).alias("body"))
    came_here = result.where("came")
    fresh = _wanted(bodies, came_here.select("at_pseq", "at_mseq"), at).join(came_here, at).withColumn("description", T.description(F.col("body")))
    return shaped(fresh).unionByName(shaped(_with_old_bodies(result.where(~F.col("came")), existing))), deleted


def _with_old_bodies(rows: DataFrame, existing: DataFrame) -> DataFrame:
    return existing.select(F.col("url").alias("b_url"), "body").join(rows, F.col("b_url") == F.col("url"))


def merge_notes(existing: DataFrame, notes: DataFrame, now: str, preserve: bool = False, digits: int = 8) -> DataFrame:
    """Source notes after notes with a URL are merged.

    existing: source notes.  notes: (seq, stem, meta, body), those that passed
    the gate, each with a seq of its own.  As in `merge_runs`, texts are joined
    once, last.  Title and text are the newest, topics and runs are unions in the
    order in which they came, providers the oldest that aren't empty.  Fields
    that such notes don't carry are dropped, as a run's own notes would lose
    them too; with `preserve` they stay.
    """
    incoming = notes.where(_value("url") != "").select(
        _value("url").alias("url"), "seq", "stem", T.collapse(F.coalesce(T.blank(_value("title")), _value("url"))).alias("title"), T.collapse(_value("providers")).alias("providers"),
        T.listed(F.coalesce(T.blank(_value("topics")), T.blank(_value("topic")), F.lit("imported"))).alias("topics"), T.listed(F.coalesce(T.blank(_value("project")), _value("source"))).alias("projects"),
    )
    full = T.blank(F.col("providers"))
    grouped = incoming.groupBy("url").agg(
        F.max_by(F.struct("title", F.col("seq").alias("at")), "seq").alias("new"), F.min_by("stem", "seq").alias("wanted"), F.min("seq").alias("seq"), first_seen(F.col("topics"), F.col("seq")).alias("new_topics"),
        first_seen(F.col("projects"), F.col("seq")).alias("new_projects"), F.min_by(full, F.when(full.isNotNull(), F.col("seq"))).alias("new_providers"),
    )
    grouped = grouped.withColumn("wanted", T.source_slug(F.col("url"), F.col("wanted"), digits))
    old = existing.select(*[F.col(c).alias(f"old_{c}") for c in NOTE_COLUMNS if c != "body"])
    both = cut(old.join(grouped, F.col("old_url") == F.col("url"), "full_outer").withColumn("url", F.coalesce("url", "old_url")))
    came = F.col("new").isNotNull()
    named = with_stems(both.where(came & F.col("old_url").isNull()).select("url", "seq", "wanted"), existing.select("url"), digits).select(F.col("url").alias("n_url"), F.col("stem").alias("n_stem"))
    both = both.join(named, F.col("url") == F.col("n_url"), "left").withColumn("final_stem", F.coalesce("old_stem", "n_stem"))
    union = lambda c: F.array_distinct(F.concat(F.coalesce(f"old_{c}", F.array().cast(_LIST)), F.coalesce(f"new_{c}", F.array().cast(_LIST))))
    stays = ["description", "corroboration", *PASSED_ON]
    result = both.select(
        F.coalesce("old_path", F.concat(F.lit("notes/sources/"), "final_stem", F.lit(".md"))).alias("path"), F.col("final_stem").alias("stem"), F.lit("source").alias("type"), F.col("final_stem").alias("slug"),
        F.when(came, F.col("new.title")).otherwise(F.col("old_title")).alias("title"), "url", union("topics").alias("topics"), union("projects").alias("projects"), F.col("old_project").alias("project"),
        F.when(came, F.coalesce(T.blank(F.col("old_providers")), "new_providers")).otherwise(F.col("old_providers")).alias("providers"),
        *[F.when(came & ~F.lit(preserve), F.lit(None)).otherwise(F.col(f"old_{f}")).alias(f) for f in stays],
        F.when(came, F.lit(now)).otherwise(F.col("old_ingested_at")).alias("ingested_at"), F.col("new.at").alias("at"), came.alias("came"),
    )
    result = cut(result)
    at = [F.col("at") == F.col("b_seq")]
    bodies = notes.where(_value("url") != "").select(F.col("seq").alias("b_seq"), T.strip(F.col("body")).alias("body"))
    came_here = result.where("came")
    fresh = _wanted(bodies, came_here.select("at"), at).join(came_here, at)
    return shaped(fresh).unionByName(shaped(_with_old_bodies(result.where(~F.col("came")), existing)))


def imported_notes(notes: DataFrame, now: str) -> DataFrame:
    """Notes without URL, named by their titles; of equal names the last stays."""
    title = T.collapse(F.coalesce(T.blank(_value("title")), F.col("stem")))
    rows = notes.where(_value("url") == "").withColumns({"title": title, "slug": T.either(F.substring(T.slugify(title), 1, 60), "note")})
    topics = T.listed(F.coalesce(T.blank(_value("topics")), T.blank(_value("topic")), F.lit("imported")))
    made = F.struct("title", topics.alias("topics"), T.collapse(F.coalesce(T.blank(_value("project")), _value("source"))).alias("project"), T.strip(F.col("body")).alias("body"))
    last = rows.withColumn("made", made).groupBy("slug").agg(F.max_by("made", "seq").alias("made"))
    return shaped(last.select(
        F.concat(F.lit("notes/imported/"), "slug", F.lit(".md")).alias("path"), F.col("slug").alias("stem"), F.lit("note").alias("type"), "slug", "made.title", "made.topics", "made.project", F.lit(now).alias("ingested_at"), "made.body",
    ))


def replaced(existing: DataFrame, new: DataFrame, key: str = "path", keys: DataFrame | None = None) -> DataFrame:
    """existing with new rows, which take the place of those with their key; keys: rows with the same keys, where they cost less."""
    return existing.join((new if keys is None else keys).select(F.col(key).alias("new_key")), F.col(key) == F.col("new_key"), "left_anti").unionByName(new)
