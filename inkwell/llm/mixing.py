"""Mixing sources to target weights by Pareto order sampling.

A source's rows are each due `w * budget / size of the source` copies, where w
is its target share and sizes are characters.  The whole part of that is
certain: every row gets so many copies.  The rest p is an inclusion
probability, and one sample of fixed size, the rounded sum of all p, is drawn
over all sources: a row's random odds u / (1 - u) are divided by its inclusion
odds p / (1 - p), and the rows with the smallest ratios are taken.  u comes
from the identifier's digest and the seed, so a row's number stays the same
however the table is partitioned.

Only (ratio, identifier) is sorted; the texts are never shuffled.

Cases: rows without source are a source of their own; a null text has no
size, a very long one counts whole; rows of a source without size get one copy
each; a source that explicit weights don't name, or give 0, gets none; rows of
one identifier (or of none) draw the same number, and are ordered by identifier
(none first), source and a digest of the whole row, so that the sample has its
size whatever repeats; of rows that are equal in everything any may be taken;
an empty table gives an empty result; other columns aren't looked at but for
that digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import boxed, cut, ranked, small

SEED = 4
#: Target shares are in proportion to a source's size to this power.
TEMPER = 0.5
MICRO = 1_000_000


def _number(doc_id: str, seed: int) -> F.Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def due(docs: DataFrame, text: str, source: str, weights: dict[str | None, float] | None, budget: float | None, temper: float) -> DataFrame:
    """(ink_source, ink_n, ink_due): rows of each source, and millionths of copies due to each of them."""
    per = docs.select(F.col(f"`{source}`").alias("ink_source"), F.char_length(F.col(f"`{text}`")).cast("bigint").alias("l"))
    per = cut(per.groupBy("ink_source").agg(F.count(F.lit(1)).alias("ink_n"), F.coalesce(F.sum("l"), F.lit(0)).alias("t")))
    if weights is None:
        per = per.withColumn("w", F.pow(F.col("t").cast("double"), F.lit(temper)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "k string, w double")
        per = per.join(given, F.col("ink_source").eqNullSafe(F.col("k")), "left").withColumn("w", F.coalesce("w", F.lit(0.0))).drop("k")
    all_of = per.where("t > 0").agg(F.sum("t").alias("all_t"), F.sum("w").alias("all_w"), F.max(F.expr("CASE WHEN w > 0 THEN t / w END")).alias("most"))
    # without a budget: the smallest at which no source with a weight is cut
    size = F.col("most") * F.col("w") if budget is None else F.lit(float(budget)) * F.col("all_t") * F.col("w") / F.col("all_w")
    per = per.crossJoin(all_of).withColumn("ink_due", F.when(F.col("t") == 0, F.lit(MICRO)).when(F.col("w") <= 0, F.lit(0)).otherwise(F.round(size / F.col("t") * MICRO)).cast("bigint"))
    return cut(per.select("ink_source", "ink_n", "ink_due"))


def with_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None, budget: float | None = 1.0, temper: float = TEMPER, seed: int = SEED) -> DataFrame:
    """docs with ink_copies.  budget: times the table's size, None for the smallest that leaves no row out."""
    per = due(docs, text, source, weights, budget, temper)
    size = per.agg(F.sum(F.col("ink_n") * (F.col("ink_due") % MICRO)).alias("s")).first()["s"] or 0
    take = (size + MICRO // 2) // MICRO
    p = F.col("ink_due") % MICRO / float(MICRO)

    def rated(df: DataFrame) -> DataFrame:
        df = df.join(small(per), F.col(f"`{source}`").eqNullSafe(F.col("ink_source"))).withColumn("ink_u", _number(f"`{doc_id}`", seed))
        odds = F.col("ink_u") / (1 - F.col("ink_u")) * ((1 - p) / p)
        return df.withColumn("ink_q", F.when(F.col("ink_due") % MICRO > 0, odds)).withColumn("ink_i", F.col(f"`{doc_id}`").cast("bigint"))

    taken, equal, n_equal, n_taken = F.lit(False), None, 0, 0
    if take:
        slim = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([doc_id, source])])
        line = ranked(rated(slim).where("ink_q IS NOT NULL").select("ink_q", "ink_i"), [F.col("ink_q"), F.col("ink_i")])
        last = line.where(F.col("before") == take - 1).select("ink_q", "ink_i").first()
        q, i = F.lit(last["ink_q"]), F.lit(last["ink_i"]).cast("bigint")
        tie = F.coalesce((F.col("ink_q") == q) & F.col("ink_i").eqNullSafe(i), F.lit(False))
        taken = F.coalesce((F.col("ink_q") < q) | ((F.col("ink_q") == q) & (F.col("ink_i").isNull() & i.isNotNull() | (F.col("ink_i") < i))), F.lit(False))
        tied = line.where(tie).agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("ahead")).first()
        left = take - tied["ahead"]
        if left == tied["n"]:
            taken = taken | tie
        else:  # rows of one identifier, of which not all are taken
            digest = F.sha2(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).cast("string"), 256)
            key = F.struct(F.col(f"`{source}`").cast("string").alias("s"), digest.alias("d"))
            line = ranked(rated(docs).where(tie).select(key.alias("ink_h")), [F.col("ink_h")])
            last = line.where(F.col("before") == left - 1).first()["ink_h"]
            at = F.struct(F.lit(last["s"]).cast("string").alias("s"), F.lit(last["d"]).alias("d"))
            tied = line.where(F.col("ink_h").eqNullSafe(at)).agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("ahead")).first()
            n_equal, n_taken = tied["n"], left - tied["ahead"]
            equal = tie & F.when(tie, key).eqNullSafe(at)
            taken = taken | (tie & F.coalesce(F.when(tie, key) < at, F.lit(False)))
    whole = F.floor(F.col("ink_due") / MICRO).cast("bigint")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = rated(docs)
    if equal is None:
        return rows.withColumn("ink_copies", whole + taken.cast("bigint")).select(*columns, "ink_copies")
    # rows that are equal in everything are made anew from one of them, so many with and so many without a copy more
    one = rows.where(equal).limit(1).select(F.struct(*columns).alias("ink_one"), whole.alias("ink_whole"), F.lit(0).cast("bigint").alias("ink_k"))
    many = docs.sparkSession.range(n_equal).select("id", (F.col("id") * 0).alias("ink_k")).join(F.broadcast(one), "ink_k")  # a single row
    many = many.select("ink_one.*", (F.col("ink_whole") + (F.col("id") < n_taken).cast("bigint")).alias("ink_copies"))
    return rows.where(~equal).withColumn("ink_copies", whole + taken.cast("bigint")).select(*columns, "ink_copies").unionByName(many)


def sample_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """(doc_id, copies) of every row that gets at least one."""
    slim = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([doc_id, source, text])])
    out = with_copies(slim, text, doc_id, source, **how)
    return out.where("ink_copies > 0").select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col("ink_copies").alias("copies"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """docs with every row as often as it has copies, in its columns."""
    rows = docs.select(boxed(docs), *[F.col(f"`{c}`") for c in dict.fromkeys([doc_id, source, text])])
    out = with_copies(rows, text, doc_id, source, **how)
    many = out.withColumn("ink_copy", F.explode(F.when(F.col("ink_copies") > 0, F.sequence(F.lit(1), F.col("ink_copies").cast("int")))))
    return many.select("ink_row.*")


_PARTS = """
WITH per AS (SELECT source, count(*) AS n, coalesce(sum(length(text)), 0) AS t FROM documents GROUP BY source),
shares AS (SELECT source, n, t, pow(CAST(t AS DOUBLE), {temper}) AS w FROM per),
totals AS (SELECT sum(t) AS all_t, sum(w) AS all_w, max(CASE WHEN w > 0 THEN t / w END) AS most FROM shares WHERE t > 0),
due AS (SELECT source, n, CASE WHEN t = 0 THEN 1000000 WHEN w <= 0 THEN 0 ELSE CAST(round({size} / t * 1000000) AS BIGINT) END AS d FROM shares, totals),
rated AS (SELECT doc_id, documents.source, d // 1000000 AS whole, d % 1000000 / 1000000.0::DOUBLE AS p,
  (CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents JOIN due ON documents.source IS NOT DISTINCT FROM due.source),
placed AS (SELECT doc_id, whole, p, row_number() OVER (ORDER BY CASE WHEN p > 0 THEN u / (1 - u) * ((1 - p) / p) END NULLS LAST, doc_id NULLS FIRST, source NULLS FIRST) AS r FROM rated),
size AS (SELECT (sum(n * (d % 1000000)) + 500000) // 1000000 AS take FROM due)
"""
SQL = (
    _PARTS.format(temper=TEMPER, seed=SEED, size="1.0 * all_t * w / all_w")
    + """SELECT doc_id, CAST(whole + CASE WHEN p > 0 AND r <= take THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed, size
WHERE whole + CASE WHEN p > 0 AND r <= take THEN 1 ELSE 0 END > 0"""
)
