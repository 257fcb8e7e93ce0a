from __future__ import annotations

import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text as T

ODD = ["", " ", "\t a \x0b b\x1c", "\xa0x\xa0", "a b　", "line\r\nnext\rlast\n", "\x1fa\x85b c", "### H\n\nText  of\n it", "![x](y)\n\n\n\nprose " + "w " * 200, "Héllo Wörld ﬁn", "İstanbul", "a,b , ,c", "---\nx: 1\n---\n", "\n\n", "x" * 500]


def table(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")


def got(spark, texts, expression):
    return [r["v"] for r in table(spark, texts).select("k", expression(F.col("t")).alias("v")).orderBy("k").collect()]


def test_white_space_is_python_s(spark):
    texts = ODD + [f"{chr(c)}a{chr(c)}b{chr(c)}" for c in range(1, 0x3100) if chr(c).isspace()]
    assert got(spark, texts, T.collapse) == [" ".join(t.split()) for t in texts]
    assert got(spark, texts, T.strip) == [t.strip() for t in texts]
    assert got(spark, texts, T.lines) == [t.splitlines() for t in texts]


def test_tokens(spark):
    texts = [*ODD, "café au LAIT 42x"]
    assert got(spark, texts, T.tokens) == [re.findall("[a-z0-9]+", t.lower()) for t in texts]


def described(body):
    for p in body.split("\n\n"):
        p = " ".join(p.split())
        if p and not p.startswith(("#", "![")):
            return p if len(p) <= 160 else p[:159].rstrip() + "…"
    return ""


def test_description(spark):
    assert got(spark, ODD, T.description) == [described(t) for t in ODD]


def test_snippet(spark):
    texts = ["no\n  The cat sat  \ncat", "nothing here " * 50, "", "\n\n", "a CATalogue"]

    def want(t):
        return next((x for x in t.split("\n") if "cat" in x.lower()), t).strip()[:240]

    assert got(spark, texts, lambda c: T.snippet(c, ["cat", "cat"])) == [want(t) for t in texts]


def test_recency_day_accepts_what_python_does(spark):
    texts = ["2026-06-30T12:00:00", " 2024-01-01 ", "20240229", "20240229xx", "2023-02-29", "2026-6-3", "2026", "0000-01-01", "2026-W27-1", "2026W271", "2026-W27", "2026W27", "2026-W54-1", "2020-W53-7", "2021-W53-1", "9999-12-31", "", "n/a", "2026-07-05x", "0001-01-01", "2026-W00-1"]

    def want(t):
        try:
            return dt.date.fromisoformat(t.strip()[:10])
        except ValueError:
            return None

    assert got(spark, texts, T.recency_day) == [want(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_slugs_are_safe_and_stay_as_they_are(text):
    slug = T.slug_of(text)
    assert re.fullmatch(r"([a-z0-9]+(-[a-z0-9]+)*)?", slug)
    assert T.slug_of(slug) == slug


def test_slugs_and_names(spark):
    assert got(spark, ["Hello, World!", "Crème Brûlée", "!!!", "ﬁn", None], T.slugify) == ["hello-world", "creme-brulee", "", "fin", None]
    df = spark.createDataFrame([("https://a.test/x", "001-Some Title", "", "!!!")], "u string, s string, p string, t string")
    r = df.select(T.source_slug(F.col("u"), F.col("s")).alias("a"), T.topic_slug(F.col("t"), F.col("p")).alias("b"), T.source_slug(F.col("u"), F.col("t")).alias("c")).first()
    assert re.fullmatch("[0-9a-f]{8}-some-title", r["a"]) and re.fullmatch("topic--run-[0-9a-f]{8}", r["b"]) and r["c"].endswith("-source")


def test_lists(spark):
    assert got(spark, ["a,b , ,c", "", " x "], T.listed) == [["a", "b", "c"], [], ["x"]]


def test_a_million_spaces_inside_a_text_take_no_time(spark):
    """Each gate, and what else strips, over a text that a careless pattern would take hours for."""
    import time

    from inkwell.operators import merge
    from inkwell.sources import notes as N

    long = "a" + " " * 1_000_000 + "b"
    rows = spark.createDataFrame([(1, "x.md", {"url": "u"}, long)], "seq int, name string, meta map<string, string>, body string")
    text = spark.createDataFrame([("---\nk: " + long + "\n---\n" + long,)], "text string")
    for df in (
        merge.gate_materials(rows).select("reason"), merge.gate_notes(rows).select("reason"), rows.select(F.length(T.strip(F.col("body")))), rows.select(T.description(F.col("body"))),
        rows.select(T.snippet(F.col("body"), ["b"])), rows.select(T.listed(F.col("body"))), N.parsed(text).select(F.length("body"), F.col("meta")["k"]),
    ):
        df.collect()  # compiles
        began = time.perf_counter()
        df.collect()
        assert time.perf_counter() - began < 1.5


def test_let(spark):
    assert spark.range(1).select(T.let(F.lit(3), lambda x: x * x).alias("v")).first()["v"] == 9
