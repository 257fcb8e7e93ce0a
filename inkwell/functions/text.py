"""Column expressions for text: everything runs in the JVM but slugify, which needs Unicode decomposition."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Python's str.split() and str.strip() take for white space, as a Java character class.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
#: The same, one after another.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Where Python's str.splitlines() ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
DESCRIPTION_CHARS = 160
SNIPPET_CHARS = 240
_NOT_SLUG = re.compile(r"[^a-z0-9]+")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    """A query's terms, repeated ones as often as they stand in it."""
    return re.findall("[a-z0-9]+", query.lower())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """text without white space at its ends, in time that grows with its length."""
    return F.btrim(text, F.lit(WHITE))


def collapse(text: Column) -> Column:
    """One line: each run of white space becomes a space, at the ends none."""
    return F.trim(F.regexp_replace(text, rf"{SPACES}+", " "))


def newlines(text: Column) -> Column:
    """CRLF and CR as LF, as text files are read."""
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    """Lines without their ends; after a last line end there is no further line."""
    return let(F.split(text, LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def blank(text: Column) -> Column:
    """Null instead of an empty text."""
    return F.nullif(text, F.lit(""))


def description(body: Column) -> Column:
    """The first paragraph that isn't a heading or an image, on one line and of bounded length; else an empty text."""
    paragraphs = F.transform(F.split(body, "\n\n", -1), lambda p: F.ltrim(p, F.lit(WHITE)))
    prose = collapse(F.get(F.filter(paragraphs, lambda p: (p != "") & ~p.startswith("#") & ~p.startswith("![")), F.lit(0)))
    cut = lambda x: F.concat(F.rtrim(F.substring(x, 1, DESCRIPTION_CHARS - 1), F.lit(WHITE)), F.lit("…"))
    return F.coalesce(let(prose, lambda x: F.when(F.char_length(x) > DESCRIPTION_CHARS, cut(x)).otherwise(x)), F.lit(""))


def snippet(body: Column, terms: list[str]) -> Column:
    """The first line that has any of the terms in it, else the whole body; stripped, then cut."""
    some = "|".join(dict.fromkeys(terms))  # letters and digits alone
    line = F.get(F.filter(F.split(body, "\n", -1), lambda x: F.lower(x).rlike(some)), F.lit(0))
    return F.substring(strip(F.coalesce(line, body)), 1, SNIPPET_CHARS)


def recency_day(published: Column) -> Column:
    """The date that a text begins with, in any of the ISO forms; null where there is none.

    Calendar dates with and without dashes and week dates with and without
    dashes and day; year 0 and days that don't exist are no dates.
    """
    return let(F.substring(strip(published), 1, 10), _day)


def _day(text: Column) -> Column:
    year, week = F.regexp_extract(text, r"\A(?!0000)([0-9]{4})-?W([0-9]{2})", 1), F.regexp_extract(text, r"\A(?!0000)([0-9]{4})-?W([0-9]{2})", 2)
    day = F.regexp_extract(text, r"\A(?:[0-9]{4}-W[0-9]{2}-([1-7])|[0-9]{4}W[0-9]{2}([1-7]))\z", 0)
    number = F.when(day == "", 1).otherwise(F.substring(day, -1, 1).try_cast("int"))
    fourth = F.try_to_date(F.concat(year, F.lit("-01-04")), "yyyy-MM-dd")
    of_week = F.date_add(fourth, (week.try_cast("int") - 1) * 7 + number - 1 - F.weekday(fourth))
    named = week.try_cast("int")
    of_week = F.when((F.extract(F.lit("YEAROFWEEK"), of_week) == year.try_cast("int")) & (named >= 1) & (named <= 53), of_week)
    return (
        F.when(text.rlike(r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))
        .when(text.rlike(r"\A(?!0000)[0-9]{8}(..)?\z"), F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))
        .when(text.rlike(r"\A(?!0000)([0-9]{4}-W[0-9]{2}(-[1-7])?|[0-9]{4}W[0-9]{2}[1-7]?)\z"), of_week)
    )


def listed(text: Column) -> Column:
    """The items of a comma-separated text, stripped, without blank ones."""
    return F.filter(F.transform(F.split(text, ",", -1), strip), lambda x: x != "")


def joined(items: Column) -> Column:
    return F.array_join(items, ", ")


def slug_of(text: str) -> str:
    """Kebab case in ASCII: accents are dropped, other runs become a dash."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return _NOT_SLUG.sub("-", plain.lower()).strip("-")


@F.pandas_udf(StringType())
def slugify(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield texts.map(slug_of, na_action="ignore")


def either(text: Column, otherwise: str) -> Column:
    """text, or another one where it is null or empty."""
    return F.coalesce(blank(text), F.lit(otherwise))


def digest8(text: Column, digits: int = 8) -> Column:
    return F.substring(F.sha1(text), 1, digits)


def source_slug(url: Column, stem: Column, digits: int = 8) -> Column:
    """A source note's name: its URL's digest, and a readable part without a leading number."""
    name = slugify(F.regexp_replace(stem, r"\A[0-9]{3}-", ""))
    return F.concat_ws("-", digest8(url, digits), either(F.substring(name, 1, 60), "source"))


def topic_slug(topic: Column, project: Column) -> Column:
    """A topic note's name: topic, run and the digest of both."""
    run = either(F.substring(slugify(project), 1, 32), "run")
    return F.concat(either(F.substring(slugify(topic), 1, 40), "topic"), F.lit("--"), run, F.lit("-"), digest8(F.concat(topic, F.lit("\0"), project)))


def report_prefix(project: Column) -> Column:
    """What the names of a run's report notes begin with."""
    return F.concat(either(F.substring(slugify(project), 1, 40), "run"), F.lit("-"), digest8(project))


def path_key(path: Column) -> Column:
    """Orders paths by their components."""
    return F.split(path, "/")
