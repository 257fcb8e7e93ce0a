"""A document-knowledge engine on Spark DataFrames.

    from inkwell import KnowledgeBase, parse_note, slugify

`parse_note` and `slugify` are for single texts; `inkwell.sources.notes.parsed`
and `inkwell.functions.text.slugify` do the same to columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from inkwell.functions.text import slug_of as slugify

__version__ = "0.2.0"
__all__ = ["IngestReport", "KnowledgeBase", "Note", "SearchHit", "parse_note", "slugify"]
_FRONT = re.compile(r"\A---(?=\n)(?P<block>.*?)\n---(?:\n|\Z)", re.S)


@dataclass(frozen=True)
class Note:
    """A text and the metadata in front of it."""

    meta: dict[str, str] = field(default_factory=dict)
    body: str = ""

    @property
    def title(self) -> str:
        return self.meta.get("title", "")

    @property
    def slug(self) -> str:
        """The slug in the metadata, else one of the title."""
        return self.meta.get("slug", "") or slugify(self.title)


def parse_note(text: str) -> Note:
    """A note of a Markdown text; without a closed block in front all of it is the body."""
    front = _FRONT.match(text)
    if front is None:
        return Note({}, text)
    pairs = (line.split(":", 1) for line in front["block"].splitlines() if ":" in line)
    return Note({k.strip(): v.strip() for k, v in pairs}, text[front.end() :])


def __getattr__(name: str) -> Any:
    # what needs Spark is only loaded when it is asked for
    if name in ("IngestReport", "KnowledgeBase", "SearchHit"):
        from inkwell import base

        return getattr(base, name)
    raise AttributeError(name)
