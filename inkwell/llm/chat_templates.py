"""Chat formatting by compiled templates.

A template is parsed into a syntax tree, constant parts of the tree are folded,
and Python closures are made of it that render a conversation into text and
record which spans a model is to generate.  The language:

    {{ e }}   {% if e %} {% elif e %} {% else %} {% endif %}   {# comment #}
    {% for x in e %} {% else %} {% endfor %}   {% set x = e %}
    {% generation %} {% endgeneration %}

with `-` inside a delimiter taking the white space next to it.  Expressions have
literals, lists, names, a.b, a[b], + - * / // % ~, comparisons, in, not in, and,
or, not, a if b else c, a|filter(...), a is [not] test.  In a loop, `loop` has
index, index0, first, last and length.

It is a sandbox: names are the given values and what the template sets, a.b and
a[b] read entries of dicts and lists only, never attributes, and there are no
calls but the filters and raise_exception(message).  A text or list that would
have more than MOST characters or entries is an error.  What is missing is
undefined: it renders as nothing and is false.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' ~ m.role ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.content ~ '<|im_end|>' }}{% endgeneration %}"
    "{% else %}{{ m.content ~ '<|im_end|>' }}{% endif %}{{ '\\n' }}{% endfor %}"
    "{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
)


class TemplateError(ValueError):
    pass


class Undefined:
    def __str__(self) -> str:
        return ""

    def __bool__(self) -> bool:
        return False

    def __iter__(self) -> Iterator:
        return iter(())

    def __len__(self) -> int:
        return 0


UNDEFINED = Undefined()
#: Characters of a text, or entries of a list, that a template may put together; beyond that it is an error, never cut.
MOST = 1 << 27
Node = tuple  # (kind, ...)
_TAG = re.compile(r"\{%-?|\{\{-?|\{#")
_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*/%~<>|.,:()\[\]=]))""", re.S
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"', "0": "\0"}
_WORDS = {"and", "or", "not", "in", "is", "if", "else", "true", "false", "none", "True", "False", "None"}
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


def text_of(v: Any) -> str:
    return "" if v is UNDEFINED else v if isinstance(v, str) else str(v)


def entry(v: Any, key: Any) -> Any:
    """An entry of a dict or a list; nothing else can be looked into."""
    if isinstance(v, dict):
        return v.get(key, UNDEFINED) if isinstance(key, str | int) else UNDEFINED
    if isinstance(v, list | str) and isinstance(key, int) and not isinstance(key, bool):
        return v[key] if -len(v) <= key < len(v) else UNDEFINED
    return UNDEFINED


def _ends(v: Any, k: int) -> Any:
    return entry(v if isinstance(v, list | str) else list(v), k)


FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda v: text_of(v).strip(), "upper": lambda v: text_of(v).upper(), "lower": lambda v: text_of(v).lower(),
    "length": lambda v: len(v), "first": lambda v: _ends(v, 0), "last": lambda v: _ends(v, -1),
    "default": lambda v, d="": d if v is UNDEFINED else v, "join": lambda v, by="": _joined(v, by),
    "replace": lambda v, a, b: _replaced(text_of(v), a, b), "string": text_of, "int": lambda v: int(v),
    "capitalize": lambda v: text_of(v).capitalize(), "title": lambda v: text_of(v).title(), "list": lambda v: list(v), "reverse": lambda v: v[::-1],
}
TESTS: dict[str, Callable[[Any], bool]] = {
    "defined": lambda v: v is not UNDEFINED, "undefined": lambda v: v is UNDEFINED, "none": lambda v: v is None, "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool), "even": lambda v: v % 2 == 0, "odd": lambda v: v % 2 == 1,
}


def _bounded(size: int) -> None:
    if size > MOST:
        raise TemplateError(f"a value of more than {MOST} characters or entries")


def _added(a: Any, b: Any) -> Any:
    if isinstance(a, str | list) and isinstance(b, str | list):
        _bounded(len(a) + len(b))
    return a + b


def _joined(v: Any, by: str) -> str:
    texts = [text_of(x) for x in v]
    _bounded(sum(map(len, texts)) + len(by) * max(0, len(texts) - 1))
    return by.join(texts)


def _replaced(v: str, a: str, b: str) -> str:
    _bounded(len(v) + v.count(a) * max(0, len(b) - len(a)))
    return v.replace(a, b)


def _times(a: Any, b: Any) -> Any:
    if not isinstance(a, int | float) or not isinstance(b, int | float) or isinstance(a * b, int) and abs(a * b) >> 256:
        raise TemplateError("* is for numbers")
    return a * b


def _modulo(a: Any, b: Any) -> Any:
    if isinstance(a, str):
        raise TemplateError("% is for numbers")
    return a % b


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: _added(a, b), "-": lambda a, b: a - b, "*": _times, "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": _modulo,
    "~": lambda a, b: _added(text_of(a), text_of(b)), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
}
_LEVELS = (("==", "!=", "<", ">", "<=", ">=", "in", "not in"), ("+", "-", "~"), ("*", "/", "//", "%"))


class _Expression:
    """Reads one expression's tokens into a tree."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup or "", m.group(m.lastgroup or 0)))
            at = m.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in texts

    def take(self, *texts: str) -> str | None:
        if self.peek(*texts):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"expected {text!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self) -> Node:
        value = self.either()
        if self.take("if"):
            when = self.either()
            other = self.whole() if self.take("else") else ("const", UNDEFINED)
            value = ("choose", when, value, other)
        return value

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> Node:
        return ("not", self.negated()) if self.take("not") else self.level(0)

    def level(self, k: int) -> Node:
        if k == len(_LEVELS):
            return self.signed()
        left = self.level(k + 1)
        while True:
            if k == 0 and self.peek("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                op = "not in"
            else:
                op = self.take(*_LEVELS[k]) or ""
            if not op:
                return left
            left = ("binary", op, left, self.level(k + 1))

    def signed(self) -> Node:
        return ("binary", "-", ("const", 0), self.signed()) if self.take("-") else self.suffixed()

    def suffixed(self) -> Node:
        value = self.atom()
        while True:
            if self.take("."):
                value = ("entry", value, ("const", self.name()))
            elif self.take("["):
                value = ("entry", value, self.whole())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                value = ("filter", name, value, self.arguments())
            elif self.take("is"):
                no, name = self.take("not"), self.name()
                if name not in TESTS:
                    raise TemplateError(f"no test {name!r}")
                value = ("test", name, value)
                value = ("not", value) if no else value
            else:
                return value

    def arguments(self) -> list[Node]:
        out: list[Node] = []
        if self.take("("):
            while not self.take(")"):
                out.append(self.whole())
                if not self.peek(")"):
                    self.need(",")
        return out

    def atom(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("const", float(text) if "." in text else int(text))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], "\\" + m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            if text in _CONSTANTS:
                return ("const", _CONSTANTS[text])
            if text == "raise_exception":
                return ("raise", self.arguments())
            if text in _WORDS:
                raise TemplateError(f"unexpected {text!r}")
            return ("name", text)
        if text == "(":
            value = self.whole()
            self.need(")")
            return value
        if text == "[":
            items = []
            while not self.take("]"):
                items.append(self.whole())
                if not self.peek("]"):
                    self.need(",")
            return ("list", items)
        raise TemplateError(f"unexpected {text!r}")


def _pieces(source: str) -> list[tuple[str, str]]:
    """("text" | "print" | "do", content) in order, without comments, white space taken where asked."""
    out: list[tuple[str, str]] = []
    at, strip = 0, False
    while at < len(source):
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        if not m:
            out.append(("text", text))
            break
        opening = m.group()
        closing = {"{%": "%}", "{{": "}}", "{#": "#}"}[opening[:2]]
        comment = opening == "{#"
        taken = source[m.end() : m.end() + 1] == "-" if comment else opening.endswith("-")
        out.append(("text", text.rstrip() if taken else text))
        end = m.end()
        while True:  # not inside a string
            found = re.compile(re.escape(closing) if comment else rf"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|{re.escape(closing)}""", re.S).search(source, end)
            if not found:
                raise TemplateError(f"{opening!r} without {closing!r}")
            end = found.end()
            if found.group() == closing:
                break
        content = source[m.end() : found.start()]
        strip = content.endswith("-")
        content = content[:-1] if strip else content
        if not comment:
            out.append(("print" if opening[:2] == "{{" else "do", content.strip()))
        at = end
    return [p for p in out if p != ("text", "")]


class _Blocks:
    """Reads statements into a tree."""

    def __init__(self, source: str) -> None:
        self.pieces, self.at = _pieces(source), 0

    def until(self, *ends: str) -> tuple[list[Node], str]:
        body: list[Node] = []
        while self.at < len(self.pieces):
            kind, content = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                body.append(("text", content))
                continue
            if kind == "print":
                e = _Expression(content)
                body.append(("print", e.whole()))
                e.done()
                continue
            word = re.match(r"\w*", content).group()  # type: ignore[union-attr]
            if word in ends:
                return body, content
            body.append(self.statement(word, content[len(word) :]))
        if ends:
            raise TemplateError(f"expected {' or '.join(ends)}")
        return body, ""

    def statement(self, word: str, rest: str) -> Node:
        e = _Expression(rest)
        if word == "if":
            when = e.whole()
            e.done()
            body, end = self.until("elif", "else", "endif")
            other: list[Node] = []
            if end.startswith("elif"):
                other = [self.statement("if", end[4:])]
            elif end.startswith("else"):
                other, _ = self.until("endif")
            return ("if", when, body, other)
        if word == "for":
            name = e.name()
            e.need("in")
            over = e.whole()
            e.done()
            body, end = self.until("else", "endfor")
            other = self.until("endfor")[0] if end.startswith("else") else []
            return ("for", name, over, body, other)
        if word == "set":
            name = e.name()
            e.need("=")
            value = e.whole()
            e.done()
            return ("set", name, value)
        if word == "generation":
            e.done()
            return ("generation", self.until("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")


def parse(source: str) -> list[Node]:
    return _Blocks(source).until()[0]


def fold(node: Any) -> Any:
    """The tree with constant expressions worked out, constant prints made text, and dead branches left out."""
    if isinstance(node, list):
        out: list[Node] = []
        folded = (fold(x) for x in node)
        for x in (y for x in folded for y in (x[1] if isinstance(x, tuple) and x[0] == "block" else [x])):
            if isinstance(x, tuple) and x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
        return out
    if not isinstance(node, tuple):
        return node
    node = tuple(fold(x) if isinstance(x, tuple | list) else x for x in node)
    kind = node[0]
    constant = lambda *xs: all(isinstance(x, tuple) and x[0] == "const" for x in xs)
    try:
        if kind == "binary" and constant(node[2], node[3]):
            return ("const", BINARY[node[1]](node[2][1], node[3][1]))
        if kind == "not" and constant(node[1]):
            return ("const", not node[1][1])
        if kind in ("and", "or") and constant(node[1]):
            return node[2] if bool(node[1][1]) == (kind == "and") else node[1]
        if kind == "choose" and constant(node[1]):
            return node[2] if node[1][1] else node[3]
        if kind == "entry" and constant(node[1], node[2]):
            return ("const", entry(node[1][1], node[2][1]))
        if kind == "filter" and constant(node[2], *node[3]):
            return ("const", FILTERS[node[1]](node[2][1], *(a[1] for a in node[3])))
        if kind == "test" and constant(node[2]):
            return ("const", TESTS[node[1]](node[2][1]))
        if kind == "list" and constant(*node[1]):
            return ("const", [x[1] for x in node[1]])
    except Exception:  # it fails when, and if, it is rendered
        return node
    if kind == "print" and constant(node[1]):
        return ("text", text_of(node[1][1]))
    if kind == "if" and constant(node[1]):
        return ("block", node[2] if node[1][1] else node[3])
    return node


class Rendering:
    """What closures write to: text so far, its length, and generated spans."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


Evaluate = Callable[[dict[str, Any]], Any]
Run = Callable[[dict[str, Any], Rendering], None]


def expression(node: Node) -> Evaluate:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name, UNDEFINED)
    if kind == "entry":
        of, key = expression(node[1]), expression(node[2])
        return lambda env: entry(of(env), key(env))
    if kind == "binary":
        f, left, right = BINARY[node[1]], expression(node[2]), expression(node[3])
        return lambda env: f(left(env), right(env))
    if kind == "not":
        inner = expression(node[1])
        return lambda env: not inner(env)
    if kind == "and":
        left, right = expression(node[1]), expression(node[2])
        return lambda env: left(env) and right(env)
    if kind == "or":
        left, right = expression(node[1]), expression(node[2])
        return lambda env: left(env) or right(env)
    if kind == "choose":
        when, yes, no = (expression(x) for x in node[1:])
        return lambda env: yes(env) if when(env) else no(env)
    if kind == "filter":
        f, inner, args = FILTERS[node[1]], expression(node[2]), [expression(a) for a in node[3]]
        return lambda env: f(inner(env), *(a(env) for a in args))
    if kind == "test":
        f, inner = TESTS[node[1]], expression(node[2])
        return lambda env: f(inner(env))
    if kind == "list":
        items = [expression(x) for x in node[1]]
        return lambda env: [x(env) for x in items]
    args = [expression(a) for a in node[1]]

    def fail(env: dict[str, Any]) -> Any:
        raise TemplateError(" ".join(text_of(a(env)) for a in args))

    return fail


def statements(body: list[Node]) -> Run:
    runs = [statement(x) for x in body]
    if len(runs) == 1:
        return runs[0]

    def run(env: dict[str, Any], out: Rendering) -> None:
        for r in runs:
            r(env, out)

    return run


def statement(node: Node) -> Run:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.write(text)
    if kind == "print":
        value = expression(node[1])
        return lambda env, out: out.write(text_of(value(env)))
    if kind == "set":
        name, value = node[1], expression(node[2])

        def assign(env: dict[str, Any], out: Rendering) -> None:
            env[name] = value(env)

        return assign
    if kind == "if":
        when, yes, no = expression(node[1]), statements(node[2]), statements(node[3])
        return lambda env, out: yes(env, out) if when(env) else no(env, out)
    if kind == "generation":
        inner = statements(node[1])

        def mark(env: dict[str, Any], out: Rendering) -> None:
            begin = out.length
            inner(env, out)
            out.spans.append((begin, out.length))

        return mark
    name, over, inner, other = node[1], expression(node[2]), statements(node[3]), statements(node[4])

    def loop(env: dict[str, Any], out: Rendering) -> None:
        items = list(over(env))
        if not items:
            other(env, out)
        for k, x in enumerate(items):
            inner({**env, name: x, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(items) - 1, "length": len(items)}}, out)

    return loop


def compiled(source: str) -> Callable[[dict[str, Any]], tuple[str, list[tuple[int, int]]]]:
    """A function from values to (text, generated spans as (begin, end) in characters)."""
    run = statements(fold(parse(source)))

    def render(values: dict[str, Any]) -> tuple[str, list[tuple[int, int]]]:
        out = Rendering()
        run(dict(values), out)
        return "".join(out.parts), out.spans

    return render


def render_conversations(turns: DataFrame, template: str = CHATML, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **values: Any) -> DataFrame:
    """(conv_id, messages, text, spans) of every conversation; spans are (begin, end) in characters.

    Messages are ordered by turn, then role and content, a null turn first.  A
    null role or content is an empty one, repeated rows are repeated messages,
    and rows without conv_id belong to no conversation.  The template is
    compiled on the driver first, so a wrong one fails before any job.  An empty
    table gives an empty result; other columns aren't looked at.
    """
    compiled(template)
    rows = turns.select(
        F.col(f"`{conv_id}`").cast("bigint").alias("c"),
        F.struct(F.col(f"`{turn}`").cast("bigint").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("content")).alias("m"),
    ).where("c is not null")
    grouped = rows.groupBy("c").agg(F.array_sort(F.collect_list("m")).alias("ms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                messages = part.column(1).to_pylist()
                done = [render({**values, "messages": [{"role": m["role"], "content": m["content"]} for m in ms]}) for ms in messages]
                spans = pa.array([[{"begin": x, "end": y} for x, y in s] for _, s in done], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
                yield pa.record_batch([part.column(0), pa.array([len(m) for m in messages], pa.int32()), pa.array([t for t, _ in done]), spans], names=["conv_id", "messages", "text", "spans"])

    return grouped.mapInArrow(run, "conv_id bigint, messages int, text string, spans array<struct<begin: int, end: int>>")


#: For CHATML; spans as "begin-end" joined by commas, as the query gives them.
SQL = """
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
parts AS (SELECT *, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS body FROM m),
placed AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS ends FROM parts)
SELECT conv_id, CAST(count(*) AS INTEGER) AS messages, string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
  coalesce(string_agg(CAST(ends - 1 - length(body) AS VARCHAR) || '-' || CAST(ends - 1 AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS spans
FROM placed GROUP BY conv_id
"""
