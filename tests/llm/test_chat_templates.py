from __future__ import annotations

import pytest

from inkwell.llm import chat_templates as C


def shown(source, **values):
    return C.compiled(source)(values)[0]


@pytest.mark.parametrize(("source", "want"), [
    ("a {{- ' b ' -}}  c", "a b c"), ("{# no #}x{#- y -#} z", "xz"), ("{% if 1 < 2 and not false %}y{% else %}n{% endif %}", "y"), ("{% for x in [1, 2] %}{{ loop.index }}{{ x }}{% if loop.last %}!{% endif %}{% endfor %}", "1122!"),
    ("{% for x in [] %}a{% else %}none{% endfor %}", "none"), ("{% set a = 2 * 3 + 1 %}{{ a // 2 }}{{ a % 4 }}", "33"), ("{{ missing }}{{ missing.more }}|{{ missing|default('d') }}", "|d"), ("{{ 'A b'|lower|replace('b', 'c')|upper }}", "A C"),
    ("{{ 'x' if 'a' in 'cat' else 'y' }}{{ 'x' if 3 not in [1] }}", "xx"), ("{% if n is defined and n is not none %}{{ n }}{% elif n is none %}null{% else %}un{% endif %}", "un"), ("{{ \"q'\\n\" ~ 1 }}", "q'\n1"), ("{{ -3 + 1 }}", "-2"), ("{{ '%}' }}", "%}"),
])
def test_the_language(source, want):
    assert shown(source) == want


@pytest.mark.parametrize("source", ["{{ x", "{% if 1 %}", "{% endif %}", "{{ 1 + }}", "{% for in x %}{% endfor %}", "{{ a b }}", "{{ x|nofilter }}", "{{ x is notest }}", "{% import os %}", "{{ f(1) }}", "{{ @ }}"])
def test_wrong_templates(source):
    with pytest.raises(C.TemplateError):
        C.compiled(source)


def test_it_is_a_sandbox():
    class Secret:
        hidden = "leak"

    assert shown("{{ s.hidden }}{{ 'x'.__class__ }}{{ d.__class__ }}{{ d['__init__'] }}", s=Secret(), d={}) == ""
    for source in ("{{ 'a' * 9 }}", "{{ '%99999999d' % 1 }}", "{{ raise_exception('no') }}"):
        with pytest.raises(C.TemplateError):
            shown(source)


def test_constants_are_folded():
    assert C.fold(C.parse("{{ 1 + 2 }}{% if false %}x{% else %}y{{ 'z'|upper }}{% endif %}")) == [("text", "3yZ")]
    assert C.fold(C.parse("{% if x %}{{ 'a' ~ 'b' }}{% endif %}")) == [("if", ("name", "x"), [("text", "ab")], [])]
    C.fold(C.parse("{{ 1 / 0 }}"))  # fails only when rendered


def test_conversations(spark):
    rows = [(1, 1, "assistant", "hi 🎉", "c"), (1, 0, "user", None, "c"), (1, 1, "assistant", "hi 🎉", "c"), (2, None, None, "x" * 100_000, "c"), (None, 0, "user", "lost", "c"), (3, 0, "assistant", "", "c")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, messages string").repartition(3)
    got = {r["conv_id"]: r for r in C.render_conversations(df).collect()}
    assert set(got) == {1, 2, 3} and got[1]["messages"] == 3
    assert got[1]["text"] == "<|im_start|>user\n<|im_end|>\n" + "<|im_start|>assistant\nhi 🎉<|im_end|>\n" * 2
    assert [got[1]["text"][s["begin"] : s["end"]] for s in got[1]["spans"]] == ["hi 🎉<|im_end|>"] * 2
    assert got[2]["text"] == "<|im_start|>\n" + "x" * 100_000 + "<|im_end|>\n" and got[2]["spans"] == []
    prompted = C.render_conversations(df, add_generation_prompt=True).where("conv_id = 3").first()["text"]
    assert prompted.endswith("<|im_end|>\n<|im_start|>assistant\n")
    assert C.render_conversations(df.limit(0)).collect() == []
    with pytest.raises(C.TemplateError):
        C.render_conversations(df, "{% if %}")


@pytest.mark.parametrize("line", ["{% set a = a ~ a %}", "{% set a = a + a %}", "{% set a = a|replace('x', 'xx') %}", "{% set a = [a, a]|join %}"])
def test_values_have_a_bound(monkeypatch, line):
    monkeypatch.setattr(C, "MOST", 1000)
    assert C.compiled("{% set a = 'xx' %}" + line * 8)({})[0] == ""
    with pytest.raises(C.TemplateError):
        C.compiled("{% set a = 'xx' %}" + line * 40)({})
