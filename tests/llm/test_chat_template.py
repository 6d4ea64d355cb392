import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linescan.llm import chat_template as C
from tests.llm.cases import LONG

TALK = [{"role": "user", "content": " hi "}, {"role": "assistant", "content": "yes\n"}, {"role": "user", "content": None}]


def render(source, **names):
    return C.compiled(source)(**names)


@pytest.mark.parametrize(
    "source,want",
    [
        ("a{# note }} #}b", "ab"),
        ("a  {{- 1 + 2 * 3 -}}  b", "a7b"),
        ("{{ 'it\\'s' ~ \"\\n\" }}", "it's\n"),
        ("{{ x }}|{{ x.y }}|{{ x['y'].z }}|{{ none }}", "|||"),
        ("{{ [1, 'a', true] }}", '[1, "a", true]'),
        ("{% if n > 2 %}big{% elif n == 2 %}two{% else %}small{% endif %}", "two"),
        ("{% if false %}no{% else %}yes{% endif %}{% if true %}!{% endif %}", "yes!"),
        ("{{ 'a' if n == 3 else 'b' }}{{ 'c' if n == 2 }}", "bc"),
        ("{% for x in items %}{{ loop.index }}{{ x }}{{ ',' if not loop.last }}{% endfor %}", "1a,2b"),
        ("{% set y = n + 1 %}{{ y }}", "3"),
        ("{{ ' a ' | trim | upper }}{{ items | join('-') }}{{ items | length }}{{ zz | default('q') }}", "Aa-b2q"),
        ("{{ zz is defined }} {{ n is number }} {{ n is not string }} {{ 'a' in items }} {{ 'c' not in items }}", "false true true true true"),
        ("{{ items[0] }}{{ items[-1] }}{{ items[9] }}{{ items | first }}", "aba"),
        ("{{ (1 + 2) * -3 }} {{ 7 // 2 }} {{ 7 % 4 }} {{ not (1 > 2 or 3 < 2) }}", "-9 3 3 true"),
        ("{{ items | tojson }} {{ '%}' }}", '["a", "b"] %}'),
        ("{% for x in none %}a{% endfor %}", ""),
    ],
)
def test_language(source, want):
    assert render(source, n=2, items=["a", "b"])[0] == want


@pytest.mark.parametrize("source", ["{{ 1", "{% if x %}", "{% endif %}", "{{ 1 + }}", "{% for x %}{% endfor %}", "{{ x | run }}", "{% import os %}", "{{ x is odd2 }}", "{{ a b }}", "{% else %}", "{{ x() }}", "{{ lambda }} {{ 1 ! }}", "{% generation %}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}"])
def test_wrong_templates(source):
    with pytest.raises(C.TemplateError):
        C.compiled(source)


def test_nothing_of_python_can_be_reached():
    for source in ("{{ x.__class__ }}", "{{ ''.__class__.__mro__ }}", "{{ x['__init__'] }}", "{{ x.append }}", "{{ loop }}"):
        assert render(source, x=[])[0] == ""
    with pytest.raises(C.TemplateError):
        render("{{ 'a' * 1000000000 }}")
    with pytest.raises(C.TemplateError):
        render("{% for a in x %}{% for b in x %}{% for c in x %}{% for d in x %}{{ 1 + a }}{% endfor %}{% endfor %}{% endfor %}{% endfor %}", x=[1] * 100)


def test_constants_are_folded():
    assert C.parse("a{{ 1 + 2 }}b{% if 1 == 1 %}c{% endif %}{{ 'x' | upper }}") == [("text", "a3bcX")]
    assert C.parse("{% if false %}{{ zz.y }}{% endif %}") == []
    assert C.parse("{% if x %}a{% elif true %}b{% else %}c{% endif %}") == C.parse("{% if x %}a{% else %}b{% endif %}".replace("else", "elif true"))
    assert C.parse("{{ 1 // 0 }}")[0][0] == "out"
    with pytest.raises(C.TemplateError):
        render("{{ 1 // 0 }}")


def test_generation_markers():
    text, spans = render(C.TEMPLATE, messages=TALK)
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [text[a:b] for a, b in spans] == ["yes<|im_end|>"]
    assert render("{% generation %}{% endgeneration %}") == ("", [])
    with pytest.raises(C.TemplateError):
        render("{% generation %}{% generation %}a{% endgeneration %}{% endgeneration %}")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text(max_size=20)), max_size=6))
def test_default_template_equals_plain_python(talk):
    text, spans, want, marks = *render(C.TEMPLATE, messages=[{"role": r, "content": c} for r, c in talk]), "", []
    for r, c in talk:
        want += f"<|im_start|>{r}\n"
        start = len(want)
        want += c.strip(C.SPACE) + "<|im_end|>"
        if r == "assistant":
            marks.append((start, len(want)))
        want += "\n"
    assert (text, spans) == (want, marks)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, rows string, error int")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "n"), (None, 1, "assistant", ""), (3, 0, "user", LONG), (4, 5, "user", "x"), (4, 5, "user", "x"), (4, None, "assistant", "first"), (5, 1, "b", "y"), (5, 1, "a", "z")]
    got = {r.conv_id: r for r in C.formatted(frame(spark, rows)).collect()}
    assert got[1].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n" and got[1].generated == "51-62"
    assert got[2].text == "<|im_start|>\n<|im_end|>\n" and got[None].n_turns == 2 and len(got[3].text) > len(LONG)
    assert got[4].n_turns == 3 and got[4].text.startswith("<|im_start|>assistant\nfirst") and got[4].text.count("x<|im_end|>") == 2
    assert got[5].text.index("z") < got[5].text.index("y")
    assert C.formatted(frame(spark, [])).count() == 0


def test_failing_conversations(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", None)]
    got = {r.conv_id: (r.text, r.error) for r in C.formatted(frame(spark, rows), "{% for m in messages %}{{ m.content + '!' }}{% endfor %}").collect()}
    assert got[1] == ("a!", None) and got[2][0] is None and got[2][1]
    with pytest.raises(C.TemplateError):
        C.formatted(frame(spark, rows), "{{")
    assert C.formatted(frame(spark, rows), "{{ system }}", system="S").first().text == "S"
