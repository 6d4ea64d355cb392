"""Chat formatting by a template compiler.

Templates are written in a small, closed language: text, {{ expression }}, {% for x in e %}, {% if e %}, {% elif e %},
{% else %}, {% set x = e %}, {% generation %} ... {% endgeneration %} and {# comments #}; a '-' at a tag's edge
drops the white space there. Expressions have literals, lists, names, .key and [key], the operators
or and not in == != < <= > >= + - * // % ~, x if y else z, tests (is defined, is none, is string, ...) and filters.
Only dictionaries, lists, strings and numbers can be reached: no Python attribute, call or import exists in the
language. A template is parsed to a syntax tree, whose constant parts are folded, and compiled to closures that
render messages and note which characters are the assistant's to generate.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import read

SPACE = " \t\n\r\f\v"
STEPS = 5_000_000  # loop rounds and nodes of one rendering, at most
DEPTH = 50


class TemplateError(ValueError):
    """The template is wrong, or can't render these messages."""


class _Missing:
    def __bool__(self) -> bool:
        return False


MISSING = _Missing()

# Syntax tree: tuples of a kind and its parts. Expressions: const, name, get, list, not, neg, and, or, if, op, test,
# filter. Statements: text, out, for, if, set, generation.


@dataclass
class _State:
    names: list[dict[str, Any]]
    out: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    inside: bool = False
    steps: int = 0

    def write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def step(self) -> None:
        self.steps += 1
        if self.steps > STEPS:
            raise TemplateError("too many steps")


_TAG = re.compile(r"(\{\{-?|\{%-?|\{#-?)")
_WORD = re.compile(
    r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<op>==|!=|<=|>=|//|[-+*%~<>()\[\].,|=:]))",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _words(code: str) -> list[tuple[str, str]]:
    found, at = [], 0
    while code[at:].strip():
        m = _WORD.match(code, at)
        if not m:
            raise TemplateError(f"can't read {code[at:].strip()[:20]!r}")
        found.append((m.lastgroup or "", m[m.lastgroup or 0]))
        at = m.end()
    return found


def _split(source: str) -> list[tuple[str, Any]]:
    """Text and tags, in order."""
    found: list[tuple[str, Any]] = []
    at, drop = 0, False
    while True:
        m = _TAG.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if drop:
            text = text.lstrip(SPACE)
        if m and m[0].endswith("-"):
            text = text.rstrip(SPACE)
        if text:
            found.append(("text", text))
        if not m:
            return found
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        end, quoted = m.end(), None
        while end < len(source) and (quoted or not source.startswith(close, end)):
            c = source[end]
            if quoted:
                if c == "\\":
                    end += 1
                elif c == quoted:
                    quoted = None
            elif c in "'\"" and close != "#}":
                quoted = c
            end += 1
        if end >= len(source):
            raise TemplateError(f"{m[0]} isn't closed")
        code = source[m.end() : end]
        drop = code.endswith("-")
        if close != "#}":
            found.append((m[0][:2], _words(code[:-1] if drop else code)))
        at = end + 2


class _Parser:
    def __init__(self, words: list[tuple[str, str]]):
        self.words, self.at, self.depth = words, 0, 0

    def peek(self) -> str | None:
        if self.at < len(self.words) and self.words[self.at][0] != "string":
            return self.words[self.at][1]
        return None

    def take(self, *wanted: str) -> str | None:
        if (word := self.peek()) in wanted:
            self.at += 1
            return word
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def name(self) -> str:
        if self.at < len(self.words) and self.words[self.at][0] == "name":
            self.at += 1
            return self.words[self.at - 1][1]
        raise TemplateError("a name is missing")

    def end(self) -> None:
        if self.at < len(self.words):
            raise TemplateError(f"{self.words[self.at][1]!r} is too much")

    def expression(self) -> tuple:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deeply")
        value = self.either()
        if self.take("if"):
            test = self.either()
            value = ("if", test, value, self.expression() if self.take("else") else ("const", ""))
        self.depth -= 1
        return _folded(value)

    def either(self) -> tuple:
        value = self.both()
        while self.take("or"):
            value = _folded(("or", value, self.both()))
        return value

    def both(self) -> tuple:
        value = self.negated()
        while self.take("and"):
            value = _folded(("and", value, self.negated()))
        return value

    def negated(self) -> tuple:
        turn = 0
        while self.take("not"):
            turn += 1
        value = self.compared()
        for _ in range(turn):
            value = _folded(("not", value))
        return value

    def compared(self) -> tuple:
        value = self.sum()
        while True:
            if op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                value = _folded(("op", op, value, self.sum()))
            elif self.peek() == "not" and self.at + 1 < len(self.words) and self.words[self.at + 1][1] == "in":
                self.at += 2
                value = _folded(("not", ("op", "in", value, self.sum())))
            elif self.take("is"):
                turn = self.take("not")
                value = ("test", self.name(), value)
                if value[1] not in _TESTS:
                    raise TemplateError(f"no test {value[1]!r}")
                value = _folded(("not", value) if turn else value)
            else:
                return value

    def sum(self) -> tuple:
        value = self.product()
        while op := self.take("+", "-", "~"):
            value = _folded(("op", op, value, self.product()))
        return value

    def product(self) -> tuple:
        value = self.signed()
        while op := self.take("*", "//", "%"):
            value = _folded(("op", op, value, self.signed()))
        return value

    def signed(self) -> tuple:
        if self.take("-"):
            self.depth += 1
            if self.depth > DEPTH:
                raise TemplateError("nested too deeply")
            value = _folded(("neg", self.signed()))
            self.depth -= 1
            return value
        value = self.atom()
        while True:
            if self.take("."):
                value = _folded(("get", value, ("const", self.name())))
            elif self.take("["):
                value = _folded(("get", value, self.expression()))
                self.need("]")
            elif self.take("|"):
                name, given = self.name(), []
                if name not in _FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.take("("):
                    given = self.several(")")
                value = _folded(("filter", name, value, *given))
            else:
                return value

    def several(self, close: str) -> list[tuple]:
        found: list[tuple] = []
        while not self.take(close):
            if found:
                self.need(",")
            found.append(self.expression())
        return found

    def atom(self) -> tuple:
        if self.at >= len(self.words):
            raise TemplateError("an expression is missing")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "number":
            return ("const", float(word) if "." in word else int(word))
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "name":
            known = {"true": True, "false": False, "none": None}
            if word.lower() in known:
                return ("const", known[word.lower()])
            return ("name", word)
        if word == "(":
            value = self.expression()
            self.need(")")
            return value
        if word == "[":
            return _folded(("list", *self.several("]")))
        raise TemplateError(f"{word!r} begins no expression")


def _text(value: Any) -> str:
    if value is None or value is MISSING:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False)
    return str(value)


def _get(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key, MISSING)
    if isinstance(value, (list, str)) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return MISSING


def _operate(op: str, a: Any, b: Any) -> Any:
    try:
        if op == "==":
            return a == b
        if op == "!=":
            return a != b
        if op == "~":
            return _text(a) + _text(b)
        if a is MISSING or b is MISSING:
            return False if op in ("<", "<=", ">", ">=", "in") else MISSING
        if op == "in":
            return isinstance(b, (dict, list, str)) and a in b
        if op == "*" and not (isinstance(a, (int, float)) and isinstance(b, (int, float))):
            raise TemplateError("* takes numbers")
        return {
            "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b,
            "-": lambda: a - b, "*": lambda: a * b, "//": lambda: a // b,
            "%": lambda: a % b if isinstance(a, (int, float)) else _wrong("% takes numbers"),
        }[op]()
    except (TypeError, ZeroDivisionError) as bad:
        raise TemplateError(f"{op}: {bad}") from None


def _wrong(why: str) -> Any:
    raise TemplateError(why)


def _length(value: Any) -> int:
    return len(value) if isinstance(value, (str, list, dict)) else 0


_TESTS: dict[str, Callable[[Any], bool]] = {
    "defined": lambda x: x is not MISSING,
    "undefined": lambda x: x is MISSING,
    "none": lambda x: x is None,
    "string": lambda x: isinstance(x, str),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "mapping": lambda x: isinstance(x, dict),
    "sequence": lambda x: isinstance(x, (list, str)),
    "odd": lambda x: isinstance(x, int) and x % 2 == 1,
    "even": lambda x: isinstance(x, int) and x % 2 == 0,
}
_FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda x: _text(x).strip(SPACE),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "capitalize": lambda x: _text(x).capitalize(),
    "length": _length,
    "string": _text,
    "first": lambda x: _get(x, 0),
    "last": lambda x: _get(x, -1),
    "default": lambda x, other="": other if x is MISSING or x is None else x,
    "join": lambda x, between="": _text(between).join(map(_text, x)) if isinstance(x, list) else _text(x),
    "replace": lambda x, old, new: _text(x).replace(_text(old), _text(new)),
    "tojson": lambda x: json.dumps(None if x is MISSING else x, ensure_ascii=False),
}


def _folded(node: tuple) -> tuple:
    """A constant, where the parts of an expression are constants."""
    kind = node[0]
    parts = [x for x in node[1:] if isinstance(x, tuple)]
    if kind == "and" and node[1][0] == "const":
        return node[2] if node[1][1] else node[1]
    if kind == "or" and node[1][0] == "const":
        return node[1] if node[1][1] else node[2]
    if kind == "if" and node[1][0] == "const":
        return node[2] if node[1][1] else node[3]
    if kind in ("const", "name") or any(x[0] != "const" for x in parts):
        return node
    try:
        return ("const", _expression(node)(_State([{}])))
    except TemplateError:
        return node  # fails when it is rendered, if it is


def _expression(node: tuple) -> Callable[[_State], Any]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda s: value
    if kind == "name":
        name = node[1]

        def look(s: _State) -> Any:
            for names in reversed(s.names):
                if name in names:
                    return names[name]
            return MISSING

        return look
    if kind == "list":
        each = [_expression(x) for x in node[1:]]
        return lambda s: [x(s) for x in each]
    if kind == "filter":
        use, value, given = _FILTERS[node[1]], _expression(node[2]), [_expression(x) for x in node[3:]]

        def apply(s: _State) -> Any:
            try:
                return use(value(s), *(x(s) for x in given))
            except TypeError as bad:
                raise TemplateError(f"{node[1]}: {bad}") from None

        return apply
    if kind == "test":
        check, value = _TESTS[node[1]], _expression(node[2])
        return lambda s: check(value(s))
    if kind == "op":
        op, a, b = node[1], _expression(node[2]), _expression(node[3])
        return lambda s: _operate(op, a(s), b(s))
    parts = [_expression(x) for x in node[1:]]
    if kind == "get":
        return lambda s: _get(parts[0](s), parts[1](s))
    if kind == "not":
        return lambda s: not parts[0](s)
    if kind == "neg":
        return lambda s: _operate("-", 0, parts[0](s))
    if kind == "and":
        return lambda s: parts[0](s) and parts[1](s)
    if kind == "or":
        return lambda s: parts[0](s) or parts[1](s)
    return lambda s: parts[1](s) if parts[0](s) else parts[2](s)


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template, with constants folded and neighbouring text joined."""
    parts, at = _split(source), 0

    def block(ends: tuple[str, ...], depth: int) -> tuple[list[tuple], str, _Parser | None]:
        nonlocal at
        if depth > DEPTH:
            raise TemplateError("nested too deeply")
        body: list[tuple] = []

        def add(node: tuple) -> None:
            if node[0] == "text" and body and body[-1][0] == "text":
                body[-1] = ("text", body[-1][1] + node[1])
            elif node != ("text", ""):
                body.append(node)

        while at < len(parts):
            kind, words = parts[at]
            at += 1
            if kind == "text":
                add((kind, words))
                continue
            own = _Parser(words)
            if kind == "{{":
                value = own.expression()
                own.end()
                add(("text", _text(value[1])) if value[0] == "const" else ("out", value))
                continue
            word = own.name()
            if word in ends:
                return body, word, own
            if word == "for":
                name = own.name()
                own.need("in")
                over = own.expression()
                own.end()
                inner, _, last = block(("endfor",), depth + 1)
                add(("for", name, over, inner))
            elif word == "if":
                test, found, last = own.expression(), [], own
                while True:
                    last.end()
                    inner, word, last = block(("elif", "else", "endif") if test != ("const", True, "else") else ("endif",), depth + 1)
                    found.append((test, inner))
                    if word == "endif":
                        break
                    test = last.expression() if word == "elif" else ("const", True, "else")
                for i in reversed([i for i, (test, _) in enumerate(found) if test[0] == "const"]):
                    if found[i][0][1]:
                        found = found[: i + 1]
                    else:
                        del found[i]
                if found and found[0][0][0] == "const":
                    for node in found[0][1]:
                        add(node)
                elif found:
                    add(("if", found))
            elif word == "set":
                name = own.name()
                own.need("=")
                value = own.expression()
                own.end()
                add(("set", name, value))
                continue
            elif word == "generation":
                own.end()
                inner, _, last = block(("endgeneration",), depth + 1)
                add(("generation", inner))
            else:
                raise TemplateError(f"no statement {word!r}")
            if last is not None:
                last.end()
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return body, "", None

    return block((), 0)[0]


Render = Callable[[_State], None]


def _body(nodes: list[tuple]) -> Render:
    each = [_statement(x) for x in nodes]
    if len(each) == 1:
        return each[0]

    def run(s: _State) -> None:
        for x in each:
            x(s)

    return run


def _statement(node: tuple) -> Render:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda s: s.write(text)
    if kind == "out":
        value = _expression(node[1])

        def out(s: _State) -> None:
            s.step()
            s.write(_text(value(s)))

        return out
    if kind == "set":
        name, value = node[1], _expression(node[2])

        def assign(s: _State) -> None:
            s.names[-1][name] = value(s)

        return assign
    if kind == "if":
        cases = [(_expression(test), _body(inner)) for test, inner in node[1]]

        def choose(s: _State) -> None:
            for test, inner in cases:
                if test(s):
                    inner(s)
                    return

        return choose
    if kind == "generation":
        inner = _body(node[1])

        def mark(s: _State) -> None:
            if s.inside:
                raise TemplateError("generation within generation")
            s.inside, start = True, s.length
            inner(s)
            s.inside = False
            if s.length > start:
                s.spans.append((start, s.length))

        return mark
    name, over, inner = node[1], _expression(node[2]), _body(node[3])

    def loop(s: _State) -> None:
        found = over(s)
        if found is MISSING or found is None:
            return
        if not isinstance(found, list):
            raise TemplateError("for takes a list")
        for i, x in enumerate(found):
            s.step()
            s.names.append({name: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(found) - 1, "length": len(found)}})
            inner(s)
            s.names.pop()

    return loop


@lru_cache(64)
def compiled(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of names' values: the text, and the character ranges within generation markers."""
    run = _body(parse(source))

    def render(**names: Any) -> tuple[str, list[tuple[int, int]]]:
        state = _State([dict(names)])
        run(state)
        return "".join(state.out), state.spans

    return render


TEMPLATE = (
    "{%- for message in messages -%}{{ '<|im_start|>' ~ message.role ~ '\\n' }}"
    "{%- if message.role == 'assistant' -%}{%- generation -%}{{ message.content | trim ~ '<|im_end|>' }}{%- endgeneration -%}"
    "{%- else -%}{{ message.content | trim ~ '<|im_end|>' }}{%- endif -%}{{ '\\n' }}{%- endfor -%}"
)


def formatted(conversations: DataFrame, template: str = TEMPLATE, **names: Any) -> DataFrame:
    """conv_id, n_turns, text, generated and error of each conversation(conv_id, turn, role, text).

    The turns of a conversation are the template's messages, each with role and content, in the order of turn, then
    role, then text, nulls first; repeated rows are turns of their own. A null role or text is none in the template,
    which renders as nothing. A null conv_id is a conversation of its own. generated has the character ranges to
    learn from as "start-end start-end". Where the template can't render a conversation, text and generated are null
    and error says why. An empty table has no conversations; other columns are ignored. Names: values for the template.
    """
    compiled(template)  # a wrong template fails here
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", "role", "text").alias("row"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        for batch in batches:
            found = []
            for conv_id, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = {"conv_id": conv_id, "n_turns": len(rows)}
                try:
                    text, spans = render(messages=[{"role": r["role"], "content": r["text"]} for r in rows], **names)
                    one |= {"text": text, "generated": " ".join(f"{a}-{b}" for a, b in spans)}
                except TemplateError as bad:
                    one["error"] = str(bad)
                found.append(one)
            yield pa.RecordBatch.from_pylist(found, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int32()), ("text", pa.string()), ("generated", pa.string()), ("error", pa.string())])
    return grouped.mapInArrow(run, "conv_id bigint, n_turns int, text string, generated string, error string")


def op4_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(read(spark, sf_dir, "conversations"))


SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, '<|im_start|>' || role || chr(10) AS head,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || '<|im_end|>' AS body
  FROM conversations
),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + length(head) AS pos
  FROM turns
)
SELECT conv_id, count(*)::INT AS n_turns, string_agg(head || body || chr(10), '' ORDER BY turn, role, body) AS text,
       coalesce(string_agg(pos || '-' || (pos + length(body)), ' ' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS generated,
       NULL::VARCHAR AS error
FROM placed GROUP BY conv_id
"""
