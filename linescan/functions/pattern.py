"""Patterns: literal, several literals, or regular expression; as predicates, byte spans and mandatory fragments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from linescan.errors import PatternError

SPECIAL = frozenset(r".*+?[]{}()|\^$")
GRAM = 4
#: Characters that mark matches while spans are computed; Unicode reserves them for such use.
OPEN, CLOSE, STAND_IN = "﷐", "﷑", "﷒"
#: What is looked at as a whole when a pattern is searched for what is refused: quoted parts, escapes, classes' ends, repeats, groups.
_TOKEN = re.compile(r"\\Q.*?(?:\\E|$)|\\[xpPN]\{[^{}]*\}|\\.|\(\?(?:[=!>]|<[=!])?|(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})[+?]?|.", re.S)
_CLASSES = {
    "alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct",
    "space": "Space", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "xdigit": "XDigit",
}


def literal_part(pattern: str) -> str | None:
    """The literal that a pattern without other special characters than ^ in front and $ behind stands for."""
    core = pattern.lstrip("^").rstrip("$")
    return None if SPECIAL & set(core) else core


@dataclass(frozen=True)
class Pattern:
    kind: str  # literal, literals or regex
    literals: tuple[str, ...]
    regex: str  # in Java's dialect
    #: For each way to match, runs of characters that such a line must hold; () where nothing is known.
    required: tuple[tuple[str, ...], ...]

    def fragments(self) -> list[list[bytes]]:
        """For each way to match, the 4-byte fragments that it can't do without."""
        return [sorted({g for run in runs for g in grams(run)}) for runs in self.required]

    def matches(self, line: Column) -> Column:
        """Whether a line matches."""
        if self.kind == "regex":
            return line.rlike(self.regex)
        if not self.literals:
            return F.lit(False)
        if "" in self.literals:
            return line.isNotNull()
        return _any([F.contains(line, F.lit(x)) for x in self.literals])

    def may_match(self, text: Column) -> Column:
        """False only for texts none of whose lines matches: what is cheap to test before lines are split."""
        if not self.required:
            return F.lit(False)
        if any(not runs for runs in self.required):
            return F.lit(True)
        return _any([_all([F.contains(text, F.lit(x)) for x in runs]) for runs in self.required])

    def spans(self, line: Column) -> Column:
        """ARRAY<STRUCT<start INT, end INT>> of the byte ranges of all matches, left to right.

        An empty match at the end of the match before it is none.
        """
        if self.kind != "regex" and not self.literals:
            return F.lit(None).cast("array<struct<start:int,end:int>>")
        if self.kind == "literal" and self.literals[0]:
            return _literal_spans(line, self.literals[0])
        clean = F.translate(line, OPEN + CLOSE, STAND_IN * 2)  # of equal length in bytes
        marked = F.regexp_replace(clean, F.lit(self.regex), F.lit(f"{OPEN}$0{CLOSE}"))
        length = F.transform(F.split(marked, f"[{OPEN}{CLOSE}]", -1), F.octet_length)
        empty = F.array().cast("array<struct<start:int,end:int>>")

        def add(state: Column, n: Column) -> Column:
            """Lengths of what is between matches and of matches, in turn; state.inside: whether n is a match's."""
            end = state["at"] + n
            last = F.try_element_at(state["spans"], F.lit(-1))["end"]
            drop = ~state["inside"] | ((n == 0) & F.coalesce(last == state["at"], F.lit(False)))
            one = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
            spans = F.when(drop, state["spans"]).otherwise(F.concat(state["spans"], one))
            return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), spans.alias("spans"))

        first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("spans"))
        return F.aggregate(length, first, add, lambda s: s["spans"])


def _literal_spans(line: Column, literal: str) -> Column:
    """As spans(), from the lengths of what is between the matches alone."""
    n = len(literal.encode())

    def add(state: Column, between: Column) -> Column:
        start = state["at"] + F.octet_length(between)
        one = F.array(F.struct(start.alias("start"), (start + n).alias("end")))
        return F.struct((start + n).alias("at"), F.concat(state["spans"], one).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    gaps = F.split(line, quoted(literal), -1)  # one more than there are matches
    return F.aggregate(gaps, first, add, lambda s: F.slice(s["spans"], 1, F.size(s["spans"]) - 1))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for x in tests[1:]:
        out = out | x
    return out


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for x in tests[1:]:
        out = out & x
    return out


def grams(text: str) -> list[bytes]:
    """The distinct windows of GRAM bytes, in order."""
    raw = text.encode()
    return list(dict.fromkeys(raw[i : i + GRAM] for i in range(len(raw) - GRAM + 1)))


def quoted(literal: str) -> str:
    """A regular expression for just this literal."""
    return re.sub(r"[!-/:-@\[-`{-~]", r"\\\g<0>", literal)


def _is_refused(pattern: str) -> bool:
    """Whether it has backreferences, look-around, or groups or repeats that never give back."""
    depth, begun = 0, False
    for token in _TOKEN.findall(pattern):
        if token == "[":
            depth, begun = depth + 1, True
            continue
        if token == "]" and depth and not begun:
            depth -= 1
        begun = begun and token == "^"  # a ] in front is a literal one
        if re.fullmatch(r"\\[1-9k]", token):
            return True
        if not depth and (token in ("(?=", "(?!", "(?>", "(?<=", "(?<!") or (len(token) > 1 and token[0] in "*+?{" and token[-1] == "+")):
            return True
    return False


def java_regex(pattern: str) -> str:
    """The pattern in Java's dialect; what needs backtracking is refused."""
    if _is_refused(pattern):
        raise PatternError(f"backreferences, look-around and possessive quantifiers aren't supported: {pattern}")
    out = pattern.replace("(?P<", "(?<")
    for name, java in _CLASSES.items():
        out = out.replace(f"[:{name}:]", rf"\p{{{java}}}").replace(f"[:^{name}:]", rf"\P{{{java}}}")
    return "(?d)" + out


#: Escapes of one letter that stand for a class, an assertion or a control character.
_ONE = frozenset("dDsSwWhHvVRXbBAzZGtnrfae")
_LONGER = re.compile(r"x[0-9A-Fa-f]{2}|x\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|c[@-_]|[pP](?:[A-Za-z]|\{[^{}\\]*\})")
_REPEAT = re.compile(r"\{[0-9]+(?:,[0-9]*)?\}")


class _Unknown(Exception):
    """What the tokenizer doesn't know: then nothing is said about a pattern."""


def _escape(pattern: str, i: int) -> tuple[int, str | None]:
    """Where the escape at i ends, and the character that it stands for, if it just quotes one."""
    c = pattern[i + 1 : i + 2]
    if c.isascii() and c and not c.isalnum():
        return i + 2, c
    if c in _ONE and c:
        return i + 2, None
    if longer := _LONGER.match(pattern, i + 1):
        return longer.end(), None
    raise _Unknown


def _class_end(pattern: str, i: int) -> int:
    """Where the character class that begins at i ends; classes nest."""
    depth = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i = _escape(pattern, i)[0]
            continue
        i += 1
        if c == "[":
            depth += 1
            i += pattern[i : i + 1] == "^"
            if pattern[i : i + 1] == "]":  # a literal one, or the end of an empty class: dialects differ
                raise _Unknown
        elif c == "]":
            depth -= 1
            if not depth:
                return i
    raise _Unknown


def _atoms(pattern: str) -> Iterator[tuple[str | None, int]]:
    """The atoms of a pattern without | and groups with options: the character of a literal one outside of groups, or
    None, and how often it has to be there: 0, 1 for just once, 2 for more often or in unknown number."""
    i, depth = 0, 0
    while i < len(pattern):
        c, literal = pattern[i], None
        if c == "\\":
            i, literal = _escape(pattern, i)
        elif c == "[":
            i = _class_end(pattern, i)
        else:
            depth += (c == "(") - (c == ")")
            literal = None if c in SPECIAL else c
            i += 1
        if depth < 0:
            raise _Unknown
        times = 1
        while i < len(pattern) and pattern[i] in "*?+{" and c != "(":
            if pattern[i] == "{":
                repeat = _REPEAT.match(pattern, i)
                if repeat is None:
                    raise _Unknown
                i, times = repeat.end(), 0
            else:
                times = 2 if pattern[i] == "+" and times else 0
                i += 1
        yield (literal if depth == 0 and c != ")" else None), times


def mandatory_runs(pattern: str) -> tuple[str, ...]:
    """Runs of literal characters that every match of a regular expression holds; cautious, so possibly none.

    Nothing is said of patterns with alternatives, groups with options, or anything that isn't known here.
    """
    if "|" in pattern or "(?" in pattern:
        return ()
    runs, run = [], ""
    try:
        for literal, times in _atoms(pattern):
            if literal is None or not times:
                runs.append(run)
                run = ""
            elif times == 1:
                run += literal
            else:  # what follows comes after the last of several
                runs.append(run + literal)
                run = ""
    except _Unknown:
        return ()
    return tuple(dict.fromkeys(x for x in (*runs, run) if x and "\n" not in x))


def compile_pattern(pattern: str, force_literal: bool = False, compat_alternation: bool = False) -> Pattern:
    """Picks the cheapest matcher: a literal, several literals, or a regular expression.

    ^ and $ around a literal are dropped. An alternation of literals is matched leftmost, first branch first. With
    compat_alternation, branches that aren't literals are dropped from any pattern that has a '|'.
    """
    if force_literal:
        return _literals("literal", (pattern,))
    if (one := literal_part(pattern)) is not None:
        return _literals("literal", (one,))
    if "|" in pattern:
        parts = [literal_part(x) for x in pattern.split("|")]
        if compat_alternation or None not in parts:
            return _literals("literals", tuple(x for x in parts if x is not None))
    java = java_regex(pattern)
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
        except Exception as bad:
            raise PatternError(f"{pattern}: {str(bad).splitlines()[-1]}") from None
    return Pattern("regex", (), java, (mandatory_runs(pattern),))


def _literals(kind: str, literals: tuple[str, ...]) -> Pattern:
    usable = tuple(x for x in literals if "\n" not in x)  # lines have none
    return Pattern(kind, usable, "(?d)" + "|".join(map(quoted, usable)), tuple((x,) if x else () for x in usable))
