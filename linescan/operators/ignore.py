"""Ignore files: ordered rules of which the last that matches decides."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from linescan.functions.scalars import SKIPPED_DIRS, file_name

_BLANKS = " \t\n\r\f"


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool = False
    anchored: bool = False
    dir_only: bool = False
    #: The directory whose ignore file has the rule, relative to the search root; "" is the root.
    dir: str = ""


def parse_rules(text: str, dir: str = "", git_semantics: bool = False) -> list[Rule]:
    """The rules of one ignore file, in order.

    A pattern with a slash anywhere, even at its end, is anchored, and anchored patterns are relative to the search
    root; with git_semantics a slash at the end doesn't anchor, and they are relative to the file's directory.
    """
    rules = []
    for line in text.split("\n"):
        if not line or line[0] == "#":
            continue
        line = line.strip(_BLANKS)
        negated = line.startswith("!")
        line = line[negated:]
        if not line:
            continue
        if line.startswith("/"):
            line, anchored = line[1:], True
        elif line.startswith("**/"):
            line, anchored = line[3:], False
        else:
            anchored = "/" in (line.removesuffix("/") if git_semantics else line)
        dir_only = line.endswith("/")
        line = line.removesuffix("/")
        if line:
            if git_semantics and anchored and dir:
                line = f"{dir}/{line}"
            rules.append(Rule(line, negated, anchored, dir_only, dir))
    return rules


def chain(files: Iterable[tuple[str, str]], git_semantics: bool = False) -> list[Rule]:
    """The rules of several ignore files, given as (directory, text): deeper directories' rules come later."""
    depth = lambda d: len([x for x in d.split("/") if x])
    return [rule for d, text in sorted(files, key=lambda f: depth(f[0])) for rule in parse_rules(text, d.strip("/"), git_semantics)]


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: * and ? cross slashes, [...] is a class; one that isn't closed never matches."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            turn = pattern[i : i + 1] in ("!", "^")
            end = pattern.find("]", i + turn)
            if end < 0 or i + 1 >= len(pattern):
                return "(?!)"
            inner = pattern[i + turn : end]
            i = end + 1
            if not inner:
                out += "." if turn else "(?!)"
                continue
            body, k = "", 0
            while k < len(inner):
                if k + 2 < len(inner) and inner[k + 1] == "-":
                    if inner[k] <= inner[k + 2]:
                        body += f"{_class_char(inner[k])}-{_class_char(inner[k + 2])}"
                    k += 3
                else:
                    body += _class_char(inner[k])
                    k += 1
            out += (f"[{'^' * turn}{body}]") if body else ("." if turn else "(?!)")
        else:
            out += re.sub(r"[!-/:-@\[-`{-~]", r"\\\g<0>", c)
    return f"(?s)^{out}\\z"


def _class_char(c: str) -> str:
    return re.sub(r"[!-/:-@\[-`{-~]", r"\\\g<0>", c)


def rule_matches(rule: Rule, path: Column, name: Column, is_dir: bool | Column) -> Column:
    """Whether one rule matches a path, relative to the search root, whose last component is name."""
    target = path if rule.anchored else name
    pattern, plain = rule.pattern, not set(rule.pattern) & set("*?[")
    if plain and rule.anchored:
        test = (path == pattern) | F.startswith(path, F.lit(pattern + "/"))
    elif plain:
        test = name == pattern
    elif len(pattern) >= 2 and pattern[0] == "*" and not set(pattern[1:]) & set("*?["):
        test = F.endswith(target, F.lit(pattern[1:]))
    elif len(pattern) >= 2 and pattern[-1] == "*" and not set(pattern[:-1]) & set("*?["):
        test = F.startswith(target, F.lit(pattern[:-1]))
    else:
        test = target.rlike(glob_regex(pattern))
    if rule.dir:
        test = F.startswith(path, F.lit(rule.dir + "/")) & test
    if rule.dir_only:
        test = (F.lit(is_dir) if isinstance(is_dir, bool) else is_dir) & test
    return test


def ignored(rules: list[Rule], path: Column, is_dir: bool | Column, name: Column | None = None) -> Column:
    """Whether the rules, in order, ignore the path itself; its directories are not looked at."""
    name = file_name(path) if name is None else name
    rules = [r for r in rules if not (r.dir_only and is_dir is False)]
    if not rules:
        return F.lit(False)
    if not any(r.negated for r in rules):
        tests = [rule_matches(r, path, name, is_dir) for r in rules]
        while len(tests) > 1:  # as a balanced tree, since plans are walked by recursion
            tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) // 2 * 2 :]
        return F.coalesce(tests[0], F.lit(False))
    out = None
    for r in reversed(rules):
        test = rule_matches(r, path, name, is_dir)
        out = F.when(test, not r.negated) if out is None else out.when(test, not r.negated)
    return F.coalesce(out, F.lit(False))


def directories(path: Column) -> Column:
    """The directories above a path, from the top: a/b/c -> [a, a/b]."""
    parts = F.split(path, "/", -1)
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def pruned(rules: list[Rule], path: Column) -> Column:
    """Whether a directory above the path is ignored: nothing beneath it can be brought back."""
    if not rules:
        return F.lit(False)
    return F.exists(directories(path), lambda d: ignored(rules, d, True, F.substring_index(d, "/", -1)))


def common_dir(path: Column) -> Column:
    """Whether a directory above the path is always skipped, whatever the flags."""
    parts = F.split(path, "/", -1)
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED_DIRS)))
