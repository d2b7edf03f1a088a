"""Scanning hardware source text: comments, strings, brackets."""

from __future__ import annotations

import re

_COMMENT_OR_STRING = re.compile(r'"(?:\\.|[^"\\\n])*"?|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
_OPEN = {"(": ")", "[": "]", "{": "}"}


def blank_comments(text: str) -> str:
    """Comments become spaces, so all offsets and line breaks stay; strings are left alone."""

    def blank(m: re.Match) -> str:
        s = m.group()
        return s if s[0] == '"' else re.sub(r"[^\n]", " ", s)

    return _COMMENT_OR_STRING.sub(blank, text)


def strip_comments(text: str) -> str:
    """A line comment goes; a block comment leaves one space."""
    return _COMMENT_OR_STRING.sub(lambda m: m.group() if m.group()[0] == '"' else (" " if m.group()[1] == "*" else ""), text)


def mask_strings(text: str) -> str:
    """Comments and the insides of strings become spaces, for searches that mustn't see them."""

    def blank(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m.group())

    return _COMMENT_OR_STRING.sub(blank, text)


def closing(text: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`, or -1. text has no comment."""
    depth = 0
    stack = []
    for i in range(at, len(text)):
        c = text[i]
        if c in _OPEN:
            stack.append(_OPEN[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
        elif c in ")]}":
            depth += 1
    return -1


def find_top_level(text: str, what: str, start: int = 0) -> int:
    """The first place of `what` outside all brackets, or -1."""
    depth = 0
    i = start
    while i < len(text):
        if depth == 0 and text.startswith(what, i) and not (what.isalpha() and (_word_at(text, i - 1) or _word_at(text, i + len(what)))):
            return i
        depth += (text[i] in "([{") - (text[i] in ")]}")
        i += 1
    return -1


def _word_at(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


def split_top_level(text: str, by: str) -> list[str]:
    """text cut at each `by` outside brackets."""
    parts, at = [], 0
    while (i := find_top_level(text, by, at)) >= 0:
        parts.append(text[at:i])
        at = i + len(by)
    return [*parts, text[at:]]


def call_arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of the call whose opening bracket is at `at`, and the place after it."""
    end = closing(text, at)
    if end < 0:
        raise ValueError(f"bracket at {at} is not closed")
    inside = text[at + 1 : end - 1]
    return ([] if not inside.strip() else [a.strip() for a in split_top_level(inside, ",")]), end


def strip_parens(text: str) -> str:
    """Without brackets that enclose all of it."""
    text = text.strip()
    while text.startswith("(") and closing(text, 0) == len(text):
        text = text[1:-1].strip()
    return text


_MACRO = re.compile(r"`([A-Za-z_]\w*)")
#: Directives, which are no uses of a macro, and passes over a text in which macros inside macros are replaced.
DIRECTIVES = frozenset("define undef ifdef ifndef elsif else endif include timescale default_nettype resetall celldefine endcelldefine line pragma".split())
PASSES = 8


def macros(text: str) -> dict[str, str]:
    """The text's macros that have a value and no arguments; those inside values are replaced already, so that a text
    needs one pass."""
    lines = (line.strip().split(None, 2) for line in blank_comments(text).splitlines())
    known = {x[1]: x[2].strip() for x in lines if len(x) == 3 and x[0] == "`define" and re.fullmatch(r"[A-Za-z_]\w*", x[1])}
    found = dict(known)
    for _ in range(PASSES - 1):
        found = {name: with_macros(value, known) for name, value in found.items()}
    return found


def with_macros(text: str, known: dict[str, str]) -> str:
    return _MACRO.sub(lambda m: m[0] if m[1] in DIRECTIVES else known.get(m[1], m[0]), text)


def plain_labels(text: str) -> str:
    """A stray tick in front of a label goes."""
    return re.sub(r"`([A-Za-z_]\w*)(?=\s*:)", lambda m: m[0] if m[1] in DIRECTIVES else m[1], text)


def unknown_macros(text: str) -> list[str]:
    """Names of macros that are still used, as first seen."""
    return list(dict.fromkeys(m[1] for m in _MACRO.finditer(mask_strings(text)) if m[1] not in DIRECTIVES))
