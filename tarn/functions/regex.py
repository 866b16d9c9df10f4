"""Patterns written for Python, for the regular expressions that Spark runs.

The pattern is parsed once and written out again in the other dialect, so both agree on
classes, groups and anchors; what cannot be said there is refused by name before a job starts.
The same walk finds the literal strings that every match holds.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as C
from re import _parser

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
_CLASSES = {
    C.CATEGORY_DIGIT: r"\p{Nd}",
    C.CATEGORY_NOT_DIGIT: r"\P{Nd}",
    C.CATEGORY_SPACE: f"[{_SPACE}]",
    C.CATEGORY_NOT_SPACE: f"[^{_SPACE}]",
    C.CATEGORY_WORD: f"[{_WORD}]",
    C.CATEGORY_NOT_WORD: f"[^{_WORD}]",
}
_PLACES = {
    C.AT_BEGINNING: r"\A",
    C.AT_BEGINNING_STRING: r"\A",
    C.AT_END: r"(?=\n?\z)",
    C.AT_END_STRING: r"\z",
    C.AT_BOUNDARY: rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))",
    C.AT_NON_BOUNDARY: rf"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))",
}
#: Strings that one literal may stand for, and the bytes a useful one has.
MOST_STRINGS = 64
LEAST_BYTES = 3


class UnsupportedPattern(ValueError):
    """The pattern is valid, but uses what Spark's regular expressions do not have."""


def parse(pattern: str) -> _parser.SubPattern | None:
    """The parsed pattern, read without regard to case; None if it is no valid one."""
    try:
        re.compile(pattern, re.IGNORECASE)
        return _parser.parse(pattern, re.IGNORECASE)
    except re.error:
        return None


def _char(code: int) -> str:
    char = chr(code)
    return char if char.isascii() and char.isalnum() else rf"\x{{{code:x}}}"


def _set(items: list) -> str:
    out, negated = "", False
    for op, value in items:
        if op is C.NEGATE:
            negated = True
        elif op is C.LITERAL:
            out += _char(value)
        elif op is C.RANGE:
            out += f"{_char(value[0])}-{_char(value[1])}"
        else:
            out += _CLASSES[value]
    return f"[{'^' if negated else ''}{out}]"


def to_java(parsed: _parser.SubPattern) -> str:
    """The pattern for Java, matching without regard to case as Python does for text."""
    flags = parsed.state.flags
    for flag, name in ((re.ASCII, "ASCII"), (re.LOCALE, "LOCALE")):
        if flags & flag:
            raise UnsupportedPattern(f"the flag {name} is not supported in patterns")
    return "(?iu)" + _written(parsed, flags)


def _written(nodes, flags: int) -> str:
    return "".join(_node(op, value, flags) for op, value in nodes)


def _node(op, value, flags: int) -> str:
    if op is C.LITERAL:
        return _char(value)
    if op is C.NOT_LITERAL:
        return f"[^{_char(value)}]"
    if op is C.ANY:
        return r"[\x{0}-\x{10ffff}]" if flags & re.DOTALL else r"[^\n]"
    if op is C.IN:
        return _set(value)
    if op is C.AT:
        if flags & re.MULTILINE and value in (C.AT_BEGINNING, C.AT_END):
            return r"(?<![^\n])" if value is C.AT_BEGINNING else r"(?![^\n])"
        return _PLACES[value]
    if op is C.BRANCH:
        return f"(?:{'|'.join(_written(x, flags) for x in value[1])})"
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = value
        most = "" if high is C.MAXREPEAT else high
        mark = {C.MAX_REPEAT: "", C.MIN_REPEAT: "?", C.POSSESSIVE_REPEAT: "+"}[op]
        return f"(?:{_written(inner, flags)}){{{low},{most}}}{mark}"
    if op is C.SUBPATTERN:
        group, more, less, inner = value
        if (more | less) & (re.ASCII | re.LOCALE):
            raise UnsupportedPattern("the flags ASCII and LOCALE are not supported in patterns")
        text = _written(inner, (flags | more) & ~less)
        if group is not None:
            return f"({text})"
        return f"(?-iu:{text})" if less & re.IGNORECASE else f"(?:{text})"
    if op is C.ATOMIC_GROUP:
        return f"(?>{_written(value, flags)})"
    if op in (C.ASSERT, C.ASSERT_NOT):
        side, inner = value
        return f"(?{'<' if side < 0 else ''}{'=' if op is C.ASSERT else '!'}{_written(inner, flags)})"
    if op is C.GROUPREF:
        return rf"(?:\{value})"
    raise UnsupportedPattern(f"{str(op).lower().replace('groupref_exists', 'conditional groups')} not supported in patterns")


def literals(parsed: _parser.SubPattern) -> list[set[str]]:
    """Sets of lower-case ASCII strings; every match holds a string of each of them.

    A set stands for the ways to write one stretch of the pattern. Stretches that hold other
    characters, classes or unbounded repeats tell nothing.
    """
    clauses, exact = _required(parsed)
    return clauses + _useful(exact)


def _useful(strings: set[str] | None) -> list[set[str]]:
    return [strings] if strings and min(map(len, strings)) >= LEAST_BYTES else []


def _joined(left: set[str], right: set[str]) -> set[str] | None:
    return {a + b for a, b in product(left, right)} if len(left) * len(right) <= MOST_STRINGS else None


def _required(nodes) -> tuple[list[set[str]], set[str] | None]:
    """Clauses of a sequence, and all strings it matches if these are few."""
    clauses: list[set[str]] = []
    current: set[str] = {""}
    whole = True
    for op, value in nodes:
        found, exact = _required_node(op, value)
        clauses += found
        more = _joined(current, exact) if exact is not None else None
        if more is None:
            clauses += _useful(current)
            current, whole = exact or {""}, False
        else:
            current = more
    if whole:
        return clauses, current
    return clauses + _useful(current), None


def _required_node(op, value) -> tuple[list[set[str]], set[str] | None]:
    if op is C.LITERAL:
        return [], {chr(value).lower()} if value < 128 else None
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return [], {""}
    if op is C.IN and all(o is C.LITERAL and v < 128 for o, v in value):
        return [], {chr(v).lower() for _, v in value}
    if op is C.SUBPATTERN:
        return _required(value[3])
    if op is C.ATOMIC_GROUP:
        return _required(value)
    if op is C.BRANCH:
        ways = [_required(x) for x in value[1]]
        if all(exact is not None for _, exact in ways):
            union = set().union(*(exact for _, exact in ways))
            return [], union if len(union) <= MOST_STRINGS else None
        best = [max(found + _useful(exact), key=lambda s: min(map(len, s)), default=None) for found, exact in ways]
        return ([] if None in best else [set().union(*best)]), None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = value
        found, exact = _required(inner)
        if (low, high) == (0, 1) and exact is not None:
            return [], exact | {""}
        if not low:
            return [], None
        if low == high and exact is not None:
            times: set[str] | None = {""}
            for _ in range(low):
                times = times and _joined(times, exact)
            if times:
                return found, times
        return found + _useful(exact), None
    return [], None
