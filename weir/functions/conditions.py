"""The condition language: paths against literals, `and`, `or`, `not`, `=~` and `!~`.

    severity >= 17 and not (body =~ 'timeout' or attributes."http.status" == 404)

A parsed condition becomes one Spark Column. Conditions have two values, never null: a comparison
with nothing, or with a value of another type, is false, and `!=`, `!~` and `not` negate exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from weir.functions import paths

Literal = str | int | float | bool | None

_NUMBER = re.compile(r"[0-9+-][0-9.eE+-]*")
_WORD = re.compile(r"[A-Za-z_]")
_OPERATORS = ("==", "!=", "<=", ">=", "=~", "!~", "<", ">")


class ConditionError(ValueError):
    """A condition that cannot be read."""


@dataclass(frozen=True)
class Compare:
    path: paths.Path
    op: str
    literal: Literal


@dataclass(frozen=True)
class Match:
    path: paths.Path
    pattern: str
    negated: bool


@dataclass(frozen=True)
class Not:
    of: Condition


@dataclass(frozen=True)
class Both:
    left: Condition
    right: Condition
    op: str  # "and" or "or"


Condition = Compare | Match | Not | Both


def _tokens(text: str) -> list[tuple[str, object, int]]:
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
        elif c in "()":
            out.append((c, c, at))
            at += 1
        elif op := next((o for o in _OPERATORS if text.startswith(o, at)), None):
            out.append(("op", op, at))
            at += len(op)
        elif c in "'\"" and not (c == '"' and (not out or out[-1][0] in ("(", "word"))):
            start, chars = at, []
            at += 1
            while at < len(text) and text[at] != c:
                if text[at] == "\\" and at + 1 < len(text):
                    at += 1
                    chars.append({"n": "\n", "t": "\t", "r": "\r"}.get(text[at], text[at]))
                else:
                    chars.append(text[at])
                at += 1
            if at >= len(text):
                raise ConditionError(f"unterminated string starting at offset {start}")
            at += 1
            out.append(("literal", "".join(chars), start))
        elif found := _NUMBER.match(text, at):
            try:
                number = int(found[0]) if re.fullmatch(r"[+-]?\d+", found[0]) else float(found[0])
            except ValueError:
                raise ConditionError(f"invalid number `{found[0]}` at offset {at}") from None
            out.append(("literal", number, at))
            at = found.end()
        elif c in '."' or _WORD.match(text, at):
            try:
                path, end = paths.scan(text, at)
            except paths.PathError as e:
                raise ConditionError(f"{e} (path at offset {at})") from None
            word = text[at:end]
            if word in ("and", "or", "not"):
                out.append(("word", word, at))
            elif word in ("true", "false", "null") and out and out[-1][0] == "op":
                out.append(("literal", {"true": True, "false": False, "null": None}[word], at))
            else:
                out.append(("path", path, at))
            at = end
        else:
            raise ConditionError(f"unexpected character `{c}` at offset {at}")
    return out


def parse(text: str) -> Condition:
    tokens = [*_tokens(text), ("end", "the end", len(text))]
    at = 0

    def unexpected() -> ConditionError:
        kind, value, place = tokens[at]
        shown = "end of condition" if kind == "end" else f"`{value}` at offset {place}"
        return ConditionError(f"unexpected {shown}")

    def either() -> Condition:
        nonlocal at
        left = both()
        while tokens[at][:2] == ("word", "or"):
            at += 1
            left = Both(left, both(), "or")
        return left

    def both() -> Condition:
        nonlocal at
        left = single()
        while tokens[at][:2] == ("word", "and"):
            at += 1
            left = Both(left, single(), "and")
        return left

    def single() -> Condition:
        nonlocal at
        kind, value, place = tokens[at]
        if (kind, value) == ("word", "not"):
            at += 1
            return Not(single())
        if kind == "(":
            at += 1
            inner = either()
            if tokens[at][0] != ")":
                raise unexpected()
            at += 1
            return inner
        if kind != "path":
            raise unexpected()
        at += 1
        if tokens[at][0] != "op":
            raise unexpected()
        op, op_place = tokens[at][1], tokens[at][2]
        at += 1
        if tokens[at][0] != "literal":
            raise unexpected()
        literal = tokens[at][1]
        at += 1
        if op in ("=~", "!~"):
            if not isinstance(literal, str):
                raise ConditionError(f"`=~` and `!~` take a quoted pattern (at offset {tokens[at - 1][2]})")
            return Match(value, literal, op == "!~")
        del op_place, place
        return Compare(value, op, literal)

    condition = either()
    if tokens[at][0] != "end":
        raise unexpected()
    return condition


def patterns(condition: Condition) -> list[Match]:
    """The pattern matches in a condition, from left to right."""
    if isinstance(condition, Match):
        return [condition]
    if isinstance(condition, Not):
        return patterns(condition.of)
    if isinstance(condition, Both):
        return patterns(condition.left) + patterns(condition.right)
    return []
