r"""Patterns of the pipeline's dialect, for Java's engine inside Spark.

Patterns are Unicode-aware, `$` is the end of the text only, `.` is all but `\n`, groups may be named
`(?<a_b>..)` or `(?P<a_b>..)`. translate() rewrites what Java reads otherwise; lint() refuses shapes that can
take exponential or quadratic time, at load.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PATTERN_BYTES = 8192
MAX_PARENTHESES = 250
#: A longer text is not searched: the record leaves with reason regex_limit.
INPUT_BYTES = 65_536
LIMITS = ("match", "depth", "heap_kib", "work", "input_bytes")


class PatternError(ValueError):
    """A pattern that cannot be read, that Spark's engine lacks, or that is too risky; code tells which."""

    def __init__(self, message: str, code: str = "bad_pattern"):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Pattern:
    """java: the translated text; groups: name and number of each named group; linear: no construct that needs backtracking."""

    source: str
    java: str
    groups: tuple[tuple[str, int], ...]
    linear: bool
    input_bytes: int = INPUT_BYTES

    def found_in(self, text: Column) -> Column:
        return text.rlike(self.java)

    def too_long(self, text: Column) -> Column:
        return F.octet_length(text) > self.input_bytes


_NAMED = re.compile(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>")
_BACKTRACKING = re.compile(r"\(\?(?:=|!|<=|<!|>|R|\d|&|P>)|\\[1-9]|\\k[<{']|\(\?P=|[*+?}]\+")


def translate(source: str) -> tuple[str, tuple[tuple[str, int], ...], bool]:
    names: dict[str, int] = {}
    out, at, count, in_class, depth = [], 0, 0, 0, 0
    multiline = bool(re.match(r"\(\?[a-zA-Z]*m", source))
    bare = []  # the pattern without classes and escapes, to look for constructs
    while at < len(source):
        c = source[at]
        if c == "\\" and at + 1 < len(source):
            if ref := re.compile(r"\\k[<{']([A-Za-z_]\w*)[>}']").match(source, at):
                if ref[1] not in names:
                    raise PatternError(f"reference to unknown group `{ref[1]}` at offset {at}")
                out.append(f"\\{names[ref[1]]}")
                bare.append("\\1")
                at = ref.end()
                continue
            pair = source[at : at + 2]
            out.append("\\z" if pair == "\\z" else pair)
            bare.append(pair if not in_class else "")
            at += 2
            continue
        if in_class:
            if c == "[":
                if source.startswith("[:", at) and (end := source.find(":]", at)) > 0:
                    name = source[at + 2 : end]
                    negated = name.startswith("^")
                    out.append(("\\P{" if negated else "\\p{") + {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "xdigit": "XDigit", "word": "IsWord", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print"}.get(name.lstrip("^"), "Alpha") + "}")
                    at = end + 2
                    continue
                out.append("\\[" if not source.startswith("[^", at) else "\\[")
                at += 1
                continue
            if c == "&" and source.startswith("&&", at):
                out.append("\\&\\&")
                at += 2
                continue
            if c == "]":
                in_class = 0
            out.append(c)
            at += 1
            continue
        if c == "[":
            in_class = 1
            out.append(c)
            at += 1
            if source[at : at + 1] == "^":
                out.append("^")
                at += 1
            if source[at : at + 1] == "]":
                out.append("\\]")
                at += 1
            bare.append("[]")
            continue
        if c == "(":
            depth += 1
            if named := _NAMED.match(source, at):
                count += 1
                if named[1] in names:
                    raise PatternError(f"duplicate group name `{named[1]}` at offset {at}")
                names[named[1]] = count
                out.append("(")
                bare.append("(")
                at = named.end()
                continue
            if back := re.compile(r"\(\?P=([A-Za-z_]\w*)\)").match(source, at):
                out.append(f"\\{names[back[1]]}")
                bare.append("\\1")
                depth -= 1
                at = back.end()
                continue
            if source[at + 1 : at + 2] != "?":
                count += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise PatternError(f"unopened parenthesis at offset {at}")
        elif c == "$" and not multiline:
            out.append("\\z")
            bare.append("$")
            at += 1
            continue
        out.append(c)
        bare.append(c)
        at += 1
    if in_class:
        raise PatternError(f"missing closing bracket at offset {len(source)}")
    if depth:
        raise PatternError(f"missing closing parenthesis at offset {len(source)}")
    return "(?Ud)" + "".join(out), tuple(names.items()), not _BACKTRACKING.search("".join(bare))


def compiled(source: str, limits: dict | None = None, on_redos_risk: str = "reject") -> Pattern:
    """Checks a pattern and translates it. limits: only input_bytes has a counterpart in Spark; the others are accepted."""
    limits = limits or {}
    for key in limits:
        if key not in LIMITS:
            raise PatternError(f"there is no limit `{key}`; there are " + ", ".join(LIMITS), "unknown_field")
    if on_redos_risk not in ("reject", "warn"):
        raise PatternError(f"`on_redos_risk` is reject or warn, not `{on_redos_risk}`", "unknown_choice")
    if len(source.encode()) > MAX_PATTERN_BYTES:
        raise PatternError(f"it takes more than {MAX_PATTERN_BYTES} bytes", "too_large")
    if source.count("(") - source.count("\\(") > MAX_PARENTHESES:
        raise PatternError(f"it opens more than {MAX_PARENTHESES} parentheses", "too_large")
    if _RECURSION.search(re.sub(r"\\.", "", source, flags=re.DOTALL)):
        raise PatternError("it refers to itself, which Spark's engine cannot", "unsupported_pattern")
    java, groups, linear = translate(source)
    _accepted(java)
    if risk := lint(source):
        if on_redos_risk == "reject":
            raise PatternError(f"ReDoS risk: {risk}", "redos_risk")
        warnings.warn(f"pattern `{source}`: ReDoS risk: {risk}", stacklevel=2)
    return Pattern(source, java, groups, linear, int(limits.get("input_bytes", INPUT_BYTES)))


_RECURSION = re.compile(r"\(\?(?:R|[+-]?\d+|&|P>)")


def _accepted(java: str) -> None:
    """Refuses what Java's engine does, where a Spark session is there to ask."""
    spark = SparkContext._active_spark_context
    if spark is None:
        return
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JJavaError, PySparkException) as e:
        raise PatternError(str(e).split("\n")[0]) from None


def _read_as(found: re.Match) -> str:
    """An escape that Python's parser lacks as one that begins alike, as far as lint() looks."""
    text = found[0]
    if text[1] in "pP":
        return r"\w" if text[1] == "p" else r"\W"
    if text.startswith("\\x{"):
        return f"\\U{int(text[3:-1], 16):08x}"
    if text[1] == "k" and len(text) > 2:
        return f"(?P={text[3:-1]})"
    return {"\\z": r"\Z", "\\h": r"\s", "\\H": r"\S", "\\R": r"\n", "\\X": "."}.get(text, text)


_ESCAPE = re.compile(r"\\(?:[pP](?:\{[^}]*\}|[A-Z])|x\{[0-9A-Fa-f]+\}|k[<{'][A-Za-z_]\w*[>}']|.)", re.DOTALL)


def lint(source: str) -> str | None:
    """What makes a pattern risky: a repeat inside a repeat, overlapping alternatives under a repeat, adjoining repeats of overlapping sets, or that it cannot be read here."""
    text = re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", _ESCAPE.sub(_read_as, source))
    text = re.sub(r"(?<!\\)\(\?[a-zA-Z-]+\)", "", text)  # flags change no shape
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = re._parser.parse(text)
    except Exception:
        return "its shape cannot be read, so nothing is known of its cost"
    return _risk(tree)


_ENDLESS = re._constants.MAXREPEAT


def _risk(seq) -> str | None:
    c = re._constants
    items = list(seq)
    for k, (op, arg) in enumerate(items):
        for inner in _inside(op, arg):
            if found := _risk(inner):
                return found
        if op not in (c.MAX_REPEAT, c.MIN_REPEAT) or arg[1] is not _ENDLESS:
            continue
        body = arg[2]
        if any(o in (c.MAX_REPEAT, c.MIN_REPEAT) and a[0] != a[1] for o, a in _all(body)) and not _anchored_body(body):
            return "nested unbounded quantifiers"
        for o, a in _all(body):
            if o is c.BRANCH:
                firsts = [_first(list(x)) for x in a[1]]
                if any(firsts[i] & firsts[j] for i in range(len(firsts)) for j in range(i)):
                    return "overlapping alternatives under a quantifier"
        own = _first(list(body))
        if len(list(body)) == 1:
            for o, a in items[k + 1 :]:
                nullable = o in (c.MAX_REPEAT, c.MIN_REPEAT) and a[0] == 0
                if o in (c.MAX_REPEAT, c.MIN_REPEAT) and a[1] is _ENDLESS and own & _first(list(a[2])) and len(list(a[2])) == 1:
                    return "adjoining unbounded quantifiers over overlapping sets"
                if not nullable:
                    break
    return None


def _inside(op, arg):
    c = re._constants
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        return [arg[2]]
    if op is c.SUBPATTERN:
        return [arg[3]]
    if op is c.BRANCH:
        return arg[1]
    if op in (c.ASSERT, c.ASSERT_NOT):
        return [arg[1]]
    return []


def _all(seq):
    for op, arg in seq:
        yield op, arg
        for inner in _inside(op, arg):
            yield from _all(inner)


def _anchored_body(body) -> bool:
    """A body whose first item, outside its repeats, cannot be matched by them marks where each turn begins."""
    c = re._constants
    items = list(body)
    while len(items) == 1 and items[0][0] is c.SUBPATTERN:
        items = list(items[0][1][3])
    repeats = [a for o, a in items if o in (c.MAX_REPEAT, c.MIN_REPEAT)]
    fixed = [x for x in items if x[0] not in (c.MAX_REPEAT, c.MIN_REPEAT)]
    return bool(fixed) and all(not (_first([x]) & _first(list(a[2]))) for x in fixed[:1] for a in repeats)


_ASCII = frozenset(range(128))


def _first(items) -> frozenset[int]:
    """Which of the ASCII characters, and 128 for any others, an item sequence can begin with."""
    c = re._constants
    if not items:
        return frozenset()
    op, arg = items[0]
    if op is c.LITERAL:
        return frozenset([min(arg, 128)])
    if op is c.NOT_LITERAL:
        return (_ASCII | {128}) - {arg}
    if op is c.ANY:
        return (_ASCII | {128}) - {10}
    if op is c.IN:
        out: set[int] = set()
        negate = False
        for o, a in arg:
            if o is c.NEGATE:
                negate = True
            elif o is c.LITERAL:
                out.add(min(a, 128))
            elif o is c.RANGE:
                out |= {min(x, 128) for x in range(a[0], min(a[1], 200) + 1)}
            elif o is c.CATEGORY:
                test = {c.CATEGORY_DIGIT: r"\d", c.CATEGORY_NOT_DIGIT: r"\D", c.CATEGORY_SPACE: r"\s", c.CATEGORY_NOT_SPACE: r"\S", c.CATEGORY_WORD: r"\w", c.CATEGORY_NOT_WORD: r"\W"}[a]
                out |= {k for k in range(128) if re.match(test, chr(k))} | {128}
        return frozenset((_ASCII | {128}) - out if negate else out)
    if op is c.SUBPATTERN:
        return _first(list(arg[3])) or _first(items[1:])
    if op is c.BRANCH:
        return frozenset().union(*[_first(list(x)) for x in arg[1]])
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        own = _first(list(arg[2]))
        return own | _first(items[1:]) if arg[0] == 0 else own
    if op is c.AT:
        return _first(items[1:])
    return frozenset()
