import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import free, holds, structured
from weir.functions import conditions, hashing, paths, regexes, traces
from weir.plans.frames import canonical, double_text

MIXED = [
    {"a": 1, "s": "x\n", "n": {"k": "v", "0": 5}, "l": [1, "two", None]},
    {"a": 1.0, "s": "é", "n": None, "l": []},
    {"a": "1", "s": 5, "n": {"k": None}},
    {"a": None, "s": "abc", "meta": "own"},
    {"a": True, "s": ""},
    {"a": 2**53 + 1},
    {"a": -3.5, "s": "x 10.0.0.1 y"},
    {"a": 18446744073709551615},
    [1, 2],
    "line",
    7,
    None,
]
CONDITIONS = [
    "a == 1", "a != 1", "a == 1.0", "a < 2", "not (a < 2)", "a >= 9007199254740993", "a == 18446744073709551615", 'a == "1"', 'a != "1"', "a == true", "a != true",
    "a == null", "a != null", "n.k == null", 'n.k == "v"', "n.0 == 5", "l.0 == 1", 'l.1 == "two"', "l.9 == null", 's =~ "^.$"', 's !~ "b"', 's =~ "c$"', "s =~ '\\\\d+'",
    '.meta == "own"', 'meta.tenant == "t"', "meta.id > 3", "a < null", "a < true", 'not (s == "abc" or a == 1) and s != "é"', 'a > 0 or s =~ "x" and not n == null', ". == 7", '. == "line"', ".0 == 1",
]


def test_conditions_on_free_form_records_agree_with_a_plain_reading(spark):
    frame = free(spark, MIXED)
    parsed = [conditions.parse(c) for c in CONDITIONS]
    for positive in (True, False):
        columns = [F.coalesce(frame.shape.condition(p, regexes.compiled, positive), F.lit(False)).alias(f"c{k}") for k, p in enumerate(parsed)]
        for row in frame.df.select("meta.id", *columns).collect():
            for k, p in enumerate(parsed):
                assert row[k + 1] == holds(p, MIXED[row[0]], {"id": row[0], "tenant": "t"}), (CONDITIONS[k], MIXED[row[0]])


TYPED = [{"i": 1, "d": 1.5, "s": "a", "b": True, "m": {"k": "v"}, "l": [1, 2], "n": {"x": 1}}, {"i": None, "d": math.nan, "s": None, "b": None, "m": None, "l": None, "n": None}, {"i": -5, "d": -1.0, "s": "b\n", "b": False, "m": {}, "l": [], "n": {"x": None}}]
TYPED_CONDITIONS = ["i == 1", "i != 1", "i < 2.5", "i > 99999999999999999999", "d > 1", "d >= 1", "not (d > 1)", "d == 1.5", 's == "a"', 's != "a"', "s == 1", "s != 1", "b == true", "b != true", "b < true", 'm.k == "v"', "l.1 == 2", "l.7 == null", "n.x == 1", "n.x != null", "q.r == null", "q.r != 3", 's =~ "b$"', 's !~ "b"', "i =~ '1'", 'not (i == 1 and s == "a") or d == null']


def test_conditions_on_structured_records_agree_with_a_plain_reading(spark):
    frame = structured(spark, TYPED, "i bigint, d double, s string, b boolean, m map<string,string>, l array<int>, n struct<x:int>")
    parsed = [conditions.parse(c) for c in TYPED_CONDITIONS]
    for positive in (True, False):
        columns = [F.coalesce(frame.shape.condition(p, regexes.compiled, positive), F.lit(False)).alias(f"c{k}") for k, p in enumerate(parsed)]
        for row in frame.df.select("meta.id", *columns).collect():
            for k, p in enumerate(parsed):
                assert row[k + 1] == holds(p, TYPED[row[0]], {"id": row[0], "tenant": "t"}), (TYPED_CONDITIONS[k], TYPED[row[0]])


@pytest.mark.parametrize(
    "text, message",
    [
        ("severity == ERROR", "unexpected `ERROR` at offset 12"),
        ('body == "open', "unterminated string starting at offset 8"),
        ("body =~ 42", "`=~` and `!~` take a quoted pattern (at offset 8)"),
        ("a = 1", "unexpected character `=` at offset 2"),
        ("a == 1 b == 2", "unexpected `b` at offset 7"),
        ("(a == 1", "unexpected end of condition"),
        ('attributes["x.y"] == 1', 'a path has dots only, as in `attributes."x.y"` (path at offset 0)'),
    ],
)
def test_conditions_refused(text, message):
    with pytest.raises(conditions.ConditionError) as e:
        conditions.parse(text)
    assert str(e.value) == message


def test_paths():
    assert str(paths.parse('a."b c".0')) == 'a."b c".0' and str(paths.parse(".meta.x")) == ".meta.x" and str(paths.parse(".")) == "."
    for bad in ("", "a..b", "meta.other", "meta", 'a."x', "a b", "a[0]"):
        with pytest.raises(paths.PathError):
            paths.parse(bad)
    with pytest.raises(paths.PathError, match="only read"):
        paths.parse_target("meta.id")
    p = paths.parse
    assert paths.put({"a": [1, 2]}, p("a.1"), 9) == {"a": [1, 9]}
    assert paths.put({"a": [1]}, p("a.4"), 9) == {"a": {"4": 9}}
    assert paths.put("text", p("a.b"), 1) == {"a": {"b": 1}} and paths.put({"a": 1}, p("."), 2) == 2
    assert paths.remove({"a": [1, 2, 3]}, p("a.1")) == {"a": [1, 3]} and paths.remove({"a": 1}, p("b")) == {"a": 1} and paths.remove({"a": 1}, p(".")) is None
    assert paths.get({"01": 1, "l": [5]}, p("01")) == 1 and paths.get([1], p("01")) is None


def test_hashes_agree_with_python(spark):
    texts = ["", "a", "é日本\U0001f600", '{"k": 87}' * 20]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.fnv1a64(F.col("t")).alias("h")).collect():
        assert r.h == hashing.signed(hashing.fnv1a64_py(r.t.encode()))
    numbers = [0, 1, -1, 2**63 - 1, -(2**63), 123456789, -987654321012345]
    for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", hashing.mix(F.col("n")).alias("h"), hashing.at_most(F.col("n"), 2**63 + 5).alias("few"), traces.trace_id(F.col("n"), F.lit("t")).alias("trace")).collect():
        assert r.h == hashing.signed(hashing.mix_py(r.n % 2**64)) and r.few == (r.n % 2**64 <= 2**63 + 5)
        key = hashing.mix_py((r.n % 2**64) ^ hashing.fnv1a64_py(b"t") ^ traces.SALT)
        assert r.trace == f"{key:016x}{r.n % 2**64:016x}"
    assert hashing.threshold(100) == 2**64 - 1


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_floats_keep_their_point(x):
    text = canonical(x)
    assert float(text) == x and ("." in text or "e" in text)


def test_double_text(spark):
    values = [0.1, 2.0, 1e7, 12345678.9, 1e15, 1e16, 1.5e20, 1e-4, 1.25e-5, 1e-7, -1e7, -2.5e-4, 123456789012345.6]
    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", double_text(F.col("v")).alias("t")).collect():
        assert r.t == canonical(r.v), r


def test_key_text_is_the_same_in_both_shapes(spark):
    records = [{"s": 'q"\\\n', "d": 2.0, "i": 3, "b": True, "n": {"z": 1, "a": None}, "l": [1.5]}, {"s": None, "d": None, "i": None, "b": None, "n": None, "l": None}]
    key = [paths.parse(x) for x in ("s", "d", "i", "b", "n", "l", "gone", "meta.id")]
    typed = structured(spark, records, "s string, d double, i int, b boolean, n struct<z:int,a:int>, l array<double>")
    a = {r[0]: r[1] for r in typed.df.select("meta.id", typed.shape.key(key)).collect()}
    loose = free(spark, records)
    b = {r[0]: r[1] for r in loose.df.select("meta.id", loose.shape.key(key)).collect()}
    assert a == b and json.loads(a[0])[1] == 2.0 and "2.0" in a[0]


@pytest.mark.parametrize("pattern", [r"^(?<w>(\w+\s?)*)$", r"(a+)+b", r"\d+\w+x", r"(?:ab|\w\d)+c"])
def test_risky_patterns_are_refused(pattern):
    with pytest.raises(regexes.PatternError, match="ReDoS risk"):
        regexes.compiled(pattern)
    with pytest.warns(UserWarning):
        regexes.compiled(pattern, on_redos_risk="warn")


@pytest.mark.parametrize("pattern", [r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"^\[(?<t>[^\]]+)\] (?<c>.*)$", r"^(?<a>\S+) +(?<b>[^\s:][^:]*): (?<c>.*)$"])
def test_safe_patterns_pass(pattern):
    assert regexes.compiled(pattern).linear


@pytest.mark.parametrize("pattern", ["*x", "a**", "(?<n>a)(?<n>b)", "[z-a]", r"\p{Nothing}"])
def test_patterns_that_the_engine_refuses(spark, pattern):
    with pytest.raises(regexes.PatternError):
        regexes.compiled(pattern, on_redos_risk="warn")


@pytest.mark.parametrize("pattern", ["(?R)", "(a(?1)b)", "(?<x>a(?&x)?)", "(?<x>a(?P>x)?)"])
def test_patterns_that_refer_to_themselves(pattern):
    with pytest.raises(regexes.PatternError) as e:
        regexes.compiled(pattern)
    assert e.value.code == "unsupported_pattern"


def test_what_cannot_be_read_is_a_risk():
    assert regexes.lint("(?<a") and regexes.lint("(?<=a|bc)(?'x'a)")
    for readable in (r"\p{L}+ \P{Nd}", r"\x{1F600}a", r"(?<q>['x]).\k<q>", r"a\z", "(?i)a(?s).b", "[[:alpha:]]x", r"a\h+b"):
        assert regexes.lint(readable) is None, readable
    assert regexes.lint(r"(\p{L}+)+x")


def test_pattern_limits():
    for bad, message in [("(a", "missing closing parenthesis"), ("a" * 9000, "more than"), ("()" * 251, "more than")]:
        with pytest.raises(regexes.PatternError, match=message):
            regexes.compiled(bad)
    with pytest.raises(regexes.PatternError) as e:
        regexes.compiled("a", {"input_kib": 3})
    assert e.value.code == "unknown_field"
    assert not regexes.compiled(r"(?<=x)\d").linear and regexes.compiled(r"(?P<a_b>x)\k<a_b>").java == r"(?Ud)(x)\1"
