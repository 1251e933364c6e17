import pytest

from logsluice.functions.regexlang import (
    check_pattern, escape_literal, field_name, name_groups, split_named_groups,
)
from logsluice.operators.rules import Field, _body_without_captures, selected_pattern
from logsluice.functions import extract as X


@pytest.mark.parametrize("pattern, positional, names", [
    (r"(?P<src_ip>\d+)", r"(\d+)", ["src_ip"]),
    (r"(?<a_b>x)(?:y)(z)", r"(x)(?:y)(z)", ["a_b", None]),
    (r"\((?<n>[(]\d\))", r"\(([(]\d\))", ["n"]),
    (r"(?=x)(?!y)(?<=a)(?<!b)(?<ok>c)", r"(?=x)(?!y)(?<=a)(?<!b)(c)", ["ok"]),
    (r"((a)|b)", r"((a)|b)", [None, None]),
    (r"[]()](x)", r"[]()](x)", [None]),
])
def test_split_named_groups(pattern, positional, names):
    assert split_named_groups(pattern) == (positional, names)


def test_names_for_unnamed_groups():
    assert name_groups(r"(\d+) (?<who>\w+) (?:x) (y)") == (r"(\d+) (\w+) (?:x) (y)", ["clientip", "who", "auth"])
    assert name_groups("(a)" * 25)[1][-1] == "field_25"


def test_field_names():
    assert field_name("a", "x", 1) == "a"
    assert field_name(" ", "(?P<g>x)", 2) == "g"
    assert field_name(None, "x", 3) == "field_3"


def test_check_pattern(spark):
    assert check_pattern(spark, r"(?P<a_b>\d+)") is None
    assert check_pattern(spark, "(open") is not None
    assert check_pattern(spark, "a++") is None
    assert check_pattern(spark, "a++", strict=True) is not None


def test_escape_literal():
    assert escape_literal("a.b[c]") == r"a\.b\[c\]"


def test_body_without_captures():
    assert _body_without_captures(r"key=(?<v>a(b)[)]c)") == r"a(?:b)[)]c"
    assert _body_without_captures(r"\d+") == r"\d+"


def test_selected_pattern_with_literal_gaps(spark):
    line = spark.createDataFrame([("ip=1.2.3.4 user=bob end",)], "raw string")
    fields = [Field("user", regex=r"(?<user>bob)"), Field("ip", regex=r"(?<ip>\d+\.\d+\.\d+\.\d+)")]
    found = selected_pattern(line, fields, ["user"], literal_gaps=True)
    assert found.names == ("user",)
    assert found.pattern == r"ip=(?:\d+\.\d+\.\d+\.\d+) user=(bob) end"
    assert X.with_groups(line, found.pattern, found.names).first()["user"] == "bob"
