"""Semantic traps of the text, JSON and time functions, on literal frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxcart.functions import measures, payload, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_trim_takes_every_kind_of_whitespace(spark):
    rows = [("\t\n a b   ",), ("",), (None,)]
    assert values(spark, rows, "s string", text.trim_space("s")) == [("a b",), ("",), (None,)]


def test_trim_set_strips_letters_not_a_phrase(spark):
    rows = [("Internal Only refunds within 30 days. For use",)]
    notice = "Internal Only For use by the shop"
    got = values(spark, rows, "s string", text.trim_set(F.col("s"), notice))
    assert got == [("funds within 30 days.",)]


def test_capture_without_match_is_null(spark):
    rows = [("gs://b/x007.png",), ("gs://b/x7.png",), ("gs://b/x1007.png",), (None,)]
    got = values(spark, rows, "uri string", text.uri_key("uri"))
    # 1007 is a key of its own, not 007.
    assert got == [("007",), (None,), (None,), (None,)]
    assert values(spark, rows, "uri string", text.uri_key("uri", 4))[2] == ("1007",)
    assert values(spark, rows, "uri string", text.uri_key("uri", tail=True))[2] == ("007",)
    assert values(spark, rows, "uri string", text.uri_key("uri", None)) == [
        ("007",), ("7",), ("1007",), (None,)
    ]


def test_page_number(spark):
    rows = [("gs://b/Policy_Page_03.png",), ("gs://b/Policy_Page_100.png",), ("gs://b/Page_x.png",)]
    got = values(spark, rows, "uri string", text.page_number(F.col("uri")))
    assert got == [(3,), (100,), (None,)]


def test_apostrophes(spark):
    rows = [("I don&#39;t, can&#39;t &#39;",)]
    got = values(spark, rows, "s string", text.unescape_apostrophes(F.col("s")))
    assert got == [("I don't, can't '",)]


def test_clean_page_text(spark):
    got = values(spark, [("• a\n● b",)], "s string", text.clean_page_text(F.col("s")))
    assert got == [(" a  b",)]


@pytest.mark.parametrize(
    "number, expected",
    [(2.0, "2"), (20.0, "20"), (100.5, "100.5"), (0.0, "0"), (1e7, "10000000"), (-3.25, "-3.25")],
)
def test_number_text(spark, number, expected):
    assert values(spark, [(number,)], "x double", text.number_text(F.col("x"))) == [(expected,)]


def test_unquote(spark):
    assert values(spark, [(' "it broke" ',)], "s string", text.unquote(F.col("s"))) == [
        ("it broke",)
    ]


def test_template_is_null_if_a_part_is(spark):
    column = text.fill_template("a {x} b {y}", x=F.col("x"), y=F.col("y"))
    rows = [("1", 2), ("1", None)]
    assert values(spark, rows, "x string, y int", column) == [("a 1 b 2",), (None,)]


DOCUMENT = '{"s":"[1]","a":[1,2],"o":{"x":1},"n":1.0,"z":null,"t":true,"q":"q\\"x"}'


def test_scalar(spark):
    paths = ["s", "a", "o", "n", "z", "t", "q", "none"]
    columns = [payload.scalar(F.col("d"), f"$.{p}").alias(p) for p in paths]
    got = values(spark, [(DOCUMENT,), ("bad",), (None,)], "d string", *columns)
    assert got[0] == ("[1]", None, None, "1.0", None, "true", 'q"x', None)
    assert got[1] == got[2] == (None,) * 8


def test_json_text_keeps_quotes(spark):
    columns = [payload.json_text(F.col("d"), p) for p in ("$.q", "$.a", "$.n", "$.none")]
    got = values(spark, [(DOCUMENT,)], "d string", *columns)
    assert got == [('"q\\"x"', "[1,2]", "1", None)]


def test_strict_string_rejects_other_kinds(spark):
    document = F.try_parse_json("d")
    columns = [payload.strict_string(document, f"$.{p}") for p in ("s", "a", "n", "t", "none")]
    assert values(spark, [(DOCUMENT,)], "d string", *columns) == [("[1]", None, None, None, None)]


@pytest.mark.parametrize(
    "answer, expected",
    [
        ('{"a": 1}', '{"a":1}'),
        ('```json\n{"a": 1}\n```', '{"a":1}'),
        ('Sure! {"a": [1, 2,],}  Bye', '{"a":[1,2]}'),
        ("no json", None),
        (None, None),
    ],
)
def test_repair(spark, answer, expected):
    got = values(spark, [(answer,)], "s string", F.to_json(payload.repaired(F.col("s"))))
    assert got == [(expected,)]


def test_unwrap_parses_json_inside_a_string(spark):
    rows = [('"[{\\"a\\":1}]"',), ('[{"a":1}]',)]
    column = F.to_json(payload.unwrap(F.try_parse_json("s")))
    assert values(spark, rows, "s string", column) == [('[{"a":1}]',), ('[{"a":1}]',)]


def test_vectors(spark):
    rows = [("[[1, 2.5]]",), ("[1, 2.5]",), ("0.5",), (None,)]
    columns = [payload.flat_vector_text(F.col("s")), payload.vector(F.col("s"))]
    assert values(spark, rows, "s string", *columns) == [
        ("[1, 2.5]", [1.0, 2.5]),
        ("[1, 2.5]", [1.0, 2.5]),
        ("[0.5]", [0.5]),
        (None, None),
    ]


def test_whole_minutes_cut_towards_zero(spark):
    rows = [("2024-01-01 00:00:30", "2024-01-01 00:02:20"), ("2024-01-01 00:01:30", "2024-01-01 00:00:00")]
    a, b = F.col("a").cast("timestamp"), F.col("b").cast("timestamp")
    got = values(spark, rows, "a string, b string", measures.whole_minutes(a, b))
    assert got == [(1,), (-1,)]


def test_hours_since(spark):
    start = F.col("a").cast("timestamp")
    column = measures.hours_since(start, measures.instant("2024-01-01 01:40:59"))
    assert values(spark, [("2024-01-01 00:00:00",)], "a string", column) == [(1.67,)]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])]
    column = F.round(measures.cosine(F.col("a"), F.col("b")), 6)
    got = values(spark, rows, "a array<double>, b array<double>", column)
    assert got == [(0.707107,), (None,), (None,)]
