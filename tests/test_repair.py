"""Damaged JSON, one kind of damage at a time, and noise."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxcart.functions import payload, repair
from voxcart.functions.repair import repair_json

CASES = [
    ('{"a": 1}', {"a": 1}),
    ('Sure:\n```json\n{"a": [1, 2,],}\n``` bye', {"a": [1, 2]}),
    ("{'a': 'it's', 'b': 'x'}", {"a": "it's", "b": "x"}),
    ("{“a”: “b”}", {"a": "b"}),
    ('{a: 1, b_c: "x", d: some words}', {"a": 1, "b_c": "x", "d": "some words"}),
    ('{"a": "line\nline\ttab"}', {"a": "line\nline\ttab"}),
    ('{"a": 1 "b": 2\n"c": [1 2 "x"]}', {"a": 1, "b": 2, "c": [1, 2, "x"]}),
    ('{"a": "say "hi" to, them"}', {"a": 'say "hi" to, them'}),
    ('{"a": "cut off he', {"a": "cut off he"}),
    ('{"a": {"b": [1, {"c": 2', {"a": {"b": [1, {"c": 2}]}}),
    ('{"a": 1, "b', {"a": 1, "b": None}),
    ('{"a": 1, "b":', {"a": 1, "b": None}),
    ('{"a": True, "b": None, "c": NaN}', {"a": True, "b": None, "c": None}),
    ('{"a": .5, "b": +1, "c": 1., "d": 1e3}', {"a": 0.5, "b": 1.0, "c": 1.0, "d": 1000.0}),
    (r'{"a": "\q \' é \u12"}', {"a": "q ' é u12"}),
    ('{"a": 1, // note\n /* more */ "b": 2}', {"a": 1, "b": 2}),
    ('{"a": [1, 2}', {"a": [1, 2]}),
    ('{"a": 1}}} trailing {"b": 2}', {"a": 1}),
    ("[1, 'x'", [1, "x"]),
    ('{"url": "http://x/y", u: 2}', {"url": "http://x/y", "u": 2}),
    ("{}", {}),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_each_kind(text, expected):
    assert json.loads(repair_json(text)) == expected


@pytest.mark.parametrize("text", [None, "", "no json at all", "{" * 501])
def test_nothing_to_read(text):
    assert repair_json(text) is None


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(max_size=12),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=6), inner, max_size=4),
    max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(max_size=6), VALUES, max_size=4), st.integers(0, 400))
def test_whole_json_is_kept_and_any_cut_can_be_read(value, cut):
    whole = json.dumps(value)
    assert json.loads(repair_json(whole)) == value
    json.loads(repair_json(whole[: max(1, cut % (len(whole) + 1))]))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="{}[]:,\"'\\ \nab1-.e/*“”tu", max_size=40))
def test_noise_gives_json_or_nothing(text):
    found = repair_json(text)
    assert found is None or json.loads(found) is not None


def test_only_damaged_rows_reach_the_automaton(spark):
    rows = [(t,) for t, _ in CASES] + [(None,), ("nothing",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(F.to_json(payload.repaired(F.col("s")))).collect()]
    assert [None if g is None else json.loads(g) for g in got] == [e for _, e in CASES] + [None, None]


def test_very_long_text(spark):
    text = '{"a": "' + "x\n" * 200_000 + '", "b": 1'
    assert json.loads(repair_json(text))["b"] == 1


def test_plain_text_is_taken_in_runs(monkeypatch):
    calls = []
    dumps = repair.json.dumps
    monkeypatch.setattr(repair.json, "dumps", lambda *a, **k: calls.append(a) or dumps(*a, **k))
    body = "it's é plain " * 100
    assert repair.repair_json("{'a': '" + body + "'}") == '{"a":"' + body + '"}'
    assert len(calls) <= body.count("'")
