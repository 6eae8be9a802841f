"""Chats against SQL, hand-made cases and the rules of canonical JSON."""

import json

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarrymill.llm import chat

SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": ["number", "null"], "maximum": 9}, "u": {"enum": ["x", 1]}}, "required": ["a"], "additionalProperties": False}}


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    got = sorted(map(tuple, chat.op7_chat(spark, d).collect()), key=str)
    duckdb.sql(f"create or replace view conversations as select * from '{d}/conversations.parquet'")
    assert got == sorted(duckdb.sql(chat.OP7_SQL).fetchall(), key=str)


def events(spark, rows, links=chat.LINKS):
    return chat.linked(spark.createDataFrame(rows, chat.EVENT), SCHEMAS, links).orderBy("conv_id", "position").collect()


def test_chains_of_any_length(spark):
    """70 calls, each to come after the next later one: the order turns round, and nothing is called a circle."""
    rows = [(1, 2 * i, "call", f"k{i}", "add", '{"a": 1}', [f"k{i + 1}"] if i < 69 else None) for i in range(70)]
    rows += [(1, 2 * i + 1, "result", f"k{i}", None, "", None) for i in range(70)]
    rows += [(2, 0, "call", "x", "add", "{}", ["y"]), (2, 1, "call", "y", "add", "{}", ["x"]), (2, 2, "result", "x", None, "", None), (2, 3, "result", "y", None, "", None)]
    out = events(spark, rows)
    own = [r for r in out if r.conv_id == 1]
    assert [(r.kind, r.id) for r in own] == [(k, f"k{i}") for i in range(69, -1, -1) for k in ("call", "result")]
    assert not any(r.cyclic for r in own) and all(r.cyclic for r in out if r.conv_id == 2)


def test_both_ways_of_ordering_agree(spark):
    rows = []
    for c in range(6):
        for i in range(5):
            rows += [(c, (7 * i + c) % 11, "call", f"k{i}", "add", "{}", [f"k{(i * (c + 2) + 1) % 6}", "none"] if i else None), (c, (3 * i + c) % 11, "result", f"k{i}", None, "", None)]
    a, b = events(spark, rows), events(spark, rows, links=0)
    assert a == b and any(r.cyclic for r in a) and any(not r.cyclic for r in a)


def test_order_links_and_checks(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 2)
    rows = [
        (1, 0, "result", "r1", None, "early", None), (1, 1, "message", None, "user", "hi", None), (1, 2, "call", "r1", "add", '{"b": 1.0, "a": 2}', ["r2"]),
        (1, 3, "call", "r2", "add", '{"a": true}', None), (1, 4, "result", "r2", None, "x", None), (1, 5, "result", "none", None, "?", None), (1, None, "message", None, "user", None, None),
        (2, 0, "call", "p", "add", "{", ["q"]), (2, 1, "call", "q", "sub", "{}", ["p"]), (2, 2, "result", "p", None, "", None), (2, 3, "result", "q", None, "", None),
        (None, 0, "call", None, "add", '{"a":1,"a":2}', None),
    ]
    out = events(spark, rows)
    own = [r for r in out if r.conv_id == 1]
    assert [r.position for r in own] == list(range(7))
    assert [(r.kind, r.id) for r in own] == [("message", None), ("call", "r2"), ("result", "r2"), ("call", "r1"), ("result", "r1"), ("result", "none"), ("message", None)]
    by = {(r.kind, r.id): r for r in own}
    assert by["result", "r1"].linked and by["result", "r1"].call_turn == 2 and not by["result", "none"].linked
    assert by["call", "r1"].valid and by["call", "r1"].json == '{"arguments":{"a":2,"b":1},"id":"r1","name":"add","type":"call"}'
    assert not by["call", "r2"].valid and by["call", "r2"].errors == "$.a: not integer"
    two = [r for r in out if r.conv_id == 2]
    assert {r.id for r in two if r.cyclic} >= {"p", "q"} and [r.position for r in two] == [0, 1, 2, 3]
    assert [r.errors for r in two if r.kind == "call"] == ["$: not JSON (JSONDecodeError)", "no tool sub"]
    last = [r for r in out if r.conv_id is None]
    assert len(last) == 1 and not last[0].valid and not last[0].linked


def test_edges(spark):
    df = spark.createDataFrame([(1, 0, "user", None, 1), (1, 0, "user", None, 1), (1, 1, "assistant", "é\n\"\u2028", 1), (2, None, None, "x", 1), (3, 1, "assistant", "y" * 100_000, 1)], "conv_id long, turn long, role string, text string, position int")
    out = chat.linked(chat.turns(df), chat.REPLY).collect()
    assert len(out) == 5 and sorted(r.position for r in out if r.conv_id == 1) == [0, 1, 2]
    assert [r.json for r in out if r.kind == "result" and r.conv_id == 1] == ['{"call_id":"call-0","content":"é\\n\\"\u2028","type":"result"}']
    assert chat.linked(chat.turns(df.where("false")), chat.REPLY).count() == 0


@pytest.mark.parametrize("value,text", [(1e30, "1e+30"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (0.000001, "0.000001"), (1e-7, "1e-7"), (1.5e-9, "1.5e-9"), (0.00002, "0.00002"), (-0.0, "0"), (4.5, "4.5"), (2**60, str(2**60)), (333333333.3333333, "333333333.3333333"), (1e23, "1e+23")])
def test_numbers(value, text):
    assert chat.canonical(value) == text


def test_keys_by_utf16():
    assert chat.canonical({"\ufb33": 1, "\U0001f600": 2, "é": 3, "1": 4, "\r": 5}) == '{"\\r":5,"1":4,"é":3,"\U0001f600":2,"\ufb33":1}'


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)))
def test_canonical_round_trip(value):
    text = chat.canonical(value)
    assert json.loads(text) == value and chat.canonical(chat.parse(text)) == text
