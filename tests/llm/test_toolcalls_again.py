"""Identifiers that a conversation uses again keep every call and result."""

from __future__ import annotations

import json

import pytest

from pvgrid.llm.queries import TOOLS
from pvgrid.llm.toolcalls import link_every_call

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on string"
RESULTS = "conv_id long, call_id string, turn long, content string"


@pytest.mark.parametrize("piece", [2, 4096])
def test_every_call_and_result_is_kept(spark, piece):
    def call(turn, key, i="call_0", needs=None, conv=1):
        return conv, i, turn, "lookup", json.dumps({"key": key}), needs
    calls = [call(1, "one"), call(3, "two"), call(5, "three", needs="call_0"), call(7, "four"), call(7, "five"), call(7, "five"),
             call(2, "other", "x", "call_0"), call(2, "unnamed", None), call(1, "elsewhere", conv=2)]
    results = [(1, "call_0", 4, "for two"), (1, "call_0", 6, "for three"), (1, "call_0", 6, "three again"), (1, "call_0", 8, "B"),
               (1, "call_0", 8, "A"), (1, "call_0", 0, "too early"), (1, "x", 2, None), (1, None, 4, "unnamed"), (None, "call_0", 4, "nowhere"),
               (2, "call_0", None, "no turn"), (2, "y", 1, "lost"), (2, "y", 1, "lost")]
    schemas = spark.createDataFrame(list(TOOLS), "name string, param string, type string, required boolean")
    rows = link_every_call(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas, piece).collect()
    got = set()
    for r in rows:
        made = json.loads(r.canonical_json)
        got.add((r.conv_id, r.call_id, r.turn, made.get("arguments", {}).get("key"), made.get("result"), r.level, r.state, r.n_calls, r.n_results))
    assert len(rows) == len(got) and got == {
        (1, "call_0", 1, "one", None, 0, "unanswered", 1, None), (1, "call_0", 3, "two", "for two", 0, "answered", 1, 1),
        (1, "call_0", 5, "three", "for three", 1, "answered", 1, 1), (1, "call_0", 7, "five", "A", 0, "answered", 2, 1),
        (1, "call_0", 7, "four", "B", 0, "answered", 1, 1), (1, "x", 2, "other", None, 1, "answered", 1, 1),
        (1, None, 2, "unnamed", None, 0, "unanswered", 1, None), (2, "call_0", 1, "elsewhere", "no turn", 0, "answered", 1, 1),
        (1, "call_0", None, None, "three again", None, "orphan_result", None, 1), (1, "call_0", None, None, "too early", None, "orphan_result", None, 1),
        (1, None, None, None, "unnamed", None, "orphan_result", None, 1), (None, "call_0", None, None, "nowhere", None, "orphan_result", None, 1),
        (2, "y", None, None, "lost", None, "orphan_result", None, 2)}


def test_no_rows(spark):
    schemas = spark.createDataFrame(list(TOOLS), "name string, param string, type string, required boolean")
    assert link_every_call(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), schemas).count() == 0
