"""Policies, budgets, prices and schema faults: nulls and limits."""

import json

import pytest
from pyspark.sql import functions as F

from provena.operators import policy


def test_unknown_sensitivity_is_for_nobody(spark):
    df = spark.createDataFrame([("a", "public"), ("b", "restricted"), ("c", None), ("d", "odd")], "source string, sensitivity string")
    assert sorted(map(tuple, policy.readable(df).collect())) == [("demo", "a"), ("demo", "b"), ("viewer", "a")]


@pytest.mark.parametrize(("most", "reserve", "calls", "want"), [
    (10, 4, 99, "yyn yy"),  # the second call may go over; the rest goes to the stage behind
    (10, 99, 99, "nnn yyy"),  # a reserve is never larger than the budget
    (10, -5, 99, "yyy n"), (10, 0, 2, "yyn n"), (0, 0, 99, "nnn n"),
])
def test_budget(spark, most, reserve, calls, want):
    first, then = want.split()
    rows = [(1, "extract", i, 4.0) for i in range(3)] + [(1, "map", i + 10, 1.0) for i in range(len(then))]
    got = policy.within_budget(spark.createDataFrame(rows, "run long, stage string, seq long, cost double"), most, reserve, calls).orderBy("seq").collect()
    assert "".join("y" if r.allowed else "n" for r in got) == first + then


def test_prices_by_longest_name(spark):
    df = spark.createDataFrame([("ab-1", 1_000_000, 0), ("abc-1", 0, 1_000_000), ("z", 1, 1), (None, 1, 1)], "model string, tokens_in long, tokens_out long")
    assert [r.cost for r in policy.priced(df, {"ab": (1, 2), "abc": (3, 4)}).collect()] == [1.0, 4.0, None, None]


@pytest.mark.parametrize(("text", "faults"), [
    (json.dumps({"name": "x", "size": 1.5, "tags": []}), []), (json.dumps({"name": 1}), ["$: 'size' is missing", "$['name']: not of type string"]),
    (json.dumps({"name": "x", "size": 1, "z": 0, "a": 0}), ["$: 'a' is not allowed", "$: 'z' is not allowed"]),
    ("[1]", ["$: not an object"]), ("nonsense", ["$: not an object"]), ("", ["$: not an object"]), (None, ["$: not an object"]),
    (json.dumps({"name": None, "size": 1}), ["$['name']: not of type string"]), ("{}", ["$: 'name' is missing", "$: 'size' is missing"]),
])
def test_schema_faults(spark, text, faults):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(policy.schema_faults(F.col("t"), {"name": "string", "size": "number", "tags": "array"}, ("name", "size")).alias("f"))
    r = r.select("f", policy.repair_prompt(F.lit("ask"), F.lit("said"), F.col("f")).alias("p")).first()
    assert r.f == faults and (r.p is None) == (not faults)


def test_brief_is_checked(spark):
    df = spark.createDataFrame([("A one. B two. C.", "C. A one."), ("A one. B two. C.", "C. D."), ("A one.", None), (None, "A.")], "t string, new string")
    got = [tuple(r.b) for r in df.select(policy.checked_brief(F.array("t"), F.col("new")).alias("b")).collect()]
    assert got == [("C. A one.", False), ("A one. B two.", True), ("A one.", True), ("", True)]


def test_backfill_keeps_what_is_known(spark):
    nodes = spark.createDataFrame([(1, None, "x"), (2, "old", "y"), (3, None, None), (None, None, "z")], "key long, field string, extra string")
    items = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, None), (2, 9, "new"), (7, 1, "q"), (None, 1, "n")], "key long, at long, value string")
    got = sorted(map(tuple, policy.backfill(nodes, items, "field").collect()), key=repr)
    assert got == sorted([(1, "b", "x", True), (2, "old", "y", False), (3, None, None, False), (None, None, "z", False)], key=repr)
