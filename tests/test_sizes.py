"""What large tables need of a plan: nothing that grows goes through the driver or is multiplied before it is cut."""

import re

import pytest
from pyspark.sql import functions as F

from provena.operators import common, expansion, notes, questions
from provena.plans.fixture import Graph
from tests import compare


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["H18_version_misattribution", "Q2_entity_linker"])
@pytest.mark.parametrize("lookup", [common.LOOKUP, 3])
def test_lexicons_not_texts_are_broadcast(spark, smoke, monkeypatch, name, lookup):
    import __spark_entry__ as e

    monkeypatch.setattr(common, "LOOKUP", lookup)
    df = e.queries()[name](spark, smoke)
    said = plan(df)
    assert "BuildLeft" not in said and ("SortMergeJoin" in said) == (lookup == 3) and ("BroadcastHashJoin" in said) == (lookup != 3)
    assert compare.rows(df.toPandas()) == compare.rows(compare.connect(smoke).sql(e.oracle_sql()[name]).df())


def test_phrases_meet_texts_by_two_words(spark):
    texts = spark.createDataFrame([(1, "Red car came in v2! Red: car in v1. Car in v9."), (2, "car"), (3, "A red, big car since v7"), (4, "In v3 red"), (5, None)], "id int, text string")
    f = spark.createDataFrame([("red car", "v1"), ("car", "v3"), ("Red car", "v1"), ("red", "v4")], "name string, introduced_in string").withColumn("name", F.lower("name")).distinct()
    lower = texts.withColumn("text", F.lower("text"))
    got = {(r.id, r.name, r.said) for r in notes.version_claims(lower, f).collect()}
    assert got == {(1, "red car", "v2"), (1, "car", "v2"), (1, "red", "v2"), (1, "car", "v1"), (1, "red", "v1"), (1, "car", "v9"), (3, "car", "v7"), (3, "red", "v7"), (4, "red", "v3")}


@pytest.mark.parametrize("lookup", [common.LOOKUP, 1])
def test_pages_without_pairs(spark, monkeypatch, lookup):
    """Hubs that are linked with each other, loops, repeated edges and edges of several types, each page one row of arrays."""
    monkeypatch.setattr(common, "LOOKUP", lookup)
    hubs = [f"h{i}" for i in range(8)]
    edges = [("T", "A", h, "B", f"{h}-{i:02d}") for h in hubs for i in range(12)] + [("U", "A", a, "A", b) for a in hubs for b in hubs if a <= b]
    edges += [("V", "B", "h0-03", "A", "h1"), ("W", "B", "h0-03", "A", "h1"), ("V", "A", "h1", "B", "h0-03"), ("V", "B", "h0-03", "B", "h0-03"), ("T", "A", "h0", "B", "h0-00"), ("T", "B", "h0-01", "B", "h0-02")]
    e = spark.createDataFrame(edges, "type string, from_label string, from_key string, to_label string, to_key string")
    limit = 6
    nodes = sorted({x[1:3] for x in edges} | {x[3:] for x in edges} | {("A", "nobody")})
    got = {(r.label, r.key): r for r in expansion.pages(e, spark.createDataFrame(nodes, "label string, key string"), limit).collect()}
    assert set(got) == set(nodes)
    near = {n: sorted({b for a, b in [(x[1:3], x[3:]) for x in edges] + [(x[3:], x[1:3]) for x in edges] if a == n != b}, key=lambda m: m[::-1]) for n in nodes}
    for n in nodes:
        first = near[n][:limit]
        two = sorted({m for f in first for m in near[f]} - {n, *first}, key=lambda m: m[::-1])[: limit - len(first)]
        all_ = {n, *first, *two}
        inside = sorted({(x[2], x[4], x[0], x[1], x[3]) for x in edges if x[1:3] in all_ and x[3:] in all_})
        r = got[n]
        assert ([tuple(x)[::-1] for x in r.first], [tuple(x)[::-1] for x in r.two], [tuple(x) for x in r.edges]) == (first, two, inside[: expansion.EDGES])


def test_what_is_collected_for_questions_has_small_plans(spark, smoke):
    """One plan of all branches took over 1.3 GB of a driver; each is stored by a plan of its own."""
    g = Graph(spark, smoke)
    asks = spark.createDataFrame([("a", "Should we visit Customer#000000001?"), ("b", "Which accounts need something?"), ("c", "What is Customer#000000002?")], "item_id string, text string")
    q, rows = questions.answered(g, asks, questions.CORPUS)
    assert {r.stage for r in rows.select("stage").distinct().collect()} >= {"competitor", "capability", "accounts_with_need"}
    for said in map(plan, (q, rows)):
        assert "Join" not in said and "Exchange" not in said


def test_cells_are_dealt_once_to_files_and_once_to_sheets(spark, smoke):
    """Cells went by row, then by sheet, then by file, and by row and by sheet when they were read: five times all of them."""
    import __spark_entry__ as e

    said = plan(e.queries()["S7_weekly_plan"](spark, smoke))
    assert said.count("Exchange hashpartitioning") <= 5  # a customer's orders, files, sheets; two are of merges, which are few
    assert not re.search(r"hashpartitioning\(doc#\d+L, sheet#\d+, row#\d+, \d+\)", said)
