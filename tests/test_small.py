"""Dates, ids, names, handles, caches and checks that the weak rows of earlier rounds left open."""

import hashlib

import pytest
from pyspark.sql import functions as F

from provena.functions import text as X
from provena.operators import notes, policy, rules
from provena.sources import snapshots


@pytest.mark.parametrize(("raw", "want"), [
    ("2024-03-05", ("2024-03-05", "ok")), ("2024. 3. 5 (화)", ("2024-03-05", "ok")), ("20240305", ("2024-03-05", "ok")), ("2024/3/5 10:00", ("2024-03-05", "ok")), ("2024년 3월 5일", ("2024-03-05", "ok")), ("45356", ("2024-03-05", "ok")),
    ("45356.75", ("2024-03-05", "ok")), ("19999", (None, "unparsable")), ("80001", (None, "unparsable")), ("2024-02-30", (None, "unparsable")), ("20241301", (None, "unparsable")), ("-", (None, "empty")), (" ", (None, "empty")), (None, (None, "empty")),
    ("N/A", (None, "empty")), ("soon", (None, "unparsable")),
])
def test_parse_date(spark, raw, want):
    r = spark.createDataFrame([(raw,)], "x string").select(X.parse_date(F.col("x")).alias("p")).first().p
    assert (r.day and str(r.day), r.state) == want


def test_alpha_digest(spark):
    texts = ["", "a|b", "src!R1", "가나"]

    def brute(t):
        n, out = int(hashlib.sha256(t.encode()).hexdigest(), 16), ""
        for _ in range(24):
            n, r = divmod(n, 26)
            out += chr(97 + r)
        return out

    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", X.alpha_digest(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == {t: brute(t) for t in texts}


def test_organisations_leave_brackets_out(spark):
    r = spark.createDataFrame([("퇴직연금(은행·증권사) (가상)없는보험 KB손해보험",)], "x string").select(X.organisations(F.col("x")).alias("y")).first()
    assert r.y == ["없는보험", "KB손해보험"]


def test_query_code_takes_readers_only(spark):
    df = spark.range(1)
    assert notes.reading(notes.Reader({"t": df})).table("t").count() == 1
    for handle in (notes.Writer({"t": df}), df, None):
        with pytest.raises(TypeError):
            notes.reading(handle)


def test_cache_is_read_before_work(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    ask = lambda *ks: spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "key string, n int")
    one = notes.through_cache(ask("a", "b", "a"), cache, F.concat(F.lit("one "), "key"), "r1").collect()
    assert [(r.key, r.answer, r.cached) for r in sorted(one)] == [("a", "one a", False), ("a", "one a", False), ("b", "one b", False)]
    two = {(r.key, r.answer, r.cached) for r in notes.through_cache(ask("b", "c"), cache, F.concat(F.lit("two "), "key"), "r2").collect()}
    assert two == {("b", "one b", True), ("c", "two c", False)}
    assert {r.key: r.run_id for r in snapshots.read(spark, cache).collect()} == {"a": "r1", "b": "r1", "c": "r2"}
    assert notes.through_cache(ask("a"), cache, F.lit("x"), "r3").first().cached and snapshots.manifest(spark, cache).version == 2


def test_subgraph_faults(spark):
    nodes = spark.createDataFrame([("g", "a", "focal"), ("g", "b", "cited"), ("h", "a", "cited"), ("i", "a", "focal"), *[("k", str(i), "focal") for i in range(5)]], "graph string, key string, rank string")
    edges = spark.createDataFrame([("g", "a", "b"), ("h", "a", "z"), ("h", "a", "y"), ("i", "a", "a")], "graph string, from_key string, to_key string")
    cited = spark.createDataFrame([("g", "b"), ("i", "q")], "graph string, key string")
    assert {(r.graph, r.fault, r.n) for r in rules.subgraph_faults(nodes, edges, cited, most_nodes=4).collect()} == {("h", "no focal", 1), ("h", "dangling", 2), ("i", "marker", 1), ("k", "nodes", 1)}


def test_budget_keeps_calls_of_other_stages(spark):
    calls = spark.createDataFrame([(1, "extract", 1, 1.0), (1, None, 2, 1.0), (1, "chat", 3, 1.0), (1, "map", 4, 1.0)], "run int, stage string, seq int, cost double")
    assert {r.seq: r.allowed for r in policy.within_budget(calls, 10.0, 1.0, 5).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_scrubbed_sentences_and_their_log(spark):
    said = ["Sales were 4,200 in 2024.", "Only 3.7 of it.", "Acme agreed.", "새솔은행과 Zorbex agreed.", "Write to a.b@c.org.", "no claim here."]
    df = spark.createDataFrame([(1, "In Only Sales 4200 of 3.77 Write", "How did Acme do in 2024?", said), (2, None, None, said[-1:]), (3, "x", "y", None)], "doc_id long, support string, question string, sentences array<string>")
    got = {r.doc_id: (r.answer, [(x.sentence, x.numbers, x.terms, x.personal) for x in r.log]) for r in rules.scrubbed(df).collect()}
    assert got[1] == ("Sales were 4,200 in 2024. Acme agreed. no claim here.", [(said[1], ["3.7"], [], []), (said[3], [], ["Zorbex", "새솔은행"], []), (said[4], [], [], ["a.b@c.org"])])
    assert got[2] == ("no claim here.", []) and got[3] == ("", [])


def test_uncited_sentences_go(spark):
    known = [1, 3]
    cases = {
        "Good [1]. Bad [2]. Both [2][3]. None.": ("Good [1].  Both [2][3].  None.", [1, 3], [2]),
        "Bad [9]\nkept 2.85 [9] won? yes [1]": ("yes [1]", [1], [9]), "All good [3][1].": ("All good [3][1].", [3, 1], []), "": ("", [], []), "[7]": ("", [], [7]), "a [12] b [1] c": ("a [12] b [1] c", [1], [12]),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", rules.verified(F.col("t"), F.array(*map(F.lit, known))).alias("v"))
    assert {r.t: (r.v.text, r.v.kept, r.v.dropped) for r in df.collect()} == cases
