"""Questions: routes, links, and stages of several questions at once; expansion, bundles and audits on inline rows."""

import pytest
from pyspark.sql import functions as F

from provena.operators import expansion, questions
from provena.plans.fixture import Graph
from provena.sources import bundles, tables


@pytest.mark.parametrize(("text", "linked", "want"), [
    ("어느 고객사가 이 문제를 겪나?", True, ("Q-M", "template:accounts_with_need")), ("어떤 산업이 이 역량을 쓰나?", False, ("Q-M", "template:industries_using_capability")), ("사업영역별 딜은?", False, ("Q-M", "template:deals_by_domain")),
    ("이 기능은 언제부터 있나?", False, ("Q-E", "template:feature_version_history")), ("어떻게 접근하면 좋을까?", True, ("Q-S", "signal:strategic:advice")), ("확장될 가능성이 높은 것은?", False, ("Q-S", "signal:strategic:outlook")),
    ("가나은행은 무엇인가?", True, ("Q-E", "signal:fact:what_is")), ("가나은행 이야기", True, ("Q-E", "signal:entity_linked")), ("그냥 이야기", False, ("Q-E", "no_rule_matched")), ("", False, ("Q-E", "no_rule_matched")),
])
def test_routes(spark, text, linked, want):
    df = spark.createDataFrame([(text, linked)], "t string, l boolean")
    assert tuple(df.select(questions.route(F.col("t"), F.col("l"), questions.KOREAN).alias("r")).first().r) == want


def test_links_prefer_longer_names_and_whole_words(spark):
    lex = spark.createDataFrame([("Account", "가나 은행", "가나 은행", 0), ("Account", "가나", "가나", 0), ("Need", "n1", "Red Car", 1), ("Need", "n2", "car", 1), ("Need", "n3", "", 1)], "label string, key string, surface string, priority int")
    qs = spark.createDataFrame([(1, "가나 은행, red  car?"), (2, "가나은행 cars"), (3, None), (4, "CAR / 가나")], "item_id int, text string")
    got = {}
    for r in questions.link(qs, lex).orderBy("item_id", "pos").collect():
        got.setdefault(r.item_id, []).append(r.key)
    assert got == {1: ["가나 은행", "n1"], 4: ["가나", "n2"]}


def test_guesses_never_narrow_a_strategic_question(spark, smoke):
    g = Graph(spark, smoke)
    said = g.documents.orderBy("doc_id").first().text.split()[:3]
    asked = [("guess", "should we " + " ".join(said)), ("named", "should we visit " + g.account.orderBy("custkey").first().account)]
    qs = spark.createDataFrame(asked, "item_id string, text string")
    q, rows = questions.answered(g, qs, questions.CORPUS)
    match = {r.item_id: (r.match, r.route) for r in q.collect()}
    assert match["guess"] == ("fulltext", "Q-S") or match["guess"] == ("none", "Q-S")
    assert match["named"] == ("exact", "Q-S")
    stages = {(r.item_id, r.stage): (r.n, r.relaxed) for r in rows.groupBy("item_id", "stage").agg(F.count("*").alias("n"), F.max("relaxed").alias("relaxed")).collect()}
    # a guess brings no deals and no evidence of its own, and all stages are filled up
    assert ("guess", "account_deal") not in stages and ("guess", "evidence") not in stages
    assert stages["guess", "capability"][1] and stages["guess", "business_domain"] == (25, True)
    assert stages["named", "competitor"][0] > 0


EDGE = "type string, from_label string, from_key string, to_label string, to_key string"


def test_one_hop_keeps_to_its_budget(spark):
    e = spark.createDataFrame([("T", "A", "hub", "B", f"n{i:03d}") for i in range(200)] + [("U", "B", "n000", "A", "hub"), ("T", "A", "hub", "A", "hub"), ("T", "A", "hub", "B", "n001")], EDGE)
    seeds = [("a", "A", "hub", 0), ("b", "A", "hub", 148), ("c", "A", "hub", 150), ("d", "B", "n000", 0), ("e", "A", "nobody", 0)]
    s = spark.createDataFrame(seeds, "seed string, label string, key string, already int")
    got = {r.seed: r for r in expansion.one_hop(e, s).collect()}
    assert [len(got[k].nodes) for k in "abcde"] == [30, 1, 0, 1, 0]  # of the four rows that b looks at, two are the loop
    assert [got[k].truncated for k in "abcde"] == [True, True, True, True, False]  # two edges lead to the one node of d
    for k in "ab":
        keys = {n.key for n in got[k].nodes} | {"hub"}
        assert all(x.from_key in keys and x.to_key in keys for x in got[k].edges) and "hub" not in {n.key for n in got[k].nodes}
    with pytest.raises(ValueError, match="one hop"):
        expansion.one_hop(e, s, hops=2)


def neighbourhood_brute(edges, seed, limit):
    near = {}
    for _, fl, fk, tl, tk in edges:
        near.setdefault((fl, fk), set()).add((tl, tk))
        near.setdefault((tl, tk), set()).add((fl, fk))
    by = lambda ns: sorted(ns, key=lambda n: (n[1], n[0]))
    one = by(near.get(seed, set()) - {seed})[:limit]
    known = {seed, *one}
    two = by({m for n in one for m in near[n]} - known)[: limit - len(one)]
    nodes = known | set(two)
    inside = sorted({(fk, tk, t, fl, tl) for t, fl, fk, tl, tk in edges if (fl, fk) in nodes and (tl, tk) in nodes})
    return [(n, 1) for n in one] + [(n, 2) for n in two], inside[: expansion.EDGES]


@pytest.mark.parametrize("limit", [4, 24])
def test_neighbourhood_brute_force(spark, limit):
    import random

    rng = random.Random(4)
    edges = [(rng.choice("TU"), rng.choice("AB"), f"k{rng.randrange(30)}", rng.choice("AB"), f"k{rng.randrange(30)}") for _ in range(90)] + [("T", "A", "hub", "B", f"x{i}") for i in range(70)] + [("T", "A", "k1", "A", "hub")]
    e = spark.createDataFrame(edges, EDGE)
    seeds = sorted({(a, b) for _, a, b, _, _ in edges} | {("A", "nobody")})
    s = spark.createDataFrame([(f"{a}{b}", a, b) for a, b in seeds], "seed string, label string, key string")
    rows = expansion.neighbourhood(e, s, limit).collect()
    for a, b in seeds:
        mine = [r for r in rows if r.seed == f"{a}{b}"]
        nodes = {((r.label, r.key), r.hop) for r in mine if r.kind == "node" and r.hop}
        want, inside = neighbourhood_brute(edges, (a, b), limit)
        assert nodes == set(want)
        assert sorted((r.key, r.to_key, r.type) for r in mine if r.kind == "edge") == sorted(x[:3] for x in inside)


@pytest.mark.parametrize(("pattern", "yes", "no"), [
    ("*.md", ["a.md"], ["x/a.md", "a.mdx"]), ("**/*.md", ["a.md", "x/a.md", "x/y/a.md"], ["a.txt"]), ("x/**/y?.[ab]c", ["x/y1.ac", "x/q/r/y2.bc"], ["x/y.ac", "x/y1.cc"]), ("[!a]*", ["b"], ["a", "b/c"]), ("a+b(c)", ["a+b(c)"], ["aab(c)"]),
])
def test_globs(spark, pattern, yes, no):
    import re

    assert all(re.fullmatch(bundles.glob_pattern(pattern), p) for p in yes) and not any(re.fullmatch(bundles.glob_pattern(pattern), p) for p in no)


def test_bundles(spark):
    files = spark.createDataFrame([(p,) for p in ("/r/a/one.md", "/r/a/deep/two.md", "/r/b/Three x.md", "/r/b/skip/four.md", "/r/five.txt", "/q/six.md", "/r/own.md")], "path string")
    own = spark.createDataFrame([("own", "/r/own.md", "paper")], "id string, path string, source_type string")
    b = {"id": "r", "root": "/r/", "include": "**/*.md", "id_prefix": "src", "exclude": ["b/skip/**"], "source_type": "note", "overrides": [{"match": "a", "sensitivity": "high"}, {"match": "two.md", "sensitivity": "low", "source_type": "memo", "reason": "old"}]}
    got = {r.id: (r.path, r.source_type, r.sensitivity, r.override_reason) for r in bundles.sources(files, own, [b]).collect()}
    assert got == {"own": ("/r/own.md", "paper", None, None), "src_a_one": ("/r/a/one.md", "note", "high", None), "src_a_deep_two": ("/r/a/deep/two.md", "memo", "low", "old"), "src_b_three_x": ("/r/b/Three x.md", "note", None, None)}
    with pytest.raises(FileNotFoundError):
        bundles.sources(files, own, [b | {"root": "/nowhere"}])
    assert bundles.sources(files, own, [b | {"root": "/nowhere", "optional": True}]).count() == 1
    clash = spark.createDataFrame([("/r/x.md",), ("/r/x.v.md",), ("/r/X.md",)], "path string")
    with pytest.raises(ValueError, match="src_x"):
        bundles.sources(clash, own, [b])


CELL = "doc int, sheet string, row int, col int, value string, own boolean"


def test_heading_search_and_row_texts(spark):
    rows = [(1, "s", 1, 1, "A long title that says what the table below it is about", True), (1, "s", 1, 2, "x", True), (1, "s", 3, 1, "lone", True), (1, "s", 4, 1, "name", True), (1, "s", 4, 3, " kind ", True),
            (1, "s", 5, 1, "ball", True), (1, "s", 5, 2, "b", True), (1, "s", 5, 3, "toy", True), (1, "s", 6, 1, "ba ll", True), (1, "s", 6, 2, "b", True), (1, "s", 6, 3, "toy", True), (1, "s", 7, 1, "ball", False), (1, "s", 7, 3, "game", True), (2, "t", 1, 1, "only", True)]
    got = {(r.doc, r.locator): r.text for r in tables.table_rows(spark.createDataFrame(rows, CELL)).collect()}
    assert got == {(1, "s!R5"): "name: ball | B: b | kind: toy", (1, "s!R7"): "name: ball | kind: game", (2, "t!R1"): "A: only"}


def test_audit_finds_planted_gaps_only(spark):
    c = [(1, "s", 1, 1, "name", True), (1, "s", 1, 2, "note", True)]
    c += [(1, "s", r, k, v, True) for r, vs in {2: ("ball", "round thing"), 3: ("cube", "lost words"), 4: ("cone", "ball"), 5: ("1234", "-"), 6: ("tel", "a@b.com")}.items() for k, v in enumerate(vs, 1)]
    e = [(1, "s", 2, "name: ball | note: round thing"), (1, "s", 3, "name: cube"), (1, "s", 5, "name: 1,234"), (1, "s", 6, "name: tel")]
    got = {(r.row, r.col): r.state for r in tables.audit(spark.createDataFrame(c, CELL), spark.createDataFrame(e, "doc int, sheet string, row int, text string")).collect()}
    assert got == {(2, 1): "covered", (2, 2): "covered", (3, 1): "covered", (3, 2): "missing", (4, 1): "orphan", (4, 2): "merged", (5, 1): "covered", (5, 2): "trivial", (6, 1): "covered", (6, 2): "masked"}


def test_places_in_groups_by_one_window(spark):
    from pyspark.sql import Window

    from provena.operators.selection import numbered

    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 5}", (i * 37) % 101, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(7)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("k", "i")))
    got = numbered(df, "g", ["k", "i"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert numbered(df.limit(0), "g", ["k", "i"]).count() == 0


@pytest.mark.parametrize("text, linked, choice, want", [
    ("어떤 고객사가 요청했나", False, None, ("Q-M", "template", "template:accounts_with_need", "accounts_with_need", ["accounts_with_need"])),
    ("여러 BD에 걸친 공통 니즈", False, None, ("Q-E", "default", "no_rule_matched", None, [])),  # no word BD
    ("여러 BD 에 걸친 공통 니즈", False, None, ("Q-M", "template", "template:common_needs_across_domains", "common_needs_across_domains", ["common_needs_across_domains"])),
    ("전망과 전략이 무엇인가", True, "Q-M", ("Q-S", "signal", "signal:strategic:outlook", None, ["outlook", "portfolio"])),
    ("이것은 무엇인가", False, "Q-S", ("Q-E", "signal", "signal:fact:what_is", None, ["what_is"])), ("Acme", True, "Q-S", ("Q-E", "signal", "signal:entity_linked", None, ["entity_linked"])),
    ("Acme", False, "Q-S", ("Q-S", "fallback", "classifier", None, [])), ("Acme", False, "maybe", ("Q-E", "default", "classifier_rejected", None, [])),
    ("Acme", False, None, ("Q-E", "default", "no_rule_matched", None, [])), (None, False, None, ("Q-E", "default", "no_rule_matched", None, [])),
])
def test_routes_in_three_steps(spark, text, linked, choice, want):
    from provena.operators.questions import KOREAN, decide

    df = spark.createDataFrame([(text, linked, choice)], "t string, l boolean, c string")
    assert tuple(df.select(decide(F.col("t"), F.col("l"), KOREAN, F.col("c")).alias("d")).first().d) == want


def test_needs_of_several_domains_answer_their_template(spark, smoke):
    from provena.operators.templates import common_needs

    g = Graph(spark, smoke)
    asks = spark.createDataFrame([("1", "여러 도메인의 공통 니즈"), ("2", "어느 고객사인가"), ("3", "공통 니즈, 도메인 여러 곳")], "item_id string, text string")
    q, rows = questions.answered(g, asks)
    got = [tuple(r) for r in rows.where("stage = 'common_needs_across_domains'").select("item_id", "pos", "key").collect()]
    want = [r.need for r in common_needs(g, limit=questions.OF_TEMPLATE).collect()]
    assert want and sorted(got) == sorted((i, n, k) for i in "13" for n, k in enumerate(want, 1))
    assert {r.item_id for r in rows.where("stage = 'accounts_with_need'").collect()} == {"2"}


@pytest.mark.parametrize(("text", "want"), [
    ("Doñas ósa", ("Q-E", "signal:fact:yes_no")), ("dote", ("Q-E", "no_rule_matched")), ("show ñhow now", ("Q-E", "signal:fact:how")), ("showñ", ("Q-E", "no_rule_matched")),
    ("list fór", ("Q-E", "no_rule_matched")), ("list ñfor", ("Q-M", "template:listing")), ("list for_", ("Q-E", "no_rule_matched")), ("가can", ("Q-E", "no_rule_matched")), ("can가", ("Q-E", "signal:fact:yes_no")),
])
def test_bounds_of_rules_are_those_of_ascii_words(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(questions.route(F.col("t"), F.lit(False), questions.TALK).alias("r")).first().r) == want
