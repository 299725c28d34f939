"""Rule engines on inline rows: gaps, criticality, contradictions, and the tagger under them."""

import itertools

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from provena.operators import criticality, disputes, gaps, tagging

# tagging


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab.c", min_size=1, max_size=4), min_size=1, max_size=6), st.text(alphabet="ab.c", max_size=12))
def test_tree_pattern_finds_the_longest_phrase_at_each_place(phrases, text):
    import re

    got = [m for m in re.findall(f"(?=({tagging.tree_pattern(phrases)}))", text)]
    want = [max((p for p in phrases if text.startswith(p, i)), key=len, default=None) for i in range(len(text))]
    assert got == [w for w in want if w]


def test_found_phrases_with_overlaps_and_prefixes(spark):
    phrases = ["ab", "abc", "bc", "c d", "x.y", "지원 불가", "지원"]
    texts = ["abcd", "c d", "xzy", "x.y ab", "모두 지원 불가함", "", "ababc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", F.array_sort(tagging.found_phrases(F.col("t"), phrases)).alias("p")).collect()
    assert {r.t: r.p for r in got} == {t: sorted(p for p in phrases if p in t) for t in texts}


@pytest.mark.parametrize("in_plan", [5000, 0])
def test_on_topic_brute_force(spark, monkeypatch, in_plan):
    from provena.functions import text as X

    monkeypatch.setattr(tagging, "KEYS_IN_PLAN", in_plan)
    texts = [(1, "Guest 통제가 어렵다"), (2, "guests may leave; 통제"), (3, "PDF 다운로드 (모바일)"), (4, None), (5, "a b c"), (6, "Pdf는 모바일에서"), (7, "x퇴직연금x guest2 2guest")]
    asks = [(1, ["guest", "통제"]), (2, ["모바일", "pdf", "다운로드"]), (3, []), (4, ["b"]), (5, ["퇴직연금", "guest2"]), (6, ["통제가", "guest", "없음"]), (7, None)]
    d = spark.createDataFrame(texts, "evidence_id int, text string")
    q = spark.createDataFrame(asks, "item_id int, terms array<string>")
    got = {(r.item_id, r.evidence_id): r.hits for r in tagging.on_topic(d, q, 2).collect()}
    full = q.join(d).select("item_id", "evidence_id", F.size("terms").alias("n"), F.size(X.overlap(F.col("terms"), F.col("text"))).alias("hits")).collect()
    assert got == {(r.item_id, r.evidence_id): r.hits for r in full if (r.n or 0) > 0 and r.hits >= min(2, r.n)}
    assert len(got) >= 5


# gaps


EVIDENCE = "evidence_id string, snippet string, source_type string, role string"
LIMITS = "고객이 겪는 제약과 그 사유"


def found(spark, subject, scan, needs=(), capabilities=()):
    q = spark.createDataFrame([(1, subject)], "item_id int, text string")
    e = spark.createDataFrame(list(scan), EVIDENCE)
    link = lambda ids: spark.createDataFrame([(1, i) for i in ids], "item_id int, evidence_id string")
    return gaps.assess(q, e, link(needs), link(capabilities)).first()


SAYS = ("a1", "화면 녹화 다운로드는 보안 사유로 지원 불가", "memo", LIMITS)


@pytest.mark.parametrize(("case", "subject", "scan", "needs", "verdict", "out"), [
    ("a missing link alone never confirms", "외부 상담원 화면 통제 기능", [("n1", "외부 상담원 화면 통제를 못하고 있다", "memo", None)], ["n1"], "POSSIBLE", False),
    ("an excerpt that says so confirms", "화면 녹화 다운로드", [SAYS], ["n1"], "CONFIRMED", False),
    ("an unauthorised source doesn't", "화면 녹화 다운로드", [("a1", SAYS[1], "chat", "")], ["n1"], "POSSIBLE", False),
    ("a type may be authority enough", "화면 녹화 다운로드", [("a1", SAYS[1], "release_spec", None)], [], "CONFIRMED", False),
    ("another subject doesn't leak in", "보험 설계사 일정 공유", [SAYS], ["n1"], "POSSIBLE", False),
    ("one shared term isn't the subject", "녹화 설계사 일정", [SAYS], [], "UNKNOWN", False),
    ("nothing to judge", "들어 본 적 없는 주제", [], [], "UNKNOWN", False),
    ("out of scope blocks confirmation", "화면 녹화 다운로드", [SAYS, ("o1", "화면 녹화 다운로드가 기술적으로는 가능합니다", "memo", None)], ["n1"], "POSSIBLE", True),
    ("out of scope without a need", "화면 녹화 보관", [("o1", "화면 녹화 보관을 위한 시스템이 아닙니다", "memo", None)], [], "UNKNOWN", True),
    ("a lost deal is direct evidence", "화면 녹화 다운로드", [("l1", "화면 녹화 다운로드가 없어 수주 실패", "memo", LIMITS)], [], "CONFIRMED", False),
    ("a need in the text counts where none is linked", "화면 녹화 다운로드", [("n2", "화면 녹화 다운로드 요청이 많다", "chat", None)], [], "POSSIBLE", False),
])
def test_gaps(spark, case, subject, scan, needs, verdict, out):
    f = found(spark, subject, scan, needs)
    assert (f.verdict, f.out_of_scope) == (verdict, out), case
    assert bool(f.absence_ids) == (verdict == "CONFIRMED")


def test_gaps_ids_ties_and_odd_rows(spark):
    f = found(spark, "화면 녹화 다운로드", [SAYS, ("a0", *SAYS[1:]), SAYS, ("x", None, None, None), ("n2", "화면 녹화 요청", None, None)], [], ["c2", "c1", "c2"])
    assert (f.verdict, f.absence_ids, f.need_ids, f.need_from_text, f.capability_ids) == ("CONFIRMED", ["a0", "a1"], ["n2"], True, ["c1", "c2"])
    assert found(spark, "은 는 이", [SAYS], []).verdict == "UNKNOWN" and found(spark, None, [SAYS], ["n"]).verdict == "POSSIBLE"


# criticality


FIELDS = "kind string, text string, amount_krw double, amount_raw string, outcome string, stage_value string, account_canonical string, subject_key string, statement string, observed_at string"


def fired(spark, rules=criticality.RULES, **values):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    df = spark.createDataFrame([tuple(({"text": "", "kind": "Observation", "observed_at": "2024"} | values).get(n) for n in names)], FIELDS)
    r = criticality.evaluate(df, rules).first()
    return r.fired, r.lanes, r.escalating


@pytest.mark.parametrize(("values", "ids"), [
    ({"kind": "Deal", "amount_krw": 3e8}, ["CR-HIGH-VALUE-DEAL"]), ({"kind": "Deal", "amount_krw": 299999999.0}, []), ({"kind": "Evidence", "amount_krw": 9e8}, []),
    ({"kind": "Deal", "amount_raw": "0.8"}, ["CR-AMOUNT-UNPARSEABLE"]), ({"kind": "Deal", "amount_raw": ""}, []), ({"kind": "Deal", "amount_raw": "1억", "amount_krw": 1e8}, []),
    ({"kind": "Deal", "outcome": "lost"}, ["CR-LOST-DEAL"]), ({"kind": "Deal", "outcome": "won"}, []), ({"kind": "Deal", "stage_value": "실패"}, ["CR-LOST-DEAL"]), ({"kind": "Claim", "outcome": "lost"}, []),
    ({"kind": "Evidence", "text": "망분리 환경에서"}, ["CR-REGULATION-SECURITY"]), ({"kind": "Evidence", "text": "망 분리"}, []),
    ({"account_canonical": "두레은행"}, ["CR-STRATEGIC-ACCOUNT"]), ({"account_canonical": "두레"}, []), ({"account_canonical": ""}, []),
    ({"text": "자체 구축 ARR"}, ["CR-COMPETITOR-REPLACEMENT", "CR-RARE-TECH"]), ({"text": "임원 보고가 필요, 변경이 불가"}, ["CR-EXEC-SIGNAL", "CR-EXPLICIT-ABSENCE"]),
    ({"kind": "Evidence", "text": "예상 답변"}, ["CR-AI-FAILURE"]), ({"kind": "Claim", "text": "예상 답변"}, []),
    ({"statement": "월 3500건", "observed_at": None}, ["CR-NO-OBSERVED-AT"]), ({"statement": "월 3500건"}, []), ({"statement": "많다", "observed_at": None}, []),
])
def test_twelve_rules(spark, values, ids):
    assert fired(spark, **values)[0] == ids


def test_lanes_and_status(spark):
    assert fired(spark, subject_key="BD_개수") == (["CR-CONTRADICTION-SEED"], ["conflict"], [])
    assert fired(spark, statement="1", observed_at=None) == (["CR-NO-OBSERVED-AT"], [], [])
    assert fired(spark, subject_key="BD_개수", account_canonical="두레은행", text="VDI") == (["CR-REGULATION-SECURITY", "CR-STRATEGIC-ACCOUNT", "CR-CONTRADICTION-SEED"], ["critical", "conflict"], ["CR-REGULATION-SECURITY", "CR-STRATEGIC-ACCOUNT"])
    df = spark.createDataFrame([(["x"], True), (["x"], False), ([], True)], "e array<string>, ok boolean")
    assert [r.s for r in df.select(criticality.raised(F.lit("VERIFIED"), F.col("e"), F.col("ok")).alias("s")).collect()] == ["CRITICAL", "UNVERIFIED", "VERIFIED"]


def test_nested_unknown_and_odd_conditions(spark):
    rules = [
        {"id": "nested", "applies_to": ["Deal"], "condition": {"all_of": [{"any_of": [{"field": "outcome", "operator": "==", "value": "lost"}, {"text_contains_any": ["x"]}]}, {"field": "amount_krw", "operator": "is_null"}]}},
        {"id": "unknown test", "applies_to": ["Deal"], "condition": {"sounds_like": "x"}}, {"id": "unknown operator", "applies_to": ["Deal"], "condition": {"field": "outcome", "operator": "~", "value": "x"}},
        {"id": "empty", "applies_to": ["Deal"], "condition": {}}, {"id": "no field", "applies_to": ["Deal"], "condition": {"field": "nowhere", "operator": "is_null"}},
        {"id": "text is no number", "applies_to": ["Deal"], "condition": {"field": "outcome", "operator": ">=", "value": 1}}, {"id": "none", "applies_to": [], "condition": {"text_contains_any": ["x"]}},
    ]
    assert fired(spark, rules, kind="Deal", text="x")[0] == ["nested", "no field"]
    assert fired(spark, rules, kind="Deal", text="x", amount_krw=1.0)[0] == ["no field"]
    assert fired(spark, rules, kind="Deal", outcome="2")[0] == ["no field", "text is no number"]


def test_rules_of_a_table_and_large_sets_are_joined(spark):
    many = [f"account {i}" for i in range(50)]
    rules = [{"id": "many", "applies_to": ["Deal"], "condition": {"any_of": [{"account_canonical_in": many}, {"field": "amount_krw", "operator": "in", "value": [float(i) for i in range(40)]}]}}]
    rows = [("Deal", "account 7", None), ("Deal", "account 77", 39.0), ("Deal", None, 40.0), ("Claim", "account 7", 1.0)]
    df = spark.createDataFrame(rows, "kind string, account_canonical string, amount_krw double").withColumn("text", F.lit(None).cast("string"))
    for limit in (1000, 5):
        out = criticality.evaluate(df, criticality.rule_table(spark, rules), set_in_plan=limit)
        assert [r.fired for r in out.collect()] == [["many"], ["many"], [], []] or sorted(map(str, (r.fired for r in out.collect()))) == ["['many']", "['many']", "[]", "[]"]
        assert out.columns == ["kind", "account_canonical", "amount_krw", "text", "fired", "lanes", "escalating"]
    assert "Join" in criticality.evaluate(df, rules, set_in_plan=5)._jdf.queryExecution().toString()


# contradictions


ASKS = "그 사고의 과징금 규모는 얼마인가?"


def told(spark, question, rows, terms=("사고", "과징금")):
    q = spark.createDataFrame([(1, question, list(terms))], "item_id int, text string, terms array<string>")
    e = spark.createDataFrame(rows, "evidence_id string, source string, snippet string")
    return [(r.currency, r.low.wording, r.low.evidence_id, r.high.wording, r.high.evidence_id) for r in disputes.detect(q, e).collect()]


@pytest.mark.parametrize(("question", "rows", "want"), [
    (ASKS, [("e1", "a", "사고 과징금 90M 달러"), ("e2", "b", "과징금 9억 달러 부과")], [("달러", "90M 달러", "e1", "9억 달러", "e2")]),
    (ASKS, [("e1", "a", "사고 과징금 90M 달러"), ("e2", "a", "과징금 9억 달러 부과")], []),
    (ASKS, [("e1", "a", "사고 과징금 90M 달러"), ("e2", "b", "과징금 95M 달러")], []),
    ("그 사고는 어디서 났나?", [("e1", "a", "사고 과징금 90M 달러"), ("e2", "b", "과징금 9억 달러 부과")], []),
    (ASKS, [("e1", "a", "사고 과징금 90M 달러"), ("e2", "b", "매출 9억 달러")], []),
    (ASKS, [("e1", "a", "사고 과징금 5억 원"), ("e2", "b", "과징금 9억 달러")], []),
    (ASKS, [("e1", "a", "과징금 5억 원, 7 달러"), ("e2", "b", "과징금 1 달러"), ("e3", "b", "과징금 20억 원")], [("원", "5억 원", "e1", "20억 원", "e3")]),
    (ASKS, [("e1", "a", "과징금 0 원"), ("e2", "b", "과징금 20억 원")], []),
])
def test_contradictions(spark, question, rows, want):
    assert told(spark, question, rows) == want


def test_contradictions_without_terms_cover_all_amounts(spark):
    rows = [("e1", "a", "벌금 1 원"), ("e2", "b", "매출 9 원"), ("e3", "c", None), ("e4", "c", "9 원")]
    assert told(spark, ASKS, rows, ()) == [("원", "1 원", "e1", "9 원", "e4")]
    assert list(itertools.chain(told(spark, ASKS, [("e", None, "")]))) == []
