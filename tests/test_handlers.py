"""Handlers of parsed records on inline payloads."""

import json

import pytest

from provena.operators import handlers as H

REGISTRY = H.Registry(
    domains={"bd_1": "퇴직 연금", "bd_2": "Retail"}, targets={"bd_1": ["은행", "증권"]}, target_rows={"!r7": ["bd_1", "bd_2"]}, domain_of={"연금": ["bd_1"], "유통": ["bd_2", "bd_1"]}, domain_split=("/", "·"),
    needs={"n1": ("기록 보관", ["기록", "보관"]), "n2": ("외부 통제", ["통제"])}, capabilities={"c1": ("보관함", ["n1"]), "c2": ("감사", ["n1", "n2"])},
    hints={"기능명": {"검색": ["c2"]}, "영역": {"대화": ["c1"]}}, products=("LiveTalk", "Live"), scopes=("채권",))


def made(spark, *records):
    rows = [("s", f"l{i}!r7" if kind == "bd_targets" else f"l{i}", kind, excerpt, x if isinstance(x, str) or x is None else json.dumps(x, ensure_ascii=False)) for i, (kind, excerpt, x) in enumerate(records)]
    df = spark.createDataFrame(rows, "source_id string, locator string, record_kind string, excerpt string, structured string").selectExpr("*", "cast(null AS timestamp) AS authored_at")
    return df, H.elements(df, REGISTRY)


def told(spark, kind, payload, excerpt=""):
    _, e = made(spark, (kind, excerpt, payload))
    return {(r.out, r.type, r.key if r.out != "observation" and r.type not in ("MENTIONS", "OBSERVED_IN", "Event") else "-", r.to_key if r.type != "OBSERVED_IN" else "-") for r in e.collect()}


OBS = ("observation", "record", "-", None)


def mention(key):
    return ("edge", "MENTIONS", "-", key)


@pytest.mark.parametrize(("kind", "payload", "want"), [
    ("feature_row", {"기능명": "통합 검색", "대분류": "상담", "중분류": "대화", "introduced_in": "v2"}, {OBS, mention("상담|대화||통합검색"), ("node", "Feature", "상담|대화||통합검색", None), ("claim", "product_spec", "feature.introduced_in::상담|대화||통합검색", "상담|대화||통합검색"),
     ("node", "Capability", "c1", None), ("claim", "product_spec", "feature.implements::상담|대화||통합검색::c1", "상담|대화||통합검색"), ("edge", "IMPLEMENTS", "상담|대화||통합검색", "c1")}),
    ("bd_maturity", {"BD": "퇴직연금", "maturity": {"기획": "✔", "영업": "-"}}, {OBS, mention("bd_1"), ("node", "BusinessDomain", "bd_1", None), ("claim", "bd_registry_fact", "bd.maturity::bd_1", "bd_1")}),
    ("bd_market", {"BD": "모르는 것"}, set()),
    ("bd_targets", {"산업": "은행 / 카드"}, {OBS, *(x for d in ("bd_1", "bd_2") for i in ("은행", "카드") for x in (mention(d), ("node", "BusinessDomain", d, None), ("node", "Industry", i, None), ("claim", "bd_registry_fact", f"bd.targets::{d}::{i}", d), ("edge", "TARGETS", d, i)))}),
    ("activity_row", {"고객사": "(주) 가나 은행", "접촉방식": "미팅", "미팅내용": "데모"}, {OBS, mention("가나은행"), ("edge", "OBSERVED_IN", "-", "-"), ("node", "Event", "-", None), ("node", "Account", "가나은행", None), ("claim", "deal_fact", "activity::가나 은행::l0", "가나은행")}),
    ("activity_row", {"고객사": ""}, {OBS, ("edge", "OBSERVED_IN", "-", "-"), ("node", "Event", "-", None)}),
    ("weekly_row", {"고객사": "가나 채권", "주차": "W3", "업무도메인": "연금/유통"}, {OBS, mention("가나"), mention("가나|채권"), ("node", "Account", "가나", None), ("node", "Deal", "가나|채권", None), ("claim", "deal_fact", "weekly.stage::가나::W3", "가나|채권"), ("edge", "WITH_ACCOUNT", "가나|채권", "가나")}),
    ("deal_row", {"단계": "제안"}, set()),
    ("pain_row", {"고객사": "가나·다라", "pain_원문": "기록이 없다"}, {OBS, mention("n1"), ("node", "Need", "n1", None), *(x for a in ("가나", "다라") for x in (mention(a), ("node", "Account", a, None), ("claim", "customer_generalization", f"account.need::{a}::n1", "n1"), ("edge", "HAS_NEED", a, "n1"))),
     *(x for c in ("c1", "c2") for x in (("node", "Capability", c, None), ("claim", "customer_generalization", f"need.addressed_by::n1::{c}", "n1"), ("edge", "ADDRESSED_BY", "n1", c)))}),
    ("lead_alert", {"fields": {"회사": "새 회사"}}, {OBS, mention("새회사"), ("edge", "OBSERVED_IN", "-", "-"), ("node", "Event", "-", None), ("node", "Account", "새회사", None), ("claim", "deal_fact", "lead::새 회사::l0", "새회사")}),
    ("meeting_note", {"title": "점검", "counterpart": "가나"}, {OBS, mention("가나"), ("edge", "OBSERVED_IN", "-", "-"), ("node", "Event", "-", None), ("node", "Account", "가나", None), ("claim", "deal_fact", "meeting::가나::l0", "가나")}),
    ("doc_section", {"title": "x"}, set()), ("code_asset", {}, set()), ("unheard_of", {"고객사": "가나"}, set()), ("feature_row", "{broken", set()), ("feature_row", None, set()),
])
def test_handlers(spark, kind, payload, want):
    assert told(spark, kind, payload) == want


def test_deal_row_links_products_domains_and_industry(spark):
    got = told(spark, "deal_row", {"고객사": "다라카드 채권", "단계": "실패", "예상매출": "1억 -> 2억", "업권": "카드", "업무_도메인": "연금·유통"}, "LiveTalk 도입")
    assert {k for o, t, k, _ in got if t == "FOR_PRODUCT"} == {"다라카드|채권"} and {k for o, t, k, _ in got if t == "Product"} == {"livetalk", "live"}
    assert {x for o, t, _, x in got if t == "IN_DOMAIN"} == {"bd_1", "bd_2"} and ("edge", "BELONGS_TO", "다라카드", "카드") in got
    _, e = made(spark, ("deal_row", "", {"고객사": "다라카드 채권", "단계": "실패", "예상매출": "1억 -> 2억"}))
    props = e.where("type = 'Deal'").first().props
    assert (props["outcome"], float(props["amount_krw"]), props["deal_scope"]) == ("lost", 2e8, "채권")


def test_merged_nodes_and_skipped_records(spark):
    df, e = made(spark, ("deal_row", "", {"고객사": "가나", "단계": "운영고객"}), ("lead_alert", "", {"fields": {"회사": "가 나"}}), ("lead_alert", "", {"fields": {"회사": "가 나"}}), ("deal_row", "", {}), ("doc_section", "", {}), ("feature_row", "", {"대분류": "x"}))
    nodes = {(r.type, r.key): r for r in H.merged(e).collect()}
    assert nodes["Account", "가나"].n == 3 and nodes["Account", "가나"].props["account_kind"] == "lead" and nodes["Account", "가나"].source_ids == ["s"]
    assert {r.record_kind: r.n for r in H.skipped(df, e).collect()} == {"deal_row": 1, "feature_row": 1}


def test_a_registry_is_bounded():
    with pytest.raises(ValueError, match="more than"):
        H.Registry(domains={str(i): "x" for i in range(H.MOST + 1)})
