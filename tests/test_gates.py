"""Lead forms of all dialects, the gate behind extraction and the contract of answers, on rows made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from provena.operators import extraction
from provena.sources.leads import lead_form

F1 = "신규 리드 도착 :tada:\n :office:  회사 :  Acme, Inc. \n:memo: 비고: http://a.b:80\n:x: 회사: Zorbex\nplain: line\n:empty: 이름:"
F2 = "*접수일자:* 2024-01-02\n*회사:* Acme *담당자:* no label in a line\n*문의:*\nfirst\nsecond\n*a: b:* x"
F3 = ":love_letter: 신규 리드 등록\n*회사*\n(guide)\n Acme \n\nLtd\n*담당자* \n*문의*\n*bold* text\n(also a guide)"
F5 = "Lead\n• *회사* : Acme\n - 담당자: Kim: Lee\n- other: x\n-연락처:010\n* 비고: star"


@pytest.mark.parametrize("text, form, fields", [
    (F1, "F1", {"회사": "Zorbex", "비고": "http://a.b:80", "이름": ""}),
    (F2, "F2", {"접수일자": "2024-01-02", "회사": "Acme *담당자:* no label in a line", "문의": "first\nsecond\n*a: b:* x"}),
    (F3, "F3", {"회사": "Acme\nLtd", "담당자": "", "문의": "*bold* text"}),
    (F5, "F5", {"회사": "Acme", "담당자": "Kim: Lee", "연락처": "010"}),
    ("- 회사: a\n- 회사: b\n- 비고: c", None, None), ("", None, None), (None, None, None),
    ("신규 리드 도착", "F1", {}), (":love_letter: only\n신규 리드 도착\n:a: 회사: x", "F1", {"회사": "x"}),
    ("*접수일자:*\n:love_letter: 신규 리드 등록", "F3", {"접수일자:": ":love_letter: 신규 리드 등록"}),  # a whole line in stars is a label
    (":love_letter: 신규 리드 등록", "F3", {}),
    ("\ufdd0신규 리드 도착\n:a: 회\ufdd1사: x", "F1", {"회사": "x"}),
])
def test_lead_forms(spark, text, form, fields):
    r = spark.createDataFrame([(text,)], "t string").select(lead_form(F.col("t")).alias("r")).first().r
    assert (r and r.form, r and r.fields) == (form, fields)


def test_lead_form_of_a_long_text(spark):
    t = F2 + "\n" + "x y " * 500_000
    r = spark.createDataFrame([(t,)], "t string").select(lead_form(F.col("t")).alias("r")).first().r
    assert r.form == "F2" and len(r.fields["문의"]) > 1_900_000


def by_hand(item, lexicon, exempt):
    """The gate's rule, told one item at a time."""
    import re

    plain = lambda s: re.sub(r"\s+", " ", s).strip()
    q = plain(item[1] or "")
    if not q:
        return ["no quote"]
    out = set()
    for name, texts in (item[2] or {}).items():
        if name in extraction.ADDRESS:
            continue
        for t in texts or []:
            if t is None:
                continue
            out |= {f"{name}: number {n}" for n in re.findall(extraction.NUMBER, t) if n.replace(",", "") not in q.replace(",", "")}
            if name in extraction.BOUND and name not in exempt and plain(t) and plain(t) not in q:
                out.add(f"{name}: name {plain(t)}")
            if name not in exempt:
                out |= {f"{name}: term {x}" for x in lexicon if x and plain(x) and plain(x).lower() in plain(t).lower() and plain(x).lower() not in q.lower()}
    return sorted(out)


@pytest.mark.parametrize("exempt", [(), ("account",)])
def test_extraction_gate_by_brute_force(spark, exempt):
    items = [
        (1, "Acme paid 1,200 won in 2024", {"account": ["Acme"], "sum": ["1200 won", "7.5 %"]}),
        (2, "Acme  paid", {"account": ["Acme\npaid", "Zorbex"], "what": ["the zorbex deal of Zorb"], "locator": ["p. 99"]}),
        (3, "  \n", {"account": ["Acme"]}), (4, None, None), (5, "x", None), (6, "x", {}),
        (7, "고객 통제", {"product": ["통제"], "note": ["고객 통제 시스템 3"]}), (8, "short", {"note": [None, "", "a long-named-product-of-many-words is"], "empty": None}),
        (9, "LONG-named-product-of-MANY-words", {"note": ["a long-named-product-of-many-words is, long-named-things"]}), (10, "12,5", {"n": ["125", "12.5"]}),
    ]
    lexicon = ["Zorbex", "Zorb", "시스템", "long-named-product-of-many-words", "Long-Named-Things", "a", "", "  ", None, "Zorbex"]
    i = spark.createDataFrame(items, "item_id int, quote string, fields map<string, array<string>>")
    out = extraction.gate(i, spark.createDataFrame([(t,) for t in lexicon], "term string"), exempt=exempt)
    assert {r.item_id: r.reasons for r in out.collect()} == {r[0]: by_hand(r, set(lexicon), exempt) for r in items}
    none = extraction.gate(i.limit(0), spark.createDataFrame([], "term string"))
    assert none.count() == 0


# the contract of answers


GOOD = {
    "answer": {"text": "x"}, "citations": [{"marker": 1, "evidence_id": "e1"}],
    "evidence": [{"evidence_id": "e1", "source_id": "s", "locator": "l", "snippet": "x" * 500, "observed_at": None, "masked": True,
                  "authority_label": {"tier": "T1", "claim_domain": "deal_fact", "source_type": "spec", "policy_version": "1"}}],
    "evidence_strength": {"band": "LOW", "basis": {"independent_evidence": 1, "highest_authority": "spec", "contradiction": "none", "recency": "stale"}},
    "unknowns": [], "gaps": [], "subgraph": {"nodes": [], "edges": []}, "route": {"retriever": "Q-M"}, "notices": {"results_may_be_incomplete": False},
}


def changed(path, value):
    """GOOD with another value at a path; `...` takes the field away."""
    out = json.loads(json.dumps(GOOD))
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


EVIDENCE_AT = ("evidence", 0)
CONTRACT_CASES = [
    (json.dumps(GOOD), []), ("no json {", ["$: no JSON"]), (None, ["$: no JSON"]), ("[1]", ["$: not of type object"]),
    (changed(("confidence",), 0.9), ["$: 'confidence' is not allowed"]), (changed(("gaps",), ...), ["$: 'gaps' is missing"]),
    (changed(("answer", "text"), ""), ["$.answer.text: shorter than 1"]), (changed(("answer",), "x"), ["$.answer: not of type object"]),
    (changed(("citations", 0, "marker"), 0), ["$.citations[0].marker: below 1"]), (changed(("citations", 0, "marker"), 1.5), ["$.citations[0].marker: not of type integer"]),
    (changed(("citations", 0, "marker"), "1"), ["$.citations[0].marker: not of type integer"]), (changed(("citations", 0, "evidence_id"), "e2"), ["$.citations: no evidence 'e2'"]),
    (changed((*EVIDENCE_AT, "snippet"), "x" * 501), ["$.evidence[0].snippet: longer than 500"]), (changed((*EVIDENCE_AT, "observed_at"), 3), ["$.evidence[0].observed_at: not of type string"]),
    (changed((*EVIDENCE_AT, "masked"), "yes"), ["$.evidence[0].masked: not of type boolean"]), (changed((*EVIDENCE_AT, "authority_label", "tier"), "T9"), ["$.evidence[0].authority_label.tier: 'T9' is none of its values"]),
    (changed(("subgraph", "nodes"), [{"id": "a", "labels": [], "label_text": "a", "rank": "focal", "status": None}]), ["$.subgraph.nodes[0].labels: fewer than 1 items"]),
    (changed(("subgraph", "edges"), [{"from": "a", "to": "b", "type": "t"}] * 101), ["$.subgraph.edges: more than 100 items"]),
    (changed(("disputes",), [{"subject": "s", "sides": [{"statement": "t", "evidence_ids": []}]}]), ["$.disputes[0].sides: fewer than 2 items", "$.disputes[0].sides[0].evidence_ids: fewer than 1 items"]),
    (changed(("unknowns",), [None, 1]), ["$.unknowns[0]: not of type string", "$.unknowns[1]: not of type string"]), (changed(("route", "retriever"), "Q-X"), ["$.route.retriever: 'Q-X' is none of its values"]),
]


def test_contract_faults(spark):
    from provena.operators.contracts import answer_faults

    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CONTRACT_CASES)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", answer_faults(F.col("t")).alias("f")).collect()}
    assert [got[i] for i in range(len(CONTRACT_CASES))] == [f for _, f in CONTRACT_CASES]


def test_answers_are_put_together(spark):
    from provena.operators.contracts import NOTHING, assemble

    asks = [
        (1, "What of Acme?", "Acme paid 12 won [1]. Zorbex paid [1]. nothing backs this. [9]\nit is late. [2]", [(1, "e1"), (2, "e2"), (9, "e9")]),
        (2, "q", "Only this [7].", [(7, "e1")]), (3, None, None, None), (4, "q", "mail a@b.com [1].", [(1, "e8")]),
    ]
    a = spark.createDataFrame([(*r, "Q-E", "deal_fact", False) for r in asks], "qid int, question string, text string, citations array<struct<marker: int, evidence_id: string>>, retriever string, claim_domain string, incomplete boolean")
    shape = "qid int, place int, evidence_id string, source_id string, locator string, snippet string, tier string, source_type string, observed_at date"
    import datetime

    row = lambda q, p, i, s, tier="T1": (q, p, i, f"s{p}", "l", s, tier, "spec", datetime.date(2024, 6, 1))
    e = spark.createDataFrame([row(1, 1, "e1", "Acme paid 12 won"), row(1, 2, "e2", "it is late" + " x" * 400, "T4"), row(1, 3, "e3", "over the limit"), row(1, 0, "e4", "a@b.com"), row(4, 1, "e8", "mail a@b.com")], shape)
    raw = spark.createDataFrame([row(1, 1, "e1", "Acme paid 12 won"), row(1, 2, "e5", "more")], shape)
    claims = spark.createDataFrame([(1, 5, "s", "CRITICAL"), (1, 6, "s", "VERIFIED")], "qid int, claim_id int, statement string, status string")
    got = {r.qid: r for r in assemble(a, e, raw, claims, "2025-01-15", limit=2).collect()}
    one = json.loads(got[1].answer)
    assert [x["evidence_id"] for x in one["evidence"]] == ["e1", "e2"] and len(one["evidence"][1]["snippet"]) == 500
    assert [x["evidence_id"] for x in one["raw_signals"]] == ["e5"] and one["notices"]["critical_unverified_included"]
    assert one["answer"]["text"].split() == "Acme paid 12 won [1]. it is late [2].".split() and [c["marker"] for c in one["citations"]] == [1, 2]
    assert (got[1].dropped, got[1].removed) == (1, 1)
    assert one["evidence_strength"]["band"] == "HIGH" and one["evidence_strength"]["basis"]["independent_evidence"] == 2
    for q in (2, 3, 4):
        x = json.loads(got[q].answer)
        assert x["answer"]["text"] == NOTHING and not x["citations"] and not x["evidence"] and x["evidence_strength"]["band"] == "LOW"
    assert all(r.faults == [] for r in got.values())
    assert assemble(a.limit(0), e, raw, claims, "2025-01-15").count() == 0


def test_sweep_covers_each_place_and_nothing_else(spark):
    from provena.operators.contracts import swept

    full = json.loads(json.dumps(GOOD))
    full["answer"] = {"text": "call 010-1234-5678 at 1700000000000", "recommendation": "mail a.b@c.org"}
    full["evidence"][0] |= {"locator": "02-123-4567", "snippet": "v1.2.3 900101-1234567"}
    full["raw_signals"] = [{"evidence_id": "r", "snippet": "1588-1234", "locator": "l", "source_id": "s"}]
    full["subgraph"]["nodes"] = [{"id": "a@b.org", "labels": ["X"], "label_text": "a@b.org", "rank": "focal"}]
    texts = [json.dumps(full), json.dumps(GOOD), "no json", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", swept(F.col("t")).alias("x"))
    got = {r.i: r.x for r in df.collect()}
    out = json.loads(got[0].answer)
    assert out["answer"] == {"text": "call ***-****-**** at 1700000000000", "recommendation": "mail *.*@*.***"}
    assert out["evidence"][0]["locator"] == "**-***-****" and out["evidence"][0]["snippet"] == "v1.2.3 ******-*******"
    assert out["raw_signals"][0]["snippet"] == "****-****" and out["subgraph"]["nodes"][0] == {"id": "a@b.org", "labels": ["X"], "label_text": "*@*.***", "rank": "focal"}
    assert got[0].hits == ["010-1234-5678", "a.b@c.org", "02-123-4567", "900101-1234567", "1588-1234", "a@b.org"]
    assert [(got[i].answer, got[i].hits) for i in range(1, 5)] == [(t, []) for t in texts[1:]]
