"""Criticality rules: rows of a rule table compiled to columns.

A rule says to which kinds of rows it applies and under which condition it fires.  Conditions nest: `any_of` and
`all_of` hold others; `text_contains_any` and `seed_terms` look for phrases in the text; `account_canonical_in` and
`subject_key_in` look a value up in a set; `field` with an operator looks at one field.  A rule that is tag-only marks a
row and changes nothing else; one with a lane of its own puts the row into that lane; any other puts it into the critical lane and
raises its status.

All rules are one projection: the phrases of all of them are found in one pass over the text.  A set up to SET_IN_PLAN values stands in
the plan; a larger one becomes a table that is joined on the value, so neither plan nor driver grows with it.

Defined cases: a field that the rows don't have, or that is null, is null; a condition without a known test, or an empty one, never
fires; `>=` on what is no number doesn't fire; an empty string or zero is no raw value; rows of a kind without rules fire nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from provena.operators.tagging import found_phrases
from provena.registry import query

#: Values of a set up to this number are a list in the plan; beyond it they are joined.
SET_IN_PLAN = 1_000
DEFAULT_LANE = "critical"
STATUS = {True: "CRITICAL", False: "UNVERIFIED"}
#: Columns of a rule table.
RULE = "id string, applies_to array<string>, condition string, lane string, tag_only boolean"
SETS = {"account_canonical_in": "account_canonical", "subject_key_in": "subject_key"}

# The twelve rules.
RULES = [
    {"id": "CR-HIGH-VALUE-DEAL", "applies_to": ["Deal", "Observation", "Claim"], "condition": {"field": "amount_krw", "operator": ">=", "value": 300000000}},
    {"id": "CR-AMOUNT-UNPARSEABLE", "applies_to": ["Deal"], "condition": {"field": "amount_krw", "operator": "is_null_but_raw_present"}},
    {"id": "CR-LOST-DEAL", "applies_to": ["Deal", "Observation"], "condition": {"any_of": [
        {"field": "outcome", "operator": "==", "value": "lost"}, {"field": "stage_value", "operator": "in", "value": ["실패", "실패마감처리"]},
        {"field": "current_issue", "operator": "in", "value": ["연락단절", "예산미확보", "고객도입필요성낮음", "고객반응낮음", "경쟁심화"]}]}},
    {"id": "CR-REGULATION-SECURITY", "applies_to": ["Evidence", "Observation", "Claim"], "condition": {"text_contains_any": [
        "개인정보보호법", "신용정보법", "채무자보호법", "개인금융채권", "추심총량제", "연락제한 요청권", "채무조정 요청권", "책무구조도", "1200%룰", "과징금", "금융감독원", "금융위원회", "감독원 제재",
        "KISA", "모의해킹", "보안 심의", "취약점 진단", "망분리", "VDI", "폐쇄망", "컴플라이언스", "제3자정보제공동의", "불완전판매", "주민번호", "주민등록번호"]}},
    {"id": "CR-STRATEGIC-ACCOUNT", "applies_to": ["Account", "Deal", "Observation", "Claim"], "condition": {"account_canonical_in": [
        "가나손해보험", "누리손해보험", "두레은행", "바람화재", "모다패션", "다라카드", "마바손해보험", "솔뫼텔레콤", "가나은행", "들찬증권", "미리내저축은행", "누리저축은행", "사아캐피탈", "하늘IT"]}},
    {"id": "CR-COMPETITOR-REPLACEMENT", "applies_to": ["Evidence", "Observation", "Claim"], "condition": {"text_contains_any": [
        "협업툴A", "협업툴B", "플로우", "협업툴D", "자체 구축", "내재화", "제 3의 업체", "제3의 업체", "재견적", "금액 점수 격차", "우선협상대상자", "견적심의", "타사 도입", "경쟁심화"]}},
    {"id": "CR-RARE-TECH", "applies_to": ["Evidence", "Observation", "Claim"], "condition": {"seed_terms": [
        "멀티테넌트", "멀티태넌트", "multitenant", "AWS Marketplace", "MRR", "ARR", "Co-Sell", "Joint Business Plan"]}},
    {"id": "CR-EXEC-SIGNAL", "applies_to": ["Evidence", "Observation", "Claim"], "condition": {"text_contains_any": [
        "경영진 의사결정", "경영진 보고", "경영진 대상", "임원보고", "임원 보고", "내부 방향성", "의사결정 사항", "핵심 의사결정", "내부 결재", "사업 계획 논의"]}},
    {"id": "CR-EXPLICIT-ABSENCE", "applies_to": ["Evidence", "Observation", "Claim"], "condition": {"text_contains_any": [
        "불가", "제외", "부재", "개발 필요", "커스터마이징 불가", "변경이 불가", "지원하지 않", "레퍼런스는 아직", "준비 중입니다", "정책 종속", "대체 제공", "절충 제공"]}},
    {"id": "CR-AI-FAILURE", "applies_to": ["Evidence", "Observation"], "condition": {"text_contains_any": ["답변하지 못함", "현재 답변 가능한 내용이 없습니다", "예상 답변"]}},
    {"id": "CR-CONTRADICTION-SEED", "applies_to": ["Evidence", "Observation", "Claim"], "lane": "conflict", "condition": {"subject_key_in": [
        "회사_비즈니스_업력", "미국_금융권_개인메신저_벌금", "인건비_1인당_원가", "제품_현행_버전", "시스템_구성_서비스_수", "데이터_보관_기간", "설계매니저_규모", "다라카드_사용_규모", "BD_개수"]}},
    {"id": "CR-NO-OBSERVED-AT", "applies_to": ["Observation", "Claim"], "tag_only": True, "condition": {"all_of": [
        {"field": "statement", "operator": "contains_number"}, {"field": "observed_at", "operator": "is_null"}]}},
]


def rule_table(spark, rules: list[dict]) -> DataFrame:
    rows = [(r["id"], r["applies_to"], json.dumps(r.get("condition") or {}, ensure_ascii=False), r.get("lane"), bool(r.get("tag_only"))) for r in rules]
    return spark.createDataFrame(rows, RULE)


def read_rules(table: DataFrame) -> list[dict]:
    """The rules of a table in order of their ids' first appearance; a rule table is configuration, not data."""
    return [{"id": r.id, "applies_to": r.applies_to or [], "condition": json.loads(r.condition or "{}"), "lane": r.lane, "tag_only": bool(r.tag_only)} for r in table.collect()]


def _leaves(condition: dict) -> Iterator[dict]:
    for c in condition.get("any_of") or condition.get("all_of") or []:
        yield from _leaves(c)
    if "any_of" not in condition and "all_of" not in condition:
        yield condition


def _phrases(leaf: dict) -> list[str]:
    return leaf.get("text_contains_any") or leaf.get("seed_terms") or []


def _set_of(leaf: dict) -> tuple[str, list] | None:
    """The field and the values of a membership test."""
    for test, name in SETS.items():
        if test in leaf:
            return name, leaf[test]
    return (leaf["field"], leaf["value"]) if leaf.get("operator") == "in" else None


class Compiler:
    """Columns of all rules over one DataFrame; `kind` and `text` name its columns."""

    def __init__(self, df: DataFrame, rules: list[dict], kind: str = "kind", text: str = "text", set_in_plan: int = SET_IN_PLAN):
        self.rules, self.kind, self.types = rules, kind, {f.name: f.dataType for f in df.schema}
        leaves = [leaf for r in rules for leaf in _leaves(r["condition"])]
        phrases = sorted({p for leaf in leaves for p in _phrases(leaf)})
        self.joined: dict[int, str] = {}
        for leaf in leaves:
            got = _set_of(leaf)
            if got and len(got[1]) > set_in_plan and got[0] in self.types:
                name = f"_in{len(self.joined)}"
                self.joined[id(leaf)] = name
                values = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(got[1])], T.StructType().add("_v", self.types[got[0]])).withColumn(name, F.lit(True))
                df = df.join(values, F.col(got[0]) == F.col("_v"), "left").drop("_v")
        self.df = df.withColumn("_found", found_phrases(F.coalesce(F.col(text), F.lit("")), phrases))

    def _field(self, name: str) -> Column:
        return F.col(f"`{name}`") if name in self.types else F.lit(None).cast("string")

    def _present(self, name: str) -> Column:
        c, t = self._field(name), self.types.get(name)
        return c.isNotNull() & ((c != 0) if isinstance(t, T.NumericType) else c if isinstance(t, T.BooleanType) else (c.cast("string") != ""))

    def condition(self, c: dict) -> Column:
        """True or false, never null."""
        no = F.lit(False)
        if "any_of" in c:
            return reduce(Column.__or__, map(self.condition, c["any_of"]), no)
        if "all_of" in c:
            return reduce(Column.__and__, map(self.condition, c["all_of"]), F.lit(True))
        if _phrases(c):
            return F.arrays_overlap("_found", F.array(*map(F.lit, _phrases(c))))
        if got := _set_of(c):
            name, values = got
            if id(c) in self.joined:
                return F.coalesce(F.col(self.joined[id(c)]), no)
            test = self._field(name)
            return F.coalesce(test.isin(*values), no) & ((test.cast("string") != "") if "operator" not in c else F.lit(True)) if values else no
        if "field" not in c:
            return no
        x, op = self._field(c["field"]), c["operator"]
        test = {
            "is_null": lambda: x.isNull(),
            "is_null_but_raw_present": lambda: x.isNull() & self._present(c["field"].replace("_krw", "_raw")),
            "contains_number": lambda: self._present(c["field"]) & x.cast("string").rlike(r"\d"),
            ">=": lambda: x.try_cast("double") >= float(c["value"]),
            "==": lambda: x == c["value"],
        }.get(op)
        return F.coalesce(test(), no) if test else no

    def columns(self) -> DataFrame:
        """The rows with `fired`, `lanes` and `escalating`, arrays in the order of the rules."""
        hits = [F.when(F.col(self.kind).isin(*r["applies_to"]) & self.condition(r["condition"]), F.lit(r["id"])) for r in self.rules if r["applies_to"]]
        none = F.array().cast("array<string>")
        out = self.df.withColumn("fired", F.array_compact(F.array(*hits)) if hits else none)
        lane = {r["id"]: r["lane"] or DEFAULT_LANE for r in self.rules if not r["tag_only"]}
        up = [r["id"] for r in self.rules if not r["tag_only"] and not r["lane"]]
        table = F.create_map(*[F.lit(x) for kv in lane.items() for x in kv]) if lane else F.create_map().cast("map<string,string>")
        out = out.withColumn("lanes", F.array_distinct(F.array_compact(F.transform("fired", lambda i: F.try_element_at(table, i)))))
        out = out.withColumn("escalating", F.filter("fired", lambda i: i.isin(*up)) if up else none)
        return out.drop("_found", *self.joined.values())


def evaluate(df: DataFrame, rules: DataFrame | list[dict], kind: str = "kind", text: str = "text", set_in_plan: int = SET_IN_PLAN) -> DataFrame:
    """`df` with the ids of fired rules, the lanes they open, and those that raise the status."""
    given = read_rules(rules) if isinstance(rules, DataFrame) else [{"lane": None, "tag_only": False, "condition": {}} | r for r in rules]
    return Compiler(df, given, kind, text, set_in_plan).columns()


def raised(status: Column, escalating: Column, verified_allowed: Column) -> Column:
    """The status after the rules: critical or unverified where one escalates."""
    return F.when(F.size(escalating) > 0, F.when(verified_allowed, STATUS[True]).otherwise(STATUS[False])).otherwise(status)


#: The same twelve rules in fields and words of the corpus at hand.
CORPUS = [
    {"id": "CR-HIGH-VALUE-DEAL", "applies_to": ["Deal", "Observation", "Claim"], "condition": {"field": "amount_krw", "operator": ">=", "value": 300000}},
    {"id": "CR-AMOUNT-UNPARSEABLE", "applies_to": ["Deal"], "condition": {"field": "amount_krw", "operator": "is_null_but_raw_present"}},
    {"id": "CR-LOST-DEAL", "applies_to": ["Deal", "Observation"], "condition": {"any_of": [
        {"field": "outcome", "operator": "==", "value": "lost"}, {"field": "stage_value", "operator": "in", "value": ["1-URGENT", "5-LOW"]}, {"field": "current_issue", "operator": "in", "value": ["error"]}]}},
    {"id": "CR-REGULATION-SECURITY", "applies_to": ["Evidence", "Observation", "Claim"], "condition": {"text_contains_any": ["token", "secret", "password", "license", "licensed"]}},
    {"id": "CR-STRATEGIC-ACCOUNT", "applies_to": ["Account", "Deal", "Observation", "Claim"], "condition": {"account_canonical_in": ["Customer#000000007", "Customer#000000010", "Customer#000000013"]}},
    {"id": "CR-COMPETITOR-REPLACEMENT", "applies_to": ["Evidence", "Observation", "Claim"], "condition": {"text_contains_any": ["Public", "GNU", "Apache"]}},
    {"id": "CR-RARE-TECH", "applies_to": ["Evidence", "Observation", "Claim"], "condition": {"seed_terms": ["http", "https", "www."]}},
    {"id": "CR-EXEC-SIGNAL", "applies_to": ["Evidence", "Observation", "Claim"], "condition": {"text_contains_any": ["All rights", "purchase"]}},
    {"id": "CR-EXPLICIT-ABSENCE", "applies_to": ["Evidence", "Observation", "Claim"], "condition": {"text_contains_any": [" not ", " ohne ", " sin "]}},
    {"id": "CR-AI-FAILURE", "applies_to": ["Evidence", "Observation"], "condition": {"text_contains_any": ["error"]}},
    {"id": "CR-CONTRADICTION-SEED", "applies_to": ["Evidence", "Observation", "Claim"], "lane": "conflict", "condition": {"subject_key_in": ["src3", "src8", "signup"]}},
    {"id": "CR-NO-OBSERVED-AT", "applies_to": ["Observation", "Claim"], "tag_only": True, "condition": {"all_of": [{"field": "statement", "operator": "contains_number"}, {"field": "observed_at", "operator": "is_null"}]}},
]

#: Rows of four kinds with the fields of the rules; every seventh deal's amount is known as raw text only.
ROWS = """
SELECT 'Deal' AS kind, cast(d.deal_id AS string) AS id, '' AS text, CASE WHEN d.deal_id % 7 <> 0 THEN d.amount END AS amount_krw, CASE WHEN d.deal_id % 14 = 0 THEN '' ELSE 'ca. 1' END AS amount_raw, d.outcome, d.stage AS stage_value, cast(NULL AS string) AS current_issue, a.account AS account_canonical, cast(NULL AS string) AS subject_key, cast(NULL AS string) AS statement, cast(NULL AS string) AS observed_at, true AS verified_allowed
FROM {deal} d JOIN {account} a ON d.custkey = a.custkey
UNION ALL SELECT 'Evidence', cast(doc_id AS string), snippet, cast(NULL AS double), cast(NULL AS string), cast(NULL AS string), cast(NULL AS string), cast(NULL AS string), cast(NULL AS string), source, cast(NULL AS string), cast(NULL AS string), false FROM {evidence}
UNION ALL SELECT 'Observation', cast(o.obs_id AS string), o.statement, o.value * 4000, cast(NULL AS string), cast(NULL AS string), cast(NULL AS string), o.statement, a.account, o.statement, concat(o.statement, CASE WHEN o.obs_id % 3 = 0 THEN ' 3' ELSE '' END), CASE WHEN o.obs_id % 2 = 0 THEN cast(o.ts AS string) END, o.obs_id % 2 = 0
FROM {observation} o JOIN {account} a ON o.custkey = a.custkey
UNION ALL SELECT 'Account', a.account, '', cast(NULL AS double), cast(NULL AS string), cast(NULL AS string), cast(NULL AS string), cast(NULL AS string), a.account, cast(NULL AS string), cast(NULL AS string), cast(NULL AS string), false FROM {account} a"""


def _sql_condition(c: dict) -> str:
    """The condition in SQL, without the compiler's means: contains, lists and comparisons."""
    if "any_of" in c or "all_of" in c:
        return "(" + (" OR " if "any_of" in c else " AND ").join(map(_sql_condition, c.get("any_of") or c["all_of"])) + ")"
    if _phrases(c):
        return "(" + " OR ".join(f"contains(text, '{p}')" for p in _phrases(c)) + ")"
    if got := _set_of(c):
        return f"coalesce({got[0]} IN ({', '.join(f"'{v}'" for v in got[1])}), false)"
    x = c["field"]
    return {"is_null": f"{x} IS NULL", "is_null_but_raw_present": f"({x} IS NULL AND coalesce({x.replace('_krw', '_raw')}, '') <> '')", "contains_number": f"coalesce(regexp_matches({x}, '[0-9]'), false)",
            ">=": f"coalesce({x} >= {c.get('value')}, false)", "==": f"coalesce({x} = '{c.get('value')}', false)"}[c["operator"]]


def _case(rules: list[dict], then) -> str:
    return ", ".join(f"CASE WHEN kind IN ({', '.join(f"'{k}'" for k in r['applies_to'])}) AND {_sql_condition(r['condition'])} THEN '{then(r)}' END" for r in rules)


_SQL_ROWS = ROWS.replace("{", "").replace("}", "")


@query("X2_criticality", f"""WITH r AS ({_SQL_ROWS}),
f AS (SELECT kind, id, verified_allowed, concat_ws('|', {_case(CORPUS, lambda r: r['id'])}) AS fired, list_distinct(list_filter([{_case([r for r in CORPUS if not r.get('tag_only')], lambda r: r.get('lane') or DEFAULT_LANE)}], lambda x: x IS NOT NULL)) AS lanes,
  len(list_filter([{_case([r for r in CORPUS if not r.get('tag_only') and not r.get('lane')], lambda r: r['id'])}], lambda x: x IS NOT NULL)) AS up FROM r)
SELECT kind, id, fired, array_to_string(list_sort(lanes), '|') AS lanes, CASE WHEN up > 0 THEN CASE WHEN verified_allowed THEN 'CRITICAL' ELSE 'UNVERIFIED' END ELSE 'CANDIDATE' END AS status FROM f""")
def _x2(g):
    """Twelve rules from a table over deals, evidence, observations and accounts."""
    rows = g.spark.sql(ROWS, deal=g.deal, account=g.account, evidence=g.evidence, observation=g.observation)
    out = evaluate(rows, rule_table(g.spark, CORPUS))
    status = raised(F.lit("CANDIDATE"), F.col("escalating"), F.col("verified_allowed"))
    return out.select("kind", "id", F.array_join("fired", "|").alias("fired"), F.array_join(F.array_sort("lanes"), "|").alias("lanes"), status.alias("status"))
