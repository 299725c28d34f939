"""Product gaps in three values, for a table of questions over all evidence.

CONFIRMED needs an excerpt that says the thing is absent, from a source that may say so, about the subject
of the question.  A missing link between a need and a capability never confirms: without such an excerpt
the most is POSSIBLE, where a need is known, and UNKNOWN where nothing is.  An excerpt that says the thing
is possible but isn't the aim blocks CONFIRMED, whatever else is there.

Excerpts are marked for all classes of phrases in one pass, those without a phrase go, and the rest meet the
questions by shared terms; what a question needs is then one conditional aggregation.

Defined cases: a question without content terms is about nothing, so it is decided by its linked needs alone; equal
evidence ids count once; ids are in order; null snippets and roles are empty; an empty table of questions gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from provena.functions import text as X
from provena.operators.tagging import found_classes, on_topic
from provena.registry import query

# What says that a product lacks something, that a deal was lost over it, that it is out of scope on purpose,
# and that it is needed; and which sources may speak of absence, by what they are the record for or by their type.
ABSENCE = (
    "미지원", "미제공", "지원하지 않", "제공하지 않", "제공되지 않", "지원 불가", "제공 불가", "대응 불가", "기능이 없", "기능 부재", "구현되지 않", "개발 검토 중", "개발 예정",
    "불가 의견", "정책상 제한", "수정 불가", "삭제 불가", "표시 불가", "다운로드 불가", "지원 예정 없")
DIRECT_LOSS = ("수주 실패", "탈락", "실주", "경쟁사로 결정", "도입 보류 사유")
OUT_OF_SCOPE = ("기술적으로는 가능", "핵심 목적이 아니", "핵심 목적은 아니", "시스템이 아닙니다", "플랫폼이 아닙니다", "영역이 아닙니다", "지향하지 않", "목적이 아닙니다", "범위가 아니")
NEED = ("불편", "어려움", "어렵", "필요하", "요구", "요청", "못 함", "못함", "못하", "안 됨", "안됨", "산재", "누락", "부담", "리스크", "위험", "불가함", "pain", "이슈")
ROLES = ("기능 부재", "제약", "미지원", "한계", "대응 불가")
TYPES = ("release_spec", "product_doc", "product_brochure")


@dataclass(frozen=True)
class Phrases:
    absence: tuple[str, ...] = ABSENCE + DIRECT_LOSS
    out_of_scope: tuple[str, ...] = OUT_OF_SCOPE
    need: tuple[str, ...] = NEED
    roles: tuple[str, ...] = ROLES
    types: tuple[str, ...] = TYPES
    least: int = 2


def _plain(s: str) -> str:
    return "".join(s.split()).lower()


def marked(evidence: DataFrame, p: Phrases) -> DataFrame:
    """(evidence_id, text, absent, out, need) of excerpts that hold a phrase; `evidence` has (evidence_id, snippet, source_type, role)."""
    classes = found_classes(X.fold(F.col("snippet"), False), {"absence": p.absence, "out": p.out_of_scope, "need": p.need}, _plain)
    role = F.coalesce(F.col("role"), F.lit(""))
    may = F.coalesce(F.col("source_type").isin(*p.types), F.lit(False))
    for r in p.roles:
        may = may | F.contains(role, F.lit(r))
    m = evidence.select("evidence_id", F.col("snippet").alias("text"), may.alias("may"), F.explode(F.array(classes)).alias("c"))  # worked out once a row
    m = m.select("evidence_id", "text", (F.col("c.absence") & F.col("may")).alias("absent"), F.col("c.out").alias("out"), F.col("c.need").alias("need"))
    return m.where("absent OR out OR need")


def assess(questions: DataFrame, evidence: DataFrame, needs: DataFrame | None = None, capabilities: DataFrame | None = None, phrases: Phrases = Phrases(), terms: Column | None = None) -> DataFrame:
    """(item_id, verdict, out_of_scope, need_ids, need_from_text, capability_ids, absence_ids) for `questions` (item_id, text).

    `needs` and `capabilities` are (item_id, evidence_id) linked by the graph.  Needs found in excerpts count only where none is linked.
    """
    q = questions.select("item_id", (X.content_terms(F.coalesce("text", F.lit(""))) if terms is None else terms).alias("terms"))
    m = marked(evidence, phrases)
    pairs = on_topic(m, q, phrases.least).join(m.drop("text"), "evidence_id")
    ids = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.col("evidence_id"))))
    found = pairs.groupBy("item_id").agg(ids("absent").alias("absent"), F.max("out").alias("out"), ids("need").alias("said"))
    kind = dict(m.dtypes)["evidence_id"]
    none = F.array().cast(f"array<{kind}>")
    out = questions.select("item_id").join(found, "item_id", "left")
    for name, links in (("linked", needs), ("capability_ids", capabilities)):
        if links is None:
            out = out.withColumn(name, none)
        else:
            out = out.join(links.groupBy("item_id").agg(F.array_sort(F.collect_set("evidence_id")).alias(name)), "item_id", "left").withColumn(name, F.coalesce(name, none))
    out = out.withColumn("said", F.coalesce("said", none)).withColumn("absent", F.coalesce("absent", none)).withColumn("out_of_scope", F.coalesce("out", F.lit(False)))
    out = out.withColumn("need_from_text", (F.size("linked") == 0) & (F.size("said") > 0)).withColumn("need_ids", F.when(F.size("linked") > 0, F.col("linked")).otherwise(F.col("said")))
    confirmed = ~F.col("out_of_scope") & (F.size("absent") > 0)
    verdict = F.when(confirmed, "CONFIRMED").when(F.size("need_ids") > 0, "POSSIBLE").otherwise("UNKNOWN")
    return out.select("item_id", verdict.alias("verdict"), "out_of_scope", "need_ids", "need_from_text", "capability_ids", F.when(confirmed, F.col("absent")).otherwise(none).alias("absence_ids"))


#: The same rules in words of the corpus at hand.
CORPUS = Phrases(
    absence=("licensed under", "not supported", "provided as is"), out_of_scope=("all rights reserved", "not the aim"), need=("need", "please", "contact", "the"),
    roles=("limits",), types=("spec",), least=2)

_LISTED = lambda ps: "[" + ", ".join(f"'{_plain(p)}'" for p in ps) + "]"
_TERMS_SQL = f"""list_filter(list_transform(regexp_split_to_array(text, '[^0-9A-Za-z가-힣]+'), lambda w: lower(w)), lambda w: length(w) >= 2 AND w NOT IN ({', '.join(f"'{w}'" for w in (*X.GENERIC, *X.ENGLISH))}))"""
#: Subjects are the first five content words of a benchmark item; hold a fifth of the items to needs that the graph links.
GAP_SQL = rf"""qs AS (SELECT item_id, list_slice(list_filter(ws, lambda w, i: list_position(ws, w) = i), 1, 5) AS terms FROM (SELECT item_id, {_TERMS_SQL} AS ws FROM benchmark)),
ev AS (SELECT doc_id, source, lower(regexp_replace(snippet, '\s+', '', 'g')) AS folded, list_distinct(regexp_extract_all(lower(snippet), '[a-z0-9]+')) AS words, lower(trim(regexp_replace(snippet, '\s+', ' ', 'g'))) AS hay,
  lang = 'en' OR source IN ('src1', 'src2', 'src3') AS may FROM evidence),
mk AS (SELECT doc_id, words, hay, may AND len(list_filter({_LISTED(CORPUS.absence)}, lambda p: contains(folded, p))) > 0 AS absent, len(list_filter({_LISTED(CORPUS.out_of_scope)}, lambda p: contains(folded, p))) > 0 AS outside,
  len(list_filter({_LISTED(CORPUS.need)}, lambda p: contains(folded, p))) > 0 AS need FROM ev),
pr AS (SELECT q.item_id, m.* FROM qs q JOIN mk m ON (absent OR outside OR need) AND len(q.terms) > 0
  AND len(list_filter(q.terms, lambda t: CASE WHEN regexp_matches(t, '^[a-z0-9]+$') THEN list_contains(m.words, t) ELSE contains(m.hay, t) END)) >= least(2, len(q.terms))),
fd AS (SELECT item_id, list_sort(list_distinct(list(doc_id) FILTER (absent))) AS absent, bool_or(outside) AS outside, list_sort(list_distinct(list(doc_id) FILTER (need))) AS said FROM pr GROUP BY 1),
lk AS (SELECT item_id, list_sort(list(DISTINCT doc_id)) AS linked FROM benchmark b JOIN observation o ON o.custkey = b.item_id * 7 + 1 WHERE item_id % 5 = 0 AND o.statement = 'error' GROUP BY 1),
gap AS (SELECT b.item_id, coalesce(outside, false) AS out_of_scope, coalesce(len(linked), 0) = 0 AND coalesce(len(said), 0) > 0 AS need_from_text, coalesce(linked, said, []) AS needs, CASE WHEN coalesce(outside, false) THEN [] ELSE coalesce(absent, []) END AS absences,
  CASE WHEN NOT coalesce(outside, false) AND coalesce(len(absent), 0) > 0 THEN 'CONFIRMED' WHEN coalesce(len(linked), 0) + coalesce(len(said), 0) > 0 THEN 'POSSIBLE' ELSE 'UNKNOWN' END AS verdict
  FROM benchmark b LEFT JOIN fd USING (item_id) LEFT JOIN lk USING (item_id))"""


def corpus_gaps(g) -> DataFrame:
    """Gap findings of every benchmark item over all evidence."""
    ev = g.evidence.select(F.col("doc_id").alias("evidence_id"), "snippet", F.when(F.col("lang") == "en", "spec").otherwise("memo").alias("source_type"),
                           F.when(F.col("source").isin("src1", "src2", "src3"), "limits of the product").alias("role"))
    needs = g.benchmark.where("item_id % 5 = 0").select("item_id", (F.col("item_id") * 7 + 1).alias("custkey"))
    needs = g.observation.where("statement = 'error'").join(needs, "custkey").select("item_id", F.col("doc_id").alias("evidence_id"))
    return assess(g.benchmark, ev, needs, phrases=CORPUS, terms=F.slice(X.content_terms(F.col("text")), 1, 5))


@query("X3_gap_verdicts", f"""WITH {GAP_SQL} SELECT item_id, verdict, out_of_scope, need_from_text, len(needs) AS needs, array_to_string(list_slice(needs, 1, 5), '|') AS first_needs, array_to_string(absences, '|') AS absences FROM gap""")
def _x3(g):
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    return corpus_gaps(g).select("item_id", "verdict", "out_of_scope", "need_from_text", F.size("need_ids").cast("long").alias("needs"), ids(F.slice("need_ids", 1, 5)).alias("first_needs"), ids(F.col("absence_ids")).alias("absences"))


_WANT = "CASE item_id % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'POSSIBLE' END"


@query("M6_gap_check", f"""WITH {GAP_SQL}, want AS (SELECT item_id, {_WANT} AS expected FROM benchmark)
SELECT coalesce(expected, 'any') AS expected, count(*) FILTER (expected IS NULL AND verdict <> 'UNKNOWN' AND NOT out_of_scope OR verdict = expected) AS passed, count(*) FILTER (verdict = 'CONFIRMED' AND len(absences) = 0) AS unfounded, count(*) AS n
FROM gap JOIN want USING (item_id) GROUP BY 1""")
def _m6(g):
    """Findings against a golden list: an expected verdict, or a forbidden one and no block; a confirmed one must name its excerpts."""
    v = corpus_gaps(g).withColumn("expected", F.expr(_WANT))
    ok = F.when(F.col("expected").isNull(), (F.col("verdict") != "UNKNOWN") & ~F.col("out_of_scope")).otherwise(F.col("verdict") == F.col("expected"))
    unfounded = (F.col("verdict") == "CONFIRMED") & (F.size("absence_ids") == 0)
    return v.groupBy(F.coalesce("expected", F.lit("any")).alias("expected")).agg(F.count_if(ok).alias("passed"), F.count_if(unfounded).alias("unfounded"), F.count("*").alias("n"))
