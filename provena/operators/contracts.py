"""Answers put together, question by question, and held against a contract that is compiled to one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provena.functions import text as X
from provena.operators.common import top_per_group
from provena.operators.rules import scrubbed, verified
from provena.registry import query

#: A field's rule: a type ("string", "integer", "boolean", "array", "object", "enum") with its limits.
Rule = dict


def string(least: int = 0, most: int | None = None) -> Rule:
    return {"is": "string", "least": least, "most": most}


def integer(least: int | None = None) -> Rule:
    return {"is": "integer", "least": least}


def enum(*values: str) -> Rule:
    return {"is": "enum", "values": values}


def array(items: Rule, least: int = 0, most: int | None = None) -> Rule:
    return {"is": "array", "items": items, "least": least, "most": most}


def record(required: dict[str, Rule], optional: dict[str, Rule] | None = None) -> Rule:
    """An object with these fields and no others."""
    return {"is": "object", "fields": required | (optional or {}), "required": tuple(required)}


def nullable(rule: Rule) -> Rule:
    return rule | {"null": True}


BOOLEAN: Rule = {"is": "boolean"}
IDS = array(string())
# The words that an answer may use, and the contract of an answer.
STATUS = enum("VERIFIED", "CANDIDATE", "CRITICAL", "UNVERIFIED", "DISPUTED", "SUPERSEDED", "ARCHIVED")
DOMAIN = enum("product_behavior", "product_intent", "customer_need", "deal_fact", "market_fact")
AUTHORITY = record({"tier": enum("T1", "T2", "T3", "T4", "T5"), "claim_domain": DOMAIN, "source_type": string(1), "policy_version": string()}, {"source_of_record_for": string(), "caveat": string()})
EVIDENCE = record({"evidence_id": string(1), "source_id": string(1), "locator": string(1), "snippet": string(0, 500), "authority_label": AUTHORITY}, {"observed_at": nullable(string()), "extractor": enum("deterministic", "vision"), "masked": BOOLEAN})
BASIS = record({"independent_evidence": integer(0), "highest_authority": string(1), "contradiction": enum("none", "detected"), "recency": enum("current", "aging", "stale", "unknown")}, {"source_type_variety": integer(0)})
GAP_BASIS = record({"reason": string(1)}, {"need_evidence_ids": IDS, "capability_evidence_ids": IDS, "explicit_absence_evidence_ids": IDS, "out_of_scope_by_design": BOOLEAN})
TEMPORAL = record({}, {"valid_from": nullable(string()), "valid_until": nullable(string()), "last_verified_at": nullable(string()), "stale_flag": BOOLEAN})
CLAIM = record({"claim_id": string(), "statement": string(), "status": STATUS}, {"lane": array(enum("default", "critical", "conflict")), "claim_kind": string(1), "evidence_ids": IDS, "temporal": TEMPORAL, "contradicted_by": IDS})
NODE = record({"id": string(), "labels": array(string(), 1), "label_text": string(), "rank": enum("focal", "cited", "supporting")}, {"status": nullable(STATUS), "citation_markers": array(integer()), "expanded": BOOLEAN})
EDGE = record({"from": string(), "to": string(), "type": string()}, {"claim_ids": IDS, "status": nullable(STATUS), "cited": BOOLEAN})
ANSWER = record(
    {
        "answer": record({"text": string(1)}, {"recommendation": string(), "estimated_parts": IDS}),
        "citations": array(record({"marker": integer(1), "evidence_id": string(1)}, {"quoted_span": string()})),
        "evidence": array(EVIDENCE),
        "evidence_strength": record({"band": enum("HIGH", "MEDIUM", "LOW"), "basis": BASIS}),
        "unknowns": array(string()),
        "gaps": array(record({"subject": string(1), "verdict": enum("CONFIRMED", "POSSIBLE", "UNKNOWN"), "basis": GAP_BASIS})),
        "subgraph": record({"nodes": array(NODE, 0, 50), "edges": array(EDGE, 0, 100)}, {"truncated": BOOLEAN}),
        "route": record({"retriever": enum("Q-E", "Q-M", "Q-S")}, {"matched_rule": string(), "llm_classifier_used": BOOLEAN, "claim_domain": DOMAIN, "domain_classification_failed": BOOLEAN}),
        "notices": record({"results_may_be_incomplete": BOOLEAN}, {"stale_labeled_count": integer(0), "critical_unverified_included": BOOLEAN, "raw_signal_count": integer(0)}),
    },
    {
        "raw_signals": array(record({"evidence_id": string(), "snippet": string(0, 500), "locator": string(), "source_id": string()}, {"match_terms": IDS, "in_graph": BOOLEAN})),
        "disputes": array(record({"subject": string(), "sides": array(record({"statement": string(), "evidence_ids": array(string(), 1)}), 2)})),
        "claims": array(CLAIM),
        "next_actions": array(string()),
        "query_id": string(), "policy_version": string(), "answered_at": string(),
    },
)

_NONE = "CAST(array() AS array<string>)"


def faults(v: Column, rule: Rule, path: Column | None = None) -> Column:
    """Faults of a VARIANT by place, in the order of the rule's fields: missing and unknown fields, wrong types, values out of their limits.

    The rule becomes one expression, with a transform for each array, so answers of any number are checked in one pass.
    """
    at = F.lit("$") if path is None else path
    none = F.expr(_NONE)
    say = lambda *what: F.concat(at, F.lit(": "), *[w if isinstance(w, Column) else F.lit(str(w)) for w in what])
    only = lambda bad, *what: F.when(bad, F.array(say(*what))).otherwise(none)
    seen = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    kind = rule["is"]
    if kind == "object":
        fields = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string, variant>")), none)
        lacks = [only(~F.array_contains(fields, k), f"'{k}' is missing") for k in rule["required"]]
        odd = F.transform(F.array_sort(F.array_except(fields, F.array(*map(F.lit, rule["fields"])))), lambda k: say("'", k, "' is not allowed"))
        inner = [F.when(F.array_contains(fields, k), faults(F.try_variant_get(v, f"$['{k}']", "variant"), r, F.concat(at, F.lit(f".{k}")))).otherwise(none) for k, r in rule["fields"].items()]
        ok, found = F.startswith(seen, F.lit("OBJECT")), F.concat(*lacks, odd, *inner)
    elif kind == "array":
        xs = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.expr("CAST(array() AS array<variant>)"))
        inner = F.flatten(F.transform(xs, lambda x, i: faults(x, rule["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
        few = [only(F.size(xs) < rule["least"], f"fewer than {rule['least']} items")] if rule["least"] else []
        many = [only(F.size(xs) > rule["most"], f"more than {rule['most']} items")] if rule["most"] is not None else []
        ok, found = F.startswith(seen, F.lit("ARRAY")), F.concat(*few, *many, inner)
    elif kind in ("string", "enum"):
        s = F.try_variant_get(v, "$", "string")
        ok = seen == "STRING"
        if kind == "enum":
            found = only(~s.isin(*rule["values"]), "'", s, "' is none of its values")
        else:
            short = only(F.length(s) < rule["least"], f"shorter than {rule['least']}") if rule["least"] else none
            found = F.concat(short, only(F.length(s) > rule["most"], f"longer than {rule['most']}")) if rule["most"] is not None else short
    elif kind == "integer":
        ok = seen.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
        found = only(F.try_variant_get(v, "$", "decimal(38,0)") < rule["least"], f"below {rule['least']}") if rule["least"] is not None else none
    else:
        ok, found = seen == "BOOLEAN", none
    out = F.when(ok, found).otherwise(F.array(say(f"not of type {kind}")))
    return F.when(seen == "VOID", none).otherwise(out) if rule.get("null") else out


def answer_faults(answer: Column) -> Column:
    """Faults of an answer's JSON; of a text that is none, that alone.  Beside the contract's own: a citation has to point at evidence that the answer carries."""
    v = F.try_parse_json(answer)
    ids = lambda p: F.coalesce(F.from_json(F.to_json(F.try_variant_get(v, p, "variant")), "array<struct<evidence_id: string>>"), F.expr("CAST(array() AS array<struct<evidence_id: string>>)"))
    loose = F.array_sort(F.array_except(F.transform(ids("$.citations"), lambda c: c["evidence_id"]), F.transform(ids("$.evidence"), lambda e: e["evidence_id"])))
    loose = F.transform(F.filter(loose, lambda i: i.isNotNull()), lambda i: F.concat(F.lit("$.citations: no evidence '"), i, F.lit("'")))
    return F.when(v.isNull(), F.array(F.lit("$: no JSON"))).otherwise(F.concat(faults(v, ANSWER), loose))


#: How much of each kind an answer carries, and days until records are no longer current.
EVIDENCE_LIMIT, RAW_LIMIT, CLAIM_LIMIT, SNIPPET, CURRENT_DAYS = 20, 20, 30, 500, 730
#: Markers alone between two ends: they belong to the sentence before.
LATE_MARKERS = r"([.!?。])[ \t]*(\[\d{1,3}\](?:\s*\[\d{1,3}\])*)[ \t]*(?:[.!?。]|(?=\n)|$)"
NOTHING = "The confirmed records don't allow an answer."


def _listed(df: DataFrame, name: str, order: list[Column], most: int, item: Column) -> DataFrame:
    """(qid, name): at most so many structs a question, in order; Spark drops the rest before the shuffle."""
    top = top_per_group(df, ["qid"], order, most).select("qid", F.struct("rn", item.alias("x")).alias("x"))
    return top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list("x")), lambda r: r["x"]).alias(name))


def assemble(asks: DataFrame, evidence: DataFrame, raw: DataFrame, claims: DataFrame, today: str, policy_version: str = "1", limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """(qid, answer, faults, dropped, removed): each question's answer as JSON, what the contract finds wrong, markers dropped and sentences removed.

    asks (qid, unique; question, text, citations array<struct<marker, evidence_id>>, retriever, claim_domain, incomplete); evidence (qid, place,
    evidence_id, source_id, locator, snippet, tier, source_type, observed_at); raw (the first six); claims (qid, claim_id, statement, status).

    Excerpts with personal data are left out, then the first `limit` by place stay.  Markers behind a sentence's end are drawn into it.  Markers whose evidence
    isn't there go with the sentences that cite nothing else; then sentences with numbers or names that neither the carried excerpts nor the question hold.  Citations that the text
    no longer has go too, and raw signals that became evidence.  A null text, or one of which nothing is left, says that there is no answer.
    """
    cut = F.substring("snippet", 1, SNIPPET)
    clean = lambda df: df.withColumn("snippet", cut).where(~F.coalesce(F.col("snippet").rlike(X.EMAIL), F.lit(False)))
    label = F.struct("tier", F.col("claim_domain"), "source_type", F.lit(policy_version).alias("policy_version"))
    seen = F.date_format("observed_at", "yyyy-MM-dd").alias("observed_at")
    e = clean(evidence).join(asks.select("qid", "claim_domain"), "qid")
    place = [F.col("place"), F.col("evidence_id")]
    e = _listed(e, "evidence", place, limit, F.struct("evidence_id", "source_id", "locator", "snippet", label.alias("authority_label"), seen))
    r = _listed(clean(raw), "raw", place, RAW_LIMIT + limit, F.struct("evidence_id", "source_id", "locator", "snippet"))  # up to `limit` of them may be evidence
    c = _listed(claims, "claims", [F.col("claim_id")], CLAIM_LIMIT, F.struct(F.col("claim_id").cast("string").alias("claim_id"), "statement", "status"))
    none = lambda name, df: F.coalesce(name, F.expr(f"CAST(array() AS {df.schema[name].dataType.simpleString()})"))
    x = asks.join(e, "qid", "left").join(r, "qid", "left").join(c, "qid", "left")
    x = x.withColumn("evidence", none("evidence", e)).withColumn("claims", none("claims", c)).withColumn("raw", none("raw", r))
    ids = F.transform("evidence", lambda i: i["evidence_id"])
    raws = F.slice(F.filter("raw", lambda i: ~F.array_contains(ids, i["evidence_id"])), 1, RAW_LIMIT)
    held = F.filter(F.coalesce("citations", F.expr("CAST(array() AS array<struct<marker: int, evidence_id: string>>)")), lambda k: F.array_contains(ids, k["evidence_id"]))
    x = x.withColumn("raw", raws).withColumn("held", held)
    x = x.select("*", F.explode(F.array(verified(F.regexp_replace(F.coalesce("text", F.lit("")), LATE_MARKERS, " $2$1"), F.transform("held", lambda k: k["marker"])))).alias("v"))

    snippets = lambda name: F.transform(name, lambda i: i["snippet"])
    support = F.array_join(F.concat(snippets("evidence"), snippets("raw")), "\n")
    gated = scrubbed(x.select(F.col("qid").alias("doc_id"), support.alias("support"), "question", X.sentences(F.col("v.text")).alias("sentences")), marked=True)
    x = x.join(gated.select(F.col("doc_id").alias("qid"), F.col("answer").alias("said"), F.size("log").alias("removed")), "qid")

    alive = F.transform(F.regexp_extract_all("said", F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda m: m.cast("int"))
    sources = F.array_distinct(F.transform("evidence", lambda i: i["source_id"]))
    best = F.array_min(F.transform("evidence", lambda i: F.struct(i["authority_label"]["tier"].alias("tier"), i["authority_label"]["source_type"].alias("source_type"))))
    age = F.datediff(F.lit(today).cast("date"), F.array_max(F.transform("evidence", lambda i: i["observed_at"])).cast("date"))
    band = F.when(best["tier"].isNull() | (best["tier"] >= "T4"), "LOW").when((best["tier"] == "T1") & (age <= CURRENT_DAYS), "HIGH").otherwise("MEDIUM")
    recency = F.when(age.isNull(), "unknown").when(age <= CURRENT_DAYS, "current").otherwise("stale")
    basis = F.struct(F.size(sources).alias("independent_evidence"), F.coalesce(best["source_type"], F.lit("none")).alias("highest_authority"), F.lit("none").alias("contradiction"), recency.alias("recency"))
    nodes = F.transform(sources, lambda s: F.struct(s.alias("id"), F.array(F.lit("Source")).alias("labels"), s.alias("label_text"), F.lit("cited").alias("rank")))
    empty = lambda t: F.expr(f"CAST(array() AS array<{t}>)")
    payload = F.struct(
        F.struct(F.when(F.trim("said") == "", NOTHING).otherwise(F.col("said")).alias("text")).alias("answer"),
        F.filter("held", lambda k: F.array_contains(alive, k["marker"])).alias("citations"), "evidence",
        F.struct(band.alias("band"), basis.alias("basis")).alias("evidence_strength"),
        F.when(F.size("evidence") == 0, F.array(F.concat(F.lit("No record was found for: "), F.coalesce("question", F.lit(""))))).otherwise(empty("string")).alias("unknowns"),
        F.transform("raw", lambda i: F.struct(i["evidence_id"].alias("evidence_id"), i["snippet"].alias("snippet"), i["locator"].alias("locator"), i["source_id"].alias("source_id"))).alias("raw_signals"),
        empty("string").alias("gaps"), "claims", F.struct(F.slice(nodes, 1, 50).alias("nodes"), empty("string").alias("edges")).alias("subgraph"),
        F.struct("retriever", "claim_domain").alias("route"),
        F.struct(F.coalesce("incomplete", F.lit(False)).alias("results_may_be_incomplete"), F.size("raw").alias("raw_signal_count"), F.exists("claims", lambda k: k["status"] == "CRITICAL").alias("critical_unverified_included")).alias("notices"))
    x = x.select("qid", F.to_json(payload).alias("answer"), F.size("v.dropped").cast("long").alias("dropped"), F.col("removed").cast("long").alias("removed"))
    return x.select("qid", F.explode(F.array("answer")).alias("answer"), "dropped", "removed").select("*", answer_faults(F.col("answer")).alias("faults"))


def ddl(rule: Rule) -> str:
    """The Spark type of what a rule describes."""
    kind = rule["is"]
    if kind == "object":
        return "struct<" + ", ".join(f"`{k}`: {ddl(r)}" for k, r in rule["fields"].items()) + ">"
    return f"array<{ddl(rule['items'])}>" if kind == "array" else {"integer": "bigint", "boolean": "boolean"}.get(kind, "string")


#: The kinds that no answer may show.
SWEPT = ("mobile", "landline", "service", "email", "resident")
_PATTERNS = [rx for k in SWEPT for kind, rx, _, _ in X.DETECTORS if kind == k]
#: Numbers that only look like them; one that starts as a mobile number does is searched all the same.
_GUARDS = "|".join(f"(?:{g})" for g in (*X.GUARDS[:2], X.GUARDS[2].replace(r"\d+\.", r"(?!010)\d+\.", 1)))


def personal_values(text: Column) -> Column:
    """Personal data of a text, kind by kind; null has none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _GUARDS, "")
    return F.concat(*[F.regexp_extract_all(t, F.lit(rx), F.lit(0)) for rx in _PATTERNS])


def covered(text: Column) -> Column:
    """A text whose personal data is stars, letter by letter; marks between them stay."""
    return F.aggregate(personal_values(text), text, lambda t, v: F.replace(t, v, F.regexp_replace(v, "[0-9A-Za-z]", "*")))


def swept(answer: Column) -> Column:
    """struct<answer, hits> of an answer's JSON: the last gate, for places that no sentence can be taken out of.

    Text and recommendation, locators and snippets of evidence and raw signals, and labels of nodes are covered; `hits` has what was found there, by
    place.  Without a hit the JSON stays as it is; else fields that the contract doesn't know, and nulls, aren't written again.  What is no JSON stays, too.
    """
    a = F.from_json(answer, ddl(ANSWER))
    empty = F.array().cast("array<string>")
    texts = lambda xs, *fs: F.coalesce(F.flatten(F.transform(xs, lambda x: F.array(*[x[f] for f in fs]))), empty)
    places = F.concat(F.array(a["answer"]["text"], a["answer"]["recommendation"]), texts(a["evidence"], "locator", "snippet"), texts(a["raw_signals"], "locator", "snippet"), texts(a["subgraph"]["nodes"], "label_text"))
    hits = F.flatten(F.transform(places, personal_values))

    def over(xs: Column, *fs: str) -> Column:
        def one(x: Column) -> Column:
            for f in fs:
                x = x.withField(f, covered(x[f]))
            return x
        return F.transform(xs, one)

    clean = a.withField("evidence", over(a["evidence"], "locator", "snippet")).withField("raw_signals", over(a["raw_signals"], "locator", "snippet"))
    clean = clean.withField("answer", F.when(a["answer"].isNotNull(), a["answer"].withField("text", covered(a["answer"]["text"])).withField("recommendation", covered(a["answer"]["recommendation"]))))
    clean = clean.withField("subgraph", F.when(a["subgraph"].isNotNull(), a["subgraph"].withField("nodes", over(a["subgraph"]["nodes"], "label_text"))))
    return F.struct(F.when(F.size(hits) > 0, F.to_json(clean)).otherwise(answer).alias("answer"), F.coalesce(hits, empty).alias("hits"))


_SHOWN = """SELECT doc_id, concat(text, ' Ask 010-', cast(1000 + doc_id % 9000 AS string), '-5678') AS said, concat(locator, ' a', cast(doc_id AS string), '@b.org') AS locator, text AS snippet, concat('Node ', cast(doc_id AS string), ' 02 345 6789 v1.2.3') AS label FROM (SELECT doc_id, snippet AS text, locator FROM {evidence})"""


def _cover(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, '(^|[^0-9])1[0-9]{{12}}([^0-9]|$)', '\\1\\2', 'g'), '(^|[^0-9.])[0-9]+\\.[0-9]+\\.[0-9]+(?:[.\\-][\\w\\-]+)*', '\\1', 'g')"
    found = ", ".join(f"regexp_extract_all({bare}, '{rx}')" for rx in _PATTERNS)
    return f"list_reduce(list_prepend({c}, list_concat({found})), lambda t, v: replace(t, v, regexp_replace(v, '[0-9A-Za-z]', '*', 'g')))"


@query("Q11_sweep_redaction", f"WITH s AS ({_SHOWN.replace('{', '').replace('}', '').replace('AS string', 'AS VARCHAR')}) SELECT doc_id, {_cover('said')} AS said, {_cover('locator')} AS locator, {_cover('snippet')} AS snippet, {_cover('label')} AS label FROM s")
def _q11(g):
    """Every document's text as an answer with a telephone number, under a locator with an address and a node with a number."""
    s = g.spark.sql(_SHOWN, evidence=g.evidence)
    node = F.struct(F.col("label").alias("label_text"))
    a = F.struct(F.struct(F.col("said").alias("text")).alias("answer"), F.array(F.struct("locator", "snippet")).alias("evidence"), F.struct(F.array(node).alias("nodes")).alias("subgraph"))
    x = s.select("doc_id", F.explode(F.array(swept(F.to_json(a)))).alias("x")).select("doc_id", F.explode(F.array(F.from_json("x.answer", ddl(ANSWER)))).alias("a"))
    e = F.get("a.evidence", F.lit(0))
    return x.select("doc_id", F.col("a.answer.text").alias("said"), e["locator"].alias("locator"), e["snippet"].alias("snippet"), F.get("a.subgraph.nodes", F.lit(0))["label_text"].alias("label"))


#: What the query asks: of each source, its first records; a marker that nothing backs, a name that no record holds, and a route that the contract doesn't know.
_ASKED = """SELECT source AS qid, concat('What do we know of ', source, '?') AS question, CASE substr(source, length(source), 1) WHEN '3' THEN 'Q-X' ELSE 'Q-E' END AS retriever FROM {source}"""
_PLACED = """SELECT doc_id, source AS qid, source, doc_id AS place, concat('E', cast(doc_id AS string)) AS evidence_id, locator, substr(snippet, 1, 500) AS snippet, CASE lang WHEN 'en' THEN 'T1' WHEN 'fr' THEN 'T4' ELSE 'T2' END AS tier, CASE lang WHEN 'en' THEN 'spec' WHEN 'fr' THEN 'brochure' ELSE 'log' END AS source_type FROM {evidence}"""
_BARE = "regexp_replace({}, '[.!?。]+$', '')"
_PROSE = "concat_ws(' ', concat(" + _BARE.format("coalesce({0}, 'none')") + ", ' [1].'), 'Nothing backs this [9].', concat('zorbex met Zorbex in ', question, ' [2].'))"


@query("Q13_answer_assembly", rf"""WITH a AS ({_ASKED.replace('{', '').replace('}', '')}), p AS ({_PLACED.replace('{', '').replace('}', '').replace('AS string', 'AS VARCHAR')}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, evidence_id) AS rn FROM p WHERE NOT coalesce(regexp_matches(snippet, '{X.EMAIL}'), false)),
e AS (SELECT qid, count(*) FILTER (rn <= 4) AS evidence, count(*) FILTER (rn BETWEEN 5 AND 6) AS raw, min(snippet) FILTER (rn = 1) AS s1, min(tier) FILTER (rn <= 4) AS tier, string_agg(CASE WHEN rn <= 4 THEN evidence_id END, ',' ORDER BY rn) AS ids FROM r GROUP BY 1),
c AS (SELECT v.source AS qid, count(*) AS n, count(*) FILTER (toxic = 1 AND quality = 1) AS critical FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM labels JOIN evidence USING (doc_id)) v WHERE rn <= 30 GROUP BY 1)
SELECT a.qid, regexp_replace(coalesce(({X.SENTENCES_SQL.format('s1')})[1], 'none'), '[.!?。]+$', '') || ' [1].' AS said, coalesce(ids, '') AS ids, CASE WHEN evidence > 0 THEN '1' ELSE '' END AS markers, coalesce(raw, 0) AS raw, coalesce(c.n, 0) AS claims, coalesce(critical, 0) > 0 AS critical,
  CASE WHEN coalesce(tier, 'T5') >= 'T4' THEN 'LOW' WHEN tier = 'T1' THEN 'HIGH' ELSE 'MEDIUM' END AS band, 1 AS dropped, CASE WHEN retriever = 'Q-X' THEN '$.route.retriever: ''Q-X'' is none of its values' ELSE '' END AS faults
FROM a JOIN e USING (qid) LEFT JOIN c USING (qid)""")
def _q13(g, limit=4):
    a = g.spark.sql(_ASKED, source=g.source)
    p = g.spark.sql(_PLACED, evidence=g.evidence).withColumn("observed_at", F.lit("2024-06-01").cast("date")).withColumnRenamed("source", "source_id")
    clean = p.where(~F.coalesce(F.col("snippet").rlike(X.EMAIL), F.lit(False)))
    first = top_per_group(clean, ["qid"], [F.col("place"), F.col("evidence_id")], 6)
    cited = first.groupBy("qid").agg(F.max(F.when(F.col("rn") == 1, F.col("snippet"))).alias("s1"), F.max(F.when(F.col("rn") == 1, F.col("evidence_id"))).alias("e1"), F.max(F.when(F.col("rn") == 2, F.col("evidence_id"))).alias("e2"))
    mark = lambda n, c: F.struct(F.lit(n).alias("marker"), c.alias("evidence_id"))
    a = a.join(cited, "qid").withColumn("s1", F.get(X.sentences(F.col("s1")), F.lit(0))).withColumn("text", F.expr(_PROSE.format("s1")))
    a = a.select("qid", "question", "retriever", "text", F.array(mark(1, F.col("e1")), mark(2, F.col("e2")), mark(9, F.lit("E-none"))).alias("citations"), F.lit("deal_fact").alias("claim_domain"), F.lit(False).alias("incomplete"))
    status = F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "CRITICAL").otherwise("CANDIDATE")
    c = g.labels.join(g.evidence.select("doc_id", F.col("source").alias("qid")), "doc_id").select("qid", F.col("doc_id").alias("claim_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("statement"), status.alias("status"))
    out = assemble(a, p, first.where("rn > 2"), c, "2025-01-15", limit=limit)
    at = lambda path, t="string": F.try_variant_get(F.parse_json("answer"), path, t)
    size = lambda path: F.size(at(path, "array<variant>")).cast("long")
    every = lambda path, key: F.array_join(F.transform(at(path, "array<variant>"), lambda v: F.try_variant_get(v, f"$.{key}", "string")), ",")
    return out.select(
        "qid", at("$.answer.text").alias("said"), every("$.evidence", "evidence_id").alias("ids"), every("$.citations", "marker").alias("markers"), size("$.raw_signals").alias("raw"), size("$.claims").alias("claims"),
        at("$.notices.critical_unverified_included", "boolean").alias("critical"), at("$.evidence_strength.band").alias("band"), "dropped", F.array_join("faults", "; ").alias("faults"))
