"""Browse endpoints as plans: each composes joins and aggregates, and returns one page or one element."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from provena.operators.common import degrees, names, ordered_list, top_per_group
from provena.operators.patterns import permitted, status_rank
from provena.registry import query

_DEG = "deg AS (SELECT label, key, count(*) AS degree FROM (SELECT from_label AS label, from_key AS key FROM edge UNION ALL SELECT to_label, to_key FROM edge) GROUP BY 1, 2)"


@query("B1_overview", """
SELECT 'Account' AS label, count(*) AS n FROM account UNION ALL SELECT 'BusinessDomain', count(*) FROM domain UNION ALL SELECT 'Industry', count(*) FROM industry UNION ALL SELECT 'Deal', count(*) FROM deal
UNION ALL SELECT 'Feature', count(*) FROM feature UNION ALL SELECT 'Claim', count(*) FROM claim UNION ALL SELECT 'Observation', count(*) FROM observation UNION ALL SELECT 'edges', count(*) FROM edge""")
def _b1(g):
    c = lambda df, label: df.agg(F.lit(label).alias("label"), F.count("*").alias("n"))
    out = c(g.account, "Account")
    for label, df in (("BusinessDomain", g.domain), ("Industry", g.industry), ("Deal", g.deal), ("Feature", g.feature), ("Claim", g.claim), ("Observation", g.observation), ("edges", g.edge)):
        out = out.unionByName(c(df, label))
    return out


@query("B2_entities", f"""
WITH {_DEG}, ev AS (SELECT custkey, count(DISTINCT doc_id) AS evidence FROM observation GROUP BY 1)
SELECT a.account, a.kind, m.domain, coalesce(d.degree, 0) AS degree, coalesce(e.evidence, 0) AS evidence FROM account a LEFT JOIN domain m USING (nationkey) LEFT JOIN deg d ON d.label = 'Account' AND d.key = a.account LEFT JOIN ev e USING (custkey)
ORDER BY degree DESC, a.account LIMIT 50""")
def _b2(g, limit=50):
    deg = degrees(g.edge).where("label = 'Account'").select(F.col("key").alias("account"), "degree")
    ev = g.observation.groupBy("custkey").agg(F.countDistinct("doc_id").alias("evidence"))
    a = g.account.join(deg, "account", "left").join(ev, "custkey", "left").join(g.domain, "nationkey", "left")
    out = a.select("account", "kind", "domain", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("evidence", F.lit(0)).alias("evidence"))
    return out.orderBy(F.desc("degree"), "account").limit(limit)


@query("B3_entity", """
WITH k AS (SELECT account FROM account WHERE custkey = 7), r AS (SELECT 'related' AS part, type AS name, to_key AS value, row_number() OVER (PARTITION BY type ORDER BY to_key) AS rn FROM edge WHERE from_label = 'Account' AND from_key IN (FROM k)),
d AS (SELECT 'related' AS part, type AS name, from_key AS value, row_number() OVER (PARTITION BY type ORDER BY from_key) AS rn FROM edge WHERE to_label = 'Account' AND to_key IN (FROM k)),
c AS (SELECT 'claim' AS part, status AS name, CAST(claim_id AS VARCHAR) AS value, claim_id, row_number() OVER (ORDER BY CASE status WHEN 'CRITICAL' THEN 0 WHEN 'VERIFIED' THEN 1 WHEN 'CANDIDATE' THEN 2 ELSE 3 END, claim_id) AS rn FROM claim WHERE custkey = 7),
o AS (SELECT doc_id, min(obs_id) AS o FROM observation WHERE custkey = 7 GROUP BY 1),
e AS (SELECT doc_id, source, locator, row_number() OVER (ORDER BY p, o) AS rn FROM (SELECT v.doc_id, v.source, v.locator, CASE WHEN c.claim_id IS NOT NULL THEN 0 ELSE 1 END AS p, coalesce(o.o, v.doc_id) AS o FROM evidence v LEFT JOIN o USING (doc_id) LEFT JOIN (SELECT claim_id FROM c WHERE rn <= 40) c ON c.claim_id = v.doc_id WHERE o.doc_id IS NOT NULL OR c.claim_id IS NOT NULL)),
s AS (SELECT source, count(*) AS n FROM e GROUP BY 1)
SELECT part, name, value FROM r WHERE rn <= 40 UNION ALL SELECT part, name, value FROM d WHERE rn <= 40 UNION ALL SELECT part, name, value FROM c WHERE rn <= 40
UNION ALL SELECT 'evidence', source, locator FROM e WHERE rn <= 30 UNION ALL SELECT 'source', source, CAST(n AS VARCHAR) FROM s""")
def _b3(g, custkey=7):
    """An account's page: what it is related to, its claims, their evidence topped up with that of its observations, and the sources of all of it."""
    a = g.account.where(F.col("custkey") == custkey).select("account")
    out = g.edge.where("from_label = 'Account'").join(F.broadcast(a), F.col("from_key") == F.col("account")).select("type", F.col("to_key").alias("value"))
    back = g.edge.where("to_label = 'Account'").join(F.broadcast(a), F.col("to_key") == F.col("account")).select("type", F.col("from_key").alias("value"))
    rel = [top_per_group(x, ["type"], [F.col("value")], 40).select(F.lit("related").alias("part"), F.col("type").alias("name"), "value") for x in (out, back)]
    c = g.claim.where(F.col("custkey") == custkey).orderBy(status_rank(), "claim_id").limit(40)
    seen = g.observation.where(F.col("custkey") == custkey).groupBy("doc_id").agg(F.min("obs_id").alias("o"))
    told = c.select(F.col("claim_id").alias("doc_id"), F.lit(True).alias("told"))
    ids = seen.join(told, "doc_id", "full")
    e = g.evidence.select("doc_id", "source", "locator").join(ids, "doc_id")
    top = e.orderBy(F.when(F.col("told"), 0).otherwise(1), F.coalesce("o", "doc_id")).limit(30)
    parts = [*rel, c.select(F.lit("claim").alias("part"), F.col("status").alias("name"), F.col("claim_id").cast("string").alias("value")), top.select(F.lit("evidence").alias("part"), F.col("source").alias("name"), F.col("locator").alias("value")),
             e.groupBy("source").agg(F.count("*").alias("n")).select(F.lit("source").alias("part"), F.col("source").alias("name"), F.col("n").cast("string").alias("value"))]
    return reduce(DataFrame.unionByName, parts)


@query("B4_sources", """
SELECT s.source, s.sensitivity, s.doc_status, count(v.doc_id) AS evidence, string_agg(DISTINCT v.lang, '|' ORDER BY v.lang) AS langs FROM source s LEFT JOIN evidence v USING (source) WHERE s.sensitivity <> 'restricted' GROUP BY 1, 2, 3""")
def _b4(g):
    v = g.evidence.groupBy("source").agg(F.count("*").alias("evidence"), names("lang").alias("langs"))
    return g.source.where("sensitivity <> 'restricted'").join(v, "source", "left").select("source", "sensitivity", "doc_status", F.coalesce("evidence", F.lit(0)).alias("evidence"), "langs")


@query("B5_source", """
WITH v AS (SELECT doc_id, locator, snippet FROM evidence WHERE source = 'src1'), l AS (SELECT a.account, count(*) AS n FROM observation o JOIN v USING (doc_id) JOIN account a USING (custkey) GROUP BY 1),
c AS (SELECT status, count(*) AS n FROM claim WHERE claim_id IN (SELECT doc_id FROM v) GROUP BY 1), r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, count(*) AS n FROM observation WHERE doc_id IN (SELECT doc_id FROM v) GROUP BY 1)
SELECT 'entity' AS part, account AS name, n FROM (SELECT * FROM l ORDER BY n DESC, account LIMIT 20) UNION ALL SELECT 'excerpt', locator, length(snippet) FROM (SELECT * FROM v ORDER BY doc_id LIMIT 30)
UNION ALL SELECT 'claims', status, n FROM c UNION ALL SELECT 'run', run, n FROM (SELECT * FROM r ORDER BY run DESC LIMIT 10)""")
def _b5(g, source="src1"):
    """A source's page: the entities that it tells of most, its first excerpts, its claims by status, and the last runs that read it."""
    v = g.evidence.where(F.col("source") == source).select("doc_id", "locator", F.length("snippet").cast("long").alias("chars"))
    o = g.observation.join(v.select("doc_id"), "doc_id", "left_semi").select("custkey", F.to_date("ts").cast("string").alias("run"))
    part = lambda df, what, name, n: df.select(F.lit(what).alias("part"), F.col(name).alias("name"), F.col(n).alias("n"))
    who = o.groupBy("custkey").agg(F.count("*").alias("n")).join(g.account, "custkey").orderBy(F.desc("n"), "account").limit(20)
    claims = g.claim.join(v.select(F.col("doc_id").alias("claim_id")), "claim_id", "left_semi").groupBy("status").agg(F.count("*").alias("n"))
    runs = o.groupBy("run").agg(F.count("*").alias("n")).orderBy(F.desc("run")).limit(10)
    return reduce(DataFrame.unionByName, [part(who, "entity", "account", "n"), part(v.orderBy("doc_id").limit(30), "excerpt", "locator", "chars"), part(claims, "claims", "status", "n"), part(runs, "run", "run", "n")])


@query("B6_run", """
WITH s AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, statement, count(*) AS added, count(DISTINCT custkey) AS entities FROM observation GROUP BY 1, 2) SELECT run, statement, added, entities FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY added DESC, statement) AS rn FROM s) WHERE rn <= 3""")
def _b6(g):
    s = g.observation.groupBy(F.to_date("ts").cast("string").alias("run"), "statement").agg(F.count("*").alias("added"), F.countDistinct("custkey").alias("entities"))
    return top_per_group(s, ["run"], [F.desc("added"), F.col("statement")], 3).select("run", "statement", "added", "entities")


@query("B7_element", "SELECT claim_id, status, concat_ws(', ', CASE WHEN toxic = 1 THEN 'critical rule fired' END, CASE WHEN quality = 1 THEN 'supported' ELSE 'not supported' END) AS reason FROM claim")
def _b7(g):
    why = F.concat_ws(", ", F.when(F.col("toxic") == 1, "critical rule fired"), F.when(F.col("quality") == 1, "supported").otherwise("not supported"))
    return g.claim.select("claim_id", "status", why.alias("reason"))


@query("B8_health", """
WITH x AS (SELECT 'unmapped need' AS issue, need AS item FROM (SELECT DISTINCT need FROM has_need WHERE need NOT IN (SELECT need FROM addressed_by)) UNION ALL SELECT 'no evidence', account FROM account WHERE custkey NOT IN (SELECT custkey FROM observation)),
r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY item) AS rn FROM x) SELECT issue, count(*) AS shown, min(item) AS first_item FROM r WHERE rn <= 40 GROUP BY 1""")
def _b8(g):
    unmapped = g.has_need.select("need").distinct().join(g.addressed_by, "need", "left_anti").select(F.lit("unmapped need").alias("issue"), F.col("need").alias("item"))
    none = g.account.join(g.observation, "custkey", "left_anti").select(F.lit("no evidence").alias("issue"), F.col("account").alias("item"))
    top = top_per_group(unmapped.unionByName(none), ["issue"], [F.col("item")], 40)
    return top.groupBy("issue").agg(F.count("*").alias("shown"), F.min("item").alias("first_item"))


@query("Q1_ask_entity", """
WITH k AS (SELECT custkey, account FROM account), e AS (SELECT k.account, v.doc_id, v.locator, min(o.obs_id) AS o FROM k JOIN observation o USING (custkey) JOIN evidence v USING (doc_id) JOIN source s USING (source) WHERE s.sensitivity <> 'restricted' AND s.doc_status <> 'deprecated' GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY o) AS rn FROM e) SELECT account, count(*) AS cited, string_agg(locator, '|' ORDER BY rn) AS evidence FROM r WHERE rn <= 24 GROUP BY 1""")
def _q1(g):
    """Link, collect, filter by access, select: one row of evidence a question about an entity."""
    seen = g.observation.groupBy("custkey", "doc_id").agg(F.min("obs_id").alias("o"))
    e = seen.join(g.account, "custkey").join(g.evidence.select("doc_id", "source", "locator"), "doc_id").join(permitted(g.source), "source", "left_semi")
    top = top_per_group(e, ["account"], [F.col("o")], 24)
    return top.groupBy("account").agg(F.count("*").alias("cited"), F.array_join(ordered_list("rn", "locator"), "|").alias("evidence"))
