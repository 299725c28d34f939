"""Named multi-hop aggregations over the graph (templates) and the aggregation idioms they rest on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from provena.operators.common import capped, degrees, names, ordered_list, top_per_group
from provena.plans.fixture import Graph
from provena.registry import query


def common_needs(g: Graph, min_domains: int = 2, limit: int = 25) -> DataFrame:
    """Needs that reach several domains through deals, with all their holders.

    The first stage counts domains a need on narrow distinct pairs; holders are joined back after the cut.
    """
    dealt = g.deal.select("custkey").distinct()
    path = g.has_need.join(dealt, "custkey", "left_semi").join(g.domain.select("nationkey", "domain"), "nationkey")
    domains = path.select("need", "domain").distinct().groupBy("need").agg(names("domain").alias("domains"), F.count("*").alias("domain_count")).where(F.col("domain_count") >= min_domains)
    held = g.has_need.groupBy("need").agg(names("account").alias("accounts"), F.countDistinct("account").alias("account_count"))
    return domains.join(held, "need").orderBy(F.desc("domain_count"), F.desc("account_count"), "need").limit(limit)


@query("A4_common_needs_across_domains", """
WITH d AS (SELECT h.need, string_agg(DISTINCT m.domain, '|' ORDER BY m.domain) AS domains, count(DISTINCT m.domain) AS domain_count
  FROM has_need h JOIN domain m USING (nationkey) WHERE h.custkey IN (SELECT custkey FROM deal) GROUP BY 1 HAVING count(DISTINCT m.domain) >= 8),
a AS (SELECT need, string_agg(DISTINCT account, '|' ORDER BY account) AS accounts, count(DISTINCT account) AS account_count FROM has_need GROUP BY 1)
SELECT * FROM d JOIN a USING (need) ORDER BY domain_count DESC, account_count DESC, need LIMIT 25""")
def _a4(g):
    return common_needs(g, 8)


@query("J8_path_join_with_having", """
SELECT h.need, count(DISTINCT m.domain) AS domain_count, count(DISTINCT x.deal_id) AS deals
FROM has_need h JOIN domain m USING (nationkey) JOIN deal x ON x.custkey = h.custkey GROUP BY 1 HAVING count(DISTINCT m.domain) >= 4""")
def _j8(g):
    # deals are counted an account first, so the path does not multiply rows
    deals = g.deal.groupBy("custkey").agg(F.count("*").alias("n"))
    p = g.has_need.join(deals, "custkey").join(g.domain.select("nationkey", "domain"), "nationkey")
    return p.groupBy("need").agg(F.countDistinct("domain").alias("domain_count"), F.sum("n").alias("deals")).where("domain_count >= 4")


@query("A5_accounts_with_need", """
SELECT h.need, h.account, string_agg(DISTINCT i.industry, '|' ORDER BY i.industry) AS industries
FROM has_need h LEFT JOIN domain d USING (nationkey) LEFT JOIN industry i USING (regionkey)
WHERE lower(h.need) LIKE '%red%' OR lower(h.need) LIKE '%part1%' OR lower(h.need) LIKE '%a%' GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 50""")
def _a5(g, terms=("red", "part1", "a"), limit=50):
    hit = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("need"), t))
    n = g.has_need.where(hit).join(g.domain, "nationkey", "left").join(g.industry, "regionkey", "left")
    return n.groupBy("need", "account").agg(names("industry").alias("industries")).orderBy("need", "account").limit(limit)


@query("A6_industries_using_capability", """
WITH p AS (SELECT DISTINCT b.capability, i.industry, h.account, h.need FROM addressed_by b JOIN has_need h USING (need) LEFT JOIN domain d USING (nationkey) LEFT JOIN industry i USING (regionkey)),
f AS (SELECT capability, count(DISTINCT feature_id) AS feature_count FROM feature GROUP BY 1)
SELECT capability, string_agg(DISTINCT industry, '|' ORDER BY industry) AS industries, count(DISTINCT industry) AS industry_count, count(DISTINCT account) AS account_count,
  string_agg(DISTINCT need, '|' ORDER BY need) AS needs, any_value(feature_count) AS feature_count
FROM p JOIN f USING (capability) GROUP BY 1""")
def _a6(g):
    p = g.addressed_by.join(g.has_need, "need").join(g.domain, "nationkey", "left").join(g.industry, "regionkey", "left")
    agg = p.groupBy("capability").agg(names("industry").alias("industries"), F.countDistinct("industry").alias("industry_count"), F.countDistinct("account").alias("account_count"), names("need").alias("needs"))
    features = g.feature.groupBy("capability").agg(F.countDistinct("feature_id").alias("feature_count"))
    return agg.join(features, "capability")


@query("A7_deals_by_domain", """
SELECT m.domain, count(*) AS deals, count(*) FILTER (outcome = 'won') AS won, count(*) FILTER (outcome = 'lost') AS lost,
  string_agg(DISTINCT stage, '|' ORDER BY stage) AS stages, CAST(round(sum(CAST(amount AS DECIMAL(18, 4))), 2) AS DOUBLE) AS amount
FROM deal x JOIN account a USING (custkey) JOIN domain m USING (nationkey) GROUP BY 1""")
def _a7(g):
    p = g.deal.join(g.account, "custkey").join(g.domain, "nationkey")
    money = F.round(F.sum(F.col("amount").cast("decimal(18,4)")), 2).cast("double")
    return p.groupBy("domain").agg(F.count("*").alias("deals"), F.count_if(F.col("outcome") == "won").alias("won"), F.count_if(F.col("outcome") == "lost").alias("lost"), names("stage").alias("stages"), money.alias("amount"))


@query("A8_domains_by_status", """
SELECT m.bd_status, m.domain, any_value(i.industry) AS industry, count(DISTINCT a.custkey) AS accounts
FROM domain m LEFT JOIN industry i USING (regionkey) LEFT JOIN account a USING (nationkey) WHERE m.bd_status IN ('managed', 'candidate') GROUP BY 1, 2""")
def _a8(g, statuses=("managed", "candidate")):
    n = g.account.groupBy("nationkey").agg(F.countDistinct("custkey").alias("accounts"))
    m = g.domain.where(F.col("bd_status").isin(*statuses)).join(g.industry, "regionkey", "left").join(n, "nationkey", "left")
    return m.select("bd_status", "domain", "industry", F.coalesce("accounts", F.lit(0)).alias("accounts"))


@query("A9_feature_version_history", """
SELECT name, string_agg(DISTINCT introduced_in, '|' ORDER BY introduced_in) AS versions, min(introduced_in) AS first_version, count(*) AS features,
  string_agg(DISTINCT area, '|' ORDER BY area) AS areas FROM feature GROUP BY 1""")
def _a9(g):
    return g.feature.groupBy("name").agg(names("introduced_in").alias("versions"), F.min("introduced_in").alias("first_version"), F.count("*").alias("features"), names("area").alias("areas"))


@query("A10_domain_overview", """
WITH o AS (SELECT a.nationkey, b.doc_id, row_number() OVER (PARTITION BY a.nationkey ORDER BY b.obs_id) AS rn FROM observation b JOIN account a USING (custkey)),
d AS (SELECT a.nationkey, count(*) AS deals FROM deal x JOIN account a USING (custkey) GROUP BY 1)
SELECT m.domain, m.bd_status, coalesce(any_value(d.deals), 0) AS deals, string_agg(CAST(o.doc_id AS VARCHAR), '|' ORDER BY o.rn) AS evidence
FROM domain m LEFT JOIN d USING (nationkey) LEFT JOIN o ON o.nationkey = m.nationkey AND o.rn <= 6 GROUP BY 1, 2""")
def _a10(g):
    o = top_per_group(g.observation.join(g.account, "custkey"), ["nationkey"], [F.col("obs_id")], 6)
    ev = o.groupBy("nationkey").agg(F.array_join(ordered_list("rn", "doc_id"), "|").alias("evidence"))
    deals = g.deal.join(g.account, "custkey").groupBy("nationkey").agg(F.count("*").alias("deals"))
    return g.domain.join(deals, "nationkey", "left").join(ev, "nationkey", "left").select("domain", "bd_status", F.coalesce("deals", F.lit(0)).alias("deals"), "evidence")


@query("A11_industry_scope", """
SELECT i.industry, count(DISTINCT a.custkey) AS accounts, string_agg(DISTINCT m.domain, '|' ORDER BY m.domain) AS domains
FROM industry i LEFT JOIN domain m USING (regionkey) LEFT JOIN account a USING (nationkey) GROUP BY 1""")
def _a11(g):
    p = g.industry.join(g.domain, "regionkey", "left").join(g.account, "nationkey", "left")
    return p.groupBy("industry").agg(F.countDistinct("custkey").alias("accounts"), names("domain").alias("domains"))


@query("A12_competitor_scope", """
SELECT s.s_name AS competitor, m.domain, count(DISTINCT l.l_partkey) AS parts FROM supplier s LEFT JOIN domain m ON m.nationkey = s.s_nationkey
LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2""")
def _a12(g):
    parts = g.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))
    s = g.supplier.join(g.domain, g.supplier.s_nationkey == F.col("nationkey"), "left").join(parts, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select(F.col("s_name").alias("competitor"), "domain", F.coalesce("parts", F.lit(0)).alias("parts"))


@query("A1_flatten_collect", """
SELECT need, string_agg(CAST(orderkey AS VARCHAR), '|' ORDER BY custkey, orderkey) AS ids, count(*) AS n FROM need_row GROUP BY 1""")
def _a1(g):
    per = g.need_row.groupBy("need", "custkey").agg(F.sort_array(F.collect_list("orderkey")).alias("ids"))
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("custkey", "ids"))), lambda x: x.ids))
    return per.groupBy("need").agg(flat.alias("f")).select("need", F.array_join("f", "|").alias("ids"), F.size("f").cast("long").alias("n"))


@query("A2_round_robin_flatten", """
WITH r AS (SELECT need, custkey, orderkey, row_number() OVER (PARTITION BY need, custkey ORDER BY orderkey) AS i FROM need_row)
SELECT need, string_agg(CAST(orderkey AS VARCHAR), '|' ORDER BY i, custkey) AS ids FROM r WHERE i <= 6 GROUP BY 1""")
def _a2(g):
    # six rows of a customer at most, before any list is made
    per = top_per_group(g.need_row.select("need", "custkey", "orderkey"), ["need", "custkey"], [F.col("orderkey")], 6, "i")
    turn = F.transform(F.sort_array(F.collect_list(F.struct("i", "custkey", "orderkey"))), lambda x: x.orderkey)
    return per.groupBy("need").agg(F.array_join(turn, "|").alias("ids"))


@query("A3_ordered_distinct_cap", """
WITH f AS (SELECT need, custkey, min(orderkey) AS o FROM need_row GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY need ORDER BY o, custkey) AS i FROM f)
SELECT need, string_agg(CAST(custkey AS VARCHAR), '|' ORDER BY i) AS ids FROM r WHERE i <= 6 GROUP BY 1""")
def _a3(g):
    first = g.need_row.groupBy("need", "custkey").agg(F.min("orderkey").alias("o"))
    six = top_per_group(first, ["need"], [F.col("o"), F.col("custkey")], 6, "i")
    return six.groupBy("need").agg(F.array_join(ordered_list("i", "custkey"), "|").alias("ids"))


@query("A13_evidence_by_source_section", "SELECT source, lang AS section, count(*) AS n FROM evidence GROUP BY 1, 2")
def _a13(g):
    return g.evidence.groupBy("source", F.col("lang").alias("section")).agg(F.count("*").alias("n"))


@query("A14_rare_sections", "SELECT source, lang AS section, count(*) AS n FROM evidence GROUP BY 1, 2 HAVING count(*) <= 12")
def _a14(g):
    return g.evidence.groupBy("source", F.col("lang").alias("section")).agg(F.count("*").alias("n")).where("n <= 12")


@query("A16_overview", """
WITH d AS (SELECT a.nationkey, count(DISTINCT x.deal_id) AS deals FROM deal x JOIN account a USING (custkey) GROUP BY 1),
a AS (SELECT nationkey, count(DISTINCT custkey) AS accounts FROM account GROUP BY 1), n AS (SELECT nationkey, count(DISTINCT need) AS needs FROM has_need GROUP BY 1)
SELECT m.domain, coalesce(deals, 0) AS deals, coalesce(accounts, 0) AS accounts, coalesce(needs, 0) AS needs FROM domain m LEFT JOIN d USING (nationkey) LEFT JOIN a USING (nationkey) LEFT JOIN n USING (nationkey)""")
def _a16(g):
    # each branch is summed on its own before the joins, or they would multiply
    d = g.deal.join(g.account, "custkey").groupBy("nationkey").agg(F.countDistinct("deal_id").alias("deals"))
    a = g.account.groupBy("nationkey").agg(F.countDistinct("custkey").alias("accounts"))
    n = g.has_need.groupBy("nationkey").agg(F.countDistinct("need").alias("needs"))
    out = g.domain.join(d, "nationkey", "left").join(a, "nationkey", "left").join(n, "nationkey", "left")
    return out.select("domain", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("deals", "accounts", "needs")])


@query("A17_distinct_evidence", """
SELECT a.account, count(DISTINCT o.doc_id) AS evidence FROM account a LEFT JOIN observation o USING (custkey) GROUP BY 1""")
def _a17(g):
    n = g.observation.groupBy("custkey").agg(F.countDistinct("doc_id").alias("evidence"))
    return g.account.join(n, "custkey", "left").select("account", F.coalesce("evidence", F.lit(0)).alias("evidence"))


@query("A18_domains_of_entities", """
WITH u AS (SELECT h.need, m.domain FROM has_need h JOIN domain m USING (nationkey)
  UNION SELECT h.need, m.domain FROM has_need h JOIN deal x USING (custkey) JOIN account a USING (custkey) JOIN domain m ON m.nationkey = a.nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY need ORDER BY domain) AS i FROM u)
SELECT need, string_agg(domain, '|' ORDER BY domain) AS domains FROM r WHERE i <= 4 GROUP BY 1""")
def _a18(g):
    direct = g.has_need.join(g.domain, "nationkey").select("need", "domain")
    dealt = g.has_need.join(g.deal.select("custkey").distinct(), "custkey", "left_semi").join(g.domain, "nationkey").select("need", "domain")
    u = direct.unionByName(dealt)
    return u.groupBy("need").agg(F.array_join(F.slice(F.sort_array(F.collect_set("domain")), 1, 4), "|").alias("domains"))


@query("A19_facets", """
SELECT 'status' AS facet, status AS value, count(*) AS n FROM claim GROUP BY 2 UNION ALL SELECT 'domain', m.domain, count(*) FROM account JOIN domain m USING (nationkey) GROUP BY 2
UNION ALL SELECT 'lang', lang, count(*) FROM evidence GROUP BY 2
UNION ALL SELECT 'account', account, n FROM (SELECT a.account, count(*) AS n FROM deal x JOIN account a USING (custkey) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40)""")
def _a19(g):
    f = lambda df, name, c: df.groupBy(F.lit(name).alias("facet"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    top = f(g.deal.join(g.account, "custkey"), "account", "account").orderBy(F.desc("n"), "value").limit(40)
    return f(g.claim, "status", "status").unionByName(f(g.account.join(g.domain, "nationkey"), "domain", "domain")).unionByName(f(g.evidence, "lang", "lang")).unionByName(top)


@query("A20_source_links", """
WITH l AS (SELECT DISTINCT v.source, a.account, m.domain FROM observation o JOIN evidence v USING (doc_id) JOIN account a USING (custkey) JOIN domain m USING (nationkey)),
r AS (SELECT source, account, row_number() OVER (PARTITION BY source ORDER BY account) AS i FROM (SELECT DISTINCT source, account FROM l))
SELECT l.source, count(DISTINCT l.domain) AS domains, count(DISTINCT l.account) AS entity_count, any_value(t.accounts) AS accounts
FROM l JOIN (SELECT source, string_agg(account, '|' ORDER BY account) AS accounts FROM r WHERE i <= 12 GROUP BY 1) t USING (source) GROUP BY 1""")
def _a20(g):
    o = g.observation.select("doc_id", "custkey").distinct().join(g.evidence.select("doc_id", "source"), "doc_id").join(g.account, "custkey").join(g.domain, "nationkey")
    pairs = o.select("source", "account", "domain").distinct()  # an account has one domain
    first = top_per_group(pairs, ["source"], [F.col("account")], 12).groupBy("source").agg(names("account").alias("accounts"))
    n = pairs.groupBy("source").agg(F.countDistinct("domain").alias("domains"), F.count("*").alias("entity_count"))
    return n.join(first, "source")


@query("A21_added_and_touched", """
WITH s AS (SELECT o.custkey, list(DISTINCT v.source) AS ss FROM observation o JOIN evidence v USING (doc_id) GROUP BY 1), x AS (SELECT custkey, len(ss) = 1 AS sole, unnest(ss) AS source FROM s)
SELECT source, count(*) FILTER (sole) AS added, count(*) FILTER (NOT sole) AS touched FROM x GROUP BY 1""")
def _a21(g):
    s = g.observation.select("doc_id", "custkey").join(g.evidence.select("doc_id", "source"), "doc_id").groupBy("custkey").agg(F.collect_set("source").alias("ss"))
    x = s.select((F.size("ss") == 1).alias("sole"), F.explode("ss").alias("source"))
    return x.groupBy("source").agg(F.count_if("sole").alias("added"), F.count_if(~F.col("sole")).alias("touched"))


@query("A22_runs", """
WITH p AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS run, statement, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM observation GROUP BY 1, 2)
SELECT CAST(run AS VARCHAR) AS run, CAST(sum(n) AS BIGINT) AS total, CAST(min(lo) AS VARCHAR)[:19] AS first_at, CAST(max(hi) AS VARCHAR)[:19] AS last_at, string_agg(statement || '=' || n, '|' ORDER BY statement) AS parts FROM p GROUP BY 1""")
def _a22(g):
    p = g.observation.groupBy(F.to_date("ts").alias("run"), "statement").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return p.groupBy(F.col("run").cast("string").alias("run")).agg(
        F.sum("n").alias("total"), at(F.min("lo")).alias("first_at"), at(F.max("hi")).alias("last_at"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "statement", F.col("n").cast("string")))), "|").alias("parts"))


@query("A23_degree", """
SELECT label, key, count(*) AS degree FROM (SELECT from_label AS label, from_key AS key FROM edge UNION ALL SELECT to_label, to_key FROM edge) GROUP BY 1, 2""")
def _a23(g):
    return degrees(g.edge)


@query("A24_health_groups", """
WITH ev AS (SELECT m.domain, count(o.obs_id) AS n FROM domain m LEFT JOIN account a USING (nationkey) LEFT JOIN observation o USING (custkey) GROUP BY 1),
x AS (SELECT 'poor domain' AS issue, domain AS item FROM ev WHERE n < 300
UNION ALL SELECT 'no evidence', account FROM account WHERE custkey NOT IN (SELECT custkey FROM observation)
UNION ALL SELECT 'unmapped need', need FROM (SELECT DISTINCT need FROM has_need) WHERE need NOT IN (SELECT need FROM addressed_by)
UNION ALL SELECT 'conflict', account FROM account WHERE custkey IN (SELECT custkey FROM claim GROUP BY 1 HAVING count(DISTINCT status) >= 2)
UNION ALL SELECT 'critical unverified', CAST(claim_id AS VARCHAR) FROM claim WHERE status = 'UNVERIFIED'
UNION ALL SELECT 'name collision', name || ' ' || area FROM feature GROUP BY name, area HAVING count(*) >= 2)
SELECT issue, item, n FROM (SELECT *, count(*) OVER (PARTITION BY issue) AS n, row_number() OVER (PARTITION BY issue ORDER BY item) AS rn FROM x) WHERE rn <= 40""")
def _a24(g, cap=40):
    """Six groups of what is wrong with the graph, 40 items of each and how many there are."""
    seen = g.observation.groupBy("custkey").agg(F.count("*").alias("n"))
    per = g.account.join(seen, "custkey", "left").groupBy("nationkey").agg(F.sum("n").alias("n"))
    group = lambda df, issue, item: df.select(F.lit(issue).alias("issue"), item.alias("item"))
    c = F.col
    parts = [
        group(g.domain.join(per, "nationkey", "left").where(F.coalesce("n", F.lit(0)) < 300), "poor domain", c("domain")),
        group(g.account.join(g.observation, "custkey", "left_anti"), "no evidence", c("account")),
        group(g.has_need.select("need").distinct().join(g.addressed_by, "need", "left_anti"), "unmapped need", c("need")),
        group(g.account.join(g.claim.groupBy("custkey").agg(F.countDistinct("status").alias("k")).where("k >= 2"), "custkey", "left_semi"), "conflict", c("account")),
        group(g.claim.where("status = 'UNVERIFIED'"), "critical unverified", c("claim_id").cast("string")),
        group(g.feature.groupBy("name", "area").count().where("count >= 2"), "name collision", F.concat("name", F.lit(" "), "area")),
    ]
    x = reduce(DataFrame.unionByName, parts)
    n = x.groupBy("issue").agg(F.count("*").alias("n"))
    return top_per_group(x, ["issue"], [c("item")], cap).join(F.broadcast(n), "issue").select("issue", "item", "n")  # six rows


@query("A25_evidence_variety", """
SELECT o.custkey, count(DISTINCT v.source) AS independent, count(DISTINCT v.lang) AS variety FROM observation o JOIN evidence v USING (doc_id) GROUP BY 1""")
def _a25(g):
    o = g.observation.select("custkey", "doc_id").join(g.evidence.select("doc_id", "source", "lang"), "doc_id")
    return o.groupBy("custkey").agg(F.countDistinct("source").alias("independent"), F.countDistinct("lang").alias("variety"))
