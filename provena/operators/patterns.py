"""Graph patterns as joins, predicates and projections over node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from provena.operators.common import degrees, expand, names, ordered_list, top_per_group
from provena.registry import query

STATUS_RANK = ("CRITICAL", "VERIFIED", "CANDIDATE")
SUPPORT_RANK = ("VERIFIED", "CRITICAL", "CANDIDATE")


def status_rank(ranking=STATUS_RANK):
    """Rank of a claim's status; what the ranking doesn't name comes last."""
    c = F.lit(len(ranking))
    for i, s in reversed(list(enumerate(ranking))):
        c = F.when(F.col("status") == s, i).otherwise(c)
    return c


def _rank_sql(ranking):
    return "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(ranking)) + f" ELSE {len(ranking)} END"


def seed(g, n: int = 8):
    """The first accounts, domains and capabilities by name, as keys (label, key)."""
    return (
        g.account.orderBy("account").limit(n).select(F.lit("Account").alias("label"), F.col("account").alias("key"))
        .unionByName(g.domain.orderBy("domain").limit(2).select(F.lit("BusinessDomain").alias("label"), F.col("domain").alias("key")))
        .unionByName(g.addressed_by.select(F.lit("Capability").alias("label"), F.col("capability").alias("key")).distinct().orderBy("key").limit(1))
    )


SEED = """
seed AS (SELECT * FROM (SELECT 'Account' AS label, account AS key FROM account ORDER BY account LIMIT 8)
 UNION ALL SELECT * FROM (SELECT 'BusinessDomain', domain FROM domain ORDER BY domain LIMIT 2)
 UNION ALL SELECT * FROM (SELECT 'Capability', capability FROM (SELECT DISTINCT capability FROM addressed_by) ORDER BY 2 LIMIT 1)),
hop AS (SELECT DISTINCT e.* FROM edge e JOIN seed s ON (e.from_label = s.label AND e.from_key = s.key) OR (e.to_label = s.label AND e.to_key = s.key))"""


@query("J1_evidence_with_source", """
SELECT r.pos, v.doc_id, v.locator, s.sensitivity, s.doc_status FROM (SELECT unnest([30, 5, 11, 2, 999999]) AS doc_id, unnest(range(5)) AS pos) r
JOIN evidence v USING (doc_id) LEFT JOIN source s USING (source)""")
def _j1(g, ids=(30, 5, 11, 2, 999999)):
    # request order is kept as a column, not by sorting twice
    pos = F.array_position(F.array(*[F.lit(i).cast("long") for i in ids]), F.col("doc_id")) - 1
    v = g.evidence.where(F.col("doc_id").isin(*ids)).join(g.source, "source", "left")
    return v.select(pos.alias("pos"), "doc_id", "locator", "sensitivity", "doc_status")


@query("J2_observations_of_entity", """
SELECT * FROM (SELECT a.account, o.obs_id, o.statement, CAST(CAST(o.ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY a.account ORDER BY o.ts DESC, o.obs_id) AS rn
 FROM account a JOIN observation o USING (custkey)) WHERE rn <= 40""")
def _j2(g):
    o = g.account.join(g.observation, "custkey")
    return top_per_group(o, ["account"], [F.desc("ts"), F.col("obs_id")], 40).select("account", "obs_id", "statement", F.to_date("ts").cast("string").alias("day"), "rn")


@query("J3_claims_of_entity", f"""
SELECT * FROM (SELECT a.account, c.claim_id, c.status, row_number() OVER (PARTITION BY a.account ORDER BY {_rank_sql(STATUS_RANK)}, c.claim_id) AS rn FROM account a JOIN claim c USING (custkey)) WHERE rn <= 5""")
def _j3(g):
    c = g.claim.join(g.account.select("custkey", "account"), "custkey")
    return top_per_group(c, ["account"], [status_rank(), F.col("claim_id")], 5).select("account", "claim_id", "status", "rn")


@query("J4_one_hop_expand", f"WITH {SEED} SELECT * FROM hop")
def _j4(g):
    return expand(g.edge, seed(g))


def _neighbours(g):
    s = seed(g)
    e = expand(g.edge, s)
    ends = e.select(F.col("from_label").alias("label"), F.col("from_key").alias("key")).unionAll(e.select("to_label", "to_key")).distinct()
    return ends.join(s, ["label", "key"], "left_anti")


@query("J5_neighbour_keys", f"""WITH {SEED} SELECT label, key FROM (SELECT from_label AS label, from_key AS key FROM hop UNION SELECT to_label, to_key FROM hop) EXCEPT SELECT label, key FROM seed""")
def _j5(g):
    return _neighbours(g)


@query("J6_critical_about_neighbourhood", """WITH s AS (SELECT industry AS key FROM industry ORDER BY 1 LIMIT 2), k AS (SELECT from_key AS key FROM edge WHERE type = 'BELONGS_TO' AND to_key IN (SELECT key FROM s))
SELECT c.claim_id, c.status, string_agg(DISTINCT a.account, '|' ORDER BY a.account) AS about FROM claim c JOIN account a USING (custkey) JOIN k ON k.key = a.account WHERE list_contains(string_split(c.lanes, '|'), 'critical') GROUP BY 1, 2""")
def _j6(g):
    """Critical claims about the neighbourhood of two industries."""
    s = g.industry.orderBy("industry").limit(2).select(F.lit("Industry").alias("label"), F.col("industry").alias("key"))
    e = expand(g.edge, s)
    ends = e.select(F.col("from_label").alias("label"), F.col("from_key").alias("key")).unionAll(e.select("to_label", "to_key"))
    keys = ends.where("label = 'Account'").select(F.col("key").alias("account")).distinct()
    c = g.claim.where(F.array_contains(F.split("lanes", r"\|"), "critical")).join(g.account.select("custkey", "account"), "custkey").join(keys, "account", "left_semi")
    return c.groupBy("claim_id", "status").agg(names("account").alias("about"))


@query("J7_sources_of_entities", """
SELECT a.account, v.source, count(*) AS n FROM (SELECT custkey, doc_id FROM observation UNION SELECT custkey, claim_id FROM claim) u JOIN account a USING (custkey) JOIN evidence v USING (doc_id) GROUP BY 1, 2""")
def _j7(g):
    u = g.observation.select("custkey", "doc_id").unionByName(g.claim.select("custkey", F.col("claim_id").alias("doc_id"))).distinct()
    return u.join(g.account.select("custkey", "account"), "custkey").join(g.evidence.select("doc_id", "source"), "doc_id").groupBy("account", "source").agg(F.count("*").alias("n"))


@query("J9_composite_optional_match", """
SELECT h.need, h.account, count(o.obs_id) AS observations FROM has_need h LEFT JOIN observation o ON o.custkey = h.custkey AND o.statement = 'purchase' GROUP BY 1, 2""")
def _j9(g):
    o = g.observation.where("statement = 'purchase'").groupBy("custkey").agg(F.count("*").alias("observations"))
    return g.has_need.join(o, "custkey", "left").select("need", "account", F.coalesce("observations", F.lit(0)).alias("observations"))


@query("J10_need_scope", """
SELECT h.need, count(DISTINCT h.account) AS holders FROM has_need h LEFT JOIN domain d USING (nationkey) WHERE d.domain IN ('FRANCE', 'CHINA', 'NATION_3', 'NATION_7') OR lower(h.need) LIKE '%a%' GROUP BY 1""")
def _j10(g, keys=("FRANCE", "CHINA", "NATION_3", "NATION_7"), term="a"):
    s = g.has_need.join(g.domain, "nationkey", "left").groupBy("need").agg(F.collect_set("domain").alias("scope"), F.countDistinct("account").alias("all"), F.countDistinct(F.when(F.col("domain").isin(*keys), F.col("account"))).alias("scoped"))
    named = F.contains(F.lower("need"), F.lit(term))
    return s.where(named | F.arrays_overlap("scope", F.array(*map(F.lit, keys)))).select("need", F.when(named, F.col("all")).otherwise(F.col("scoped")).alias("holders"))


@query("J11_account_deal_scope", """
WITH w AS (SELECT custkey, count(*) AS deals FROM deal GROUP BY 1), n AS (SELECT custkey, count(*) AS needs FROM has_need GROUP BY 1)
SELECT a.account, m.domain, coalesce(deals, 0) AS deals, coalesce(needs, 0) AS needs FROM account a LEFT JOIN domain m USING (nationkey) LEFT JOIN w USING (custkey) LEFT JOIN n USING (custkey)""")
def _j11(g):
    w = g.deal.groupBy("custkey").agg(F.count("*").alias("deals"))
    n = g.has_need.groupBy("custkey").agg(F.count("*").alias("needs"))
    a = g.account.join(g.domain, "nationkey", "left").join(w, "custkey", "left").join(n, "custkey", "left")
    return a.select("account", "domain", F.coalesce("deals", F.lit(0)).alias("deals"), F.coalesce("needs", F.lit(0)).alias("needs"))


@query("J12_capability_scope", """
WITH f AS (SELECT capability, feature_id, row_number() OVER (PARTITION BY capability ORDER BY feature_id) AS i FROM feature),
n AS (SELECT b.capability, r.orderkey, row_number() OVER (PARTITION BY b.capability ORDER BY r.orderkey) AS i FROM addressed_by b JOIN (SELECT DISTINCT need, orderkey FROM need_row) r USING (need)),
u AS (SELECT capability, feature_id AS id, i FROM f WHERE i <= 6 UNION ALL SELECT capability, orderkey, i + 6 FROM n WHERE i <= 6)
SELECT capability, string_agg(CAST(id AS VARCHAR), '|' ORDER BY i) AS evidence FROM u GROUP BY 1""")
def _j12(g):
    f = top_per_group(g.feature, ["capability"], [F.col("feature_id")], 6).select("capability", F.col("feature_id").alias("id"), "rn")
    r = g.need_row.select("need", "orderkey").distinct().join(g.addressed_by, "need")
    n = top_per_group(r, ["capability"], [F.col("orderkey")], 6).select("capability", F.col("orderkey").alias("id"), (F.col("rn") + 6).alias("rn"))
    return f.unionByName(n).groupBy("capability").agg(F.array_join(ordered_list("rn", "id"), "|").alias("evidence"))


@query("J13_evidence_to_entities", """
WITH l AS (SELECT DISTINCT o.doc_id, a.account FROM observation o JOIN account a USING (custkey)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY account) AS i FROM l)
SELECT doc_id, string_agg(account, '|' ORDER BY account) AS entities FROM r WHERE i <= 12 GROUP BY 1""")
def _j13(g):
    l = g.observation.select("doc_id", "custkey").distinct().join(g.account.select("custkey", "account"), "custkey")  # noqa: E741
    return top_per_group(l, ["doc_id"], [F.col("account")], 12).groupBy("doc_id").agg(names("account").alias("entities"))


@query("J14_claims_over_evidence", f"SELECT claim_id, status, row_number() OVER (ORDER BY {_rank_sql(SUPPORT_RANK)}, claim_id) AS rn FROM claim WHERE claim_id IN (SELECT doc_id FROM evidence WHERE source = 'src1') ORDER BY rn LIMIT 10")
def _j14(g):
    ids = g.evidence.where("source = 'src1'").select(F.col("doc_id").alias("claim_id"))
    c = g.claim.join(ids, "claim_id", "left_semi").withColumn("r", status_rank(SUPPORT_RANK)).orderBy("r", "claim_id").limit(10)
    return c.select("claim_id", "status", F.row_number().over(Window.orderBy("r", "claim_id")).alias("rn"))


@query("J15_expand_one_node", "SELECT type, CASE WHEN from_key = 'Customer#000000001' THEN to_label ELSE from_label END AS label, CASE WHEN from_key = 'Customer#000000001' THEN to_key ELSE from_key END AS display FROM edge WHERE (from_label = 'Account' AND from_key = 'Customer#000000001') OR (to_label = 'Account' AND to_key = 'Customer#000000001')")
def _j15(g, label="Account", key="Customer#000000001"):
    e = expand(g.edge, g.spark.createDataFrame([(label, key)], "label string, key string"))
    here = (F.col("from_label") == label) & (F.col("from_key") == key)
    return e.select("type", F.when(here, F.col("to_label")).otherwise(F.col("from_label")).alias("label"), F.when(here, F.col("to_key")).otherwise(F.col("from_key")).alias("display"))


@query("J16_semi_join_narrowing", "SELECT need FROM (SELECT DISTINCT need FROM has_need WHERE nationkey IN (SELECT nationkey FROM domain WHERE bd_status = 'managed'))")
def _j16(g):
    return g.has_need.join(g.domain.where("bd_status = 'managed'"), "nationkey", "left_semi").select("need").distinct()


@query("J17_anti_joins", """SELECT 'account without evidence' AS gap, account AS key FROM account WHERE custkey NOT IN (SELECT custkey FROM observation)
UNION ALL SELECT 'need without capability', name FROM (SELECT DISTINCT name FROM feature) WHERE name NOT IN (SELECT need FROM addressed_by WHERE capability IN ('PROMO', 'SMALL'))""")
def _j17(g, capabilities=("PROMO", "SMALL")):
    """Entities without evidence, and needs that none of the named capabilities addresses."""
    a = g.account.join(g.observation, "custkey", "left_anti").select(F.lit("account without evidence").alias("gap"), F.col("account").alias("key"))
    met = g.addressed_by.where(F.col("capability").isin(*capabilities)).select(F.col("need").alias("name"))
    return a.unionByName(g.feature.select("name").distinct().join(met, "name", "left_anti").select(F.lit("need without capability").alias("gap"), F.col("name").alias("key")))


@query("J18_name_prefix_pairs", "WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part) SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name < b.name AND length(a.name) >= 3 AND starts_with(b.name, a.name)")
def _j18(g):
    # names meet by their first three characters, so the prefix test runs inside small blocks
    n = g.part.select(F.col("p_name").alias("name")).unionByName(g.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))).distinct().where("length(name) >= 3").withColumn("head", F.substring("name", 1, 3))
    x, y = n.toDF("a", "head"), n.toDF("b", "head")
    return x.join(y, "head").where((F.col("a") < F.col("b")) & F.startswith("b", "a")).select("a", "b")


@query("J19_run_edges", "SELECT CAST(CAST(x.ts AS DATE) AS VARCHAR) AS run, count(*) AS pairs FROM observation x JOIN observation y ON x.custkey = y.custkey AND CAST(x.ts AS DATE) = CAST(y.ts AS DATE) AND x.obs_id < y.obs_id GROUP BY 1")
def _j19(g):
    # pairs within a (run, node) group are counted from its size; no pair is made
    n = g.observation.groupBy(F.to_date("ts").cast("string").alias("run"), "custkey").agg(F.count("*").alias("n"))
    return n.groupBy("run").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")).where("pairs > 0")


@query("J20_alias_lookup", "SELECT name, key FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY canonical DESC, key) AS rn FROM (SELECT p_name AS name, p_partkey AS key, p_size >= 40 AS canonical FROM part)) WHERE rn = 1")
def _j20(g):
    p = g.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("key"), (F.col("p_size") >= 40).alias("canonical"))
    return top_per_group(p, ["name"], [F.desc("canonical"), F.col("key")], 1).select("name", "key")


@query("J22_edge_detail", "SELECT type, from_key, to_key FROM edge WHERE concat(from_key, '__', type, '__', to_key) = (SELECT min(concat(from_key, '__', type, '__', to_key)) FROM edge WHERE type = 'TARGETS')")
def _j22(g):
    name = g.edge.where("type = 'TARGETS'").agg(F.min(F.concat_ws("__", "from_key", "type", "to_key"))).first()[0]
    a, t, b = name.split("__")
    return g.edge.where((F.col("from_key") == a) & (F.col("type") == t) & (F.col("to_key") == b)).select("type", "from_key", "to_key")


@query("P1_display_name", "SELECT p_partkey AS id, coalesce(nullif(p_name, ''), p_brand, CAST(p_partkey AS VARCHAR)) AS display FROM part")
def _p1(g):
    return g.part.select(F.col("p_partkey").alias("id"), F.coalesce(F.nullif("p_name", F.lit("")), "p_brand", F.col("p_partkey").cast("string")).alias("display"))


@query("P3_scope_predicate", "SELECT account FROM account WHERE lower(account) LIKE '%00012%' OR lower(account) LIKE '%99%'")
def _p3(g, terms=("00012", "99")):
    ts = F.array(*map(F.lit, terms))
    return g.account.where((F.size(ts) == 0) | F.exists(ts, lambda t: F.contains(F.lower("account"), t))).select("account")


def requires_any(df: DataFrame, **given: Column | None) -> DataFrame:
    """`df` under the conditions that are given; no rows, with the same schema, where none is."""
    on = [c for c in given.values() if c is not None]
    for c in on:
        df = df.where(c)
    return df if on else df.limit(0)


@query("P4_requires_any", "SELECT 'terms' AS run, need, account FROM has_need WHERE contains(need, 'a') UNION ALL SELECT 'both', need, account FROM has_need WHERE contains(need, 'a') AND nationkey < 9")
def _p4(g):
    """A template is run with one parameter, with two, and with none; the last run gives nothing."""
    rows = lambda run, **given: requires_any(g.has_need, **given).select(F.lit(run).alias("run"), "need", "account")
    term, nation = F.contains("need", F.lit("a")), F.col("nationkey") < 9
    return rows("terms", term=term, nation=None).unionByName(rows("both", term=term, nation=nation)).unionByName(rows("none", term=None, nation=None))


def permitted(df, levels=("public", "internal"), dead=("superseded", "retired", "obsolete", "deprecated")):
    """Rows that a policy may see; a missing sensitivity counts as internal, unknown ones are denied."""
    return df.where(F.lower(F.coalesce(F.nullif("sensitivity", F.lit("")), F.lit("internal"))).isin(*levels) & ~F.lower(F.coalesce("doc_status", F.lit(""))).isin(*dead))


@query("P5_access_filter", "WITH k AS (SELECT source, sensitivity IN ('public', 'internal') AND doc_status <> 'deprecated' AS ok FROM source) SELECT source, (SELECT count(*) FILTER (NOT ok) > 0 FROM k) AS filtered_any FROM k WHERE ok")
def _p5(g):
    kept = permitted(g.source)
    hidden = g.source.join(kept, "source", "left_anti").agg((F.count("*") > 0).alias("filtered_any"))
    return kept.select("source").join(F.broadcast(hidden), how="cross")


@query("P6_blocked_sources", "SELECT doc_id FROM evidence WHERE source NOT IN (SELECT source FROM source WHERE sensitivity = 'restricted')")
def _p6(g):
    return g.evidence.join(g.source.where("sensitivity = 'restricted'"), "source", "left_anti").select("doc_id")


@query("P7_critical_lane", "SELECT claim_id FROM claim WHERE list_contains(string_split(lanes, '|'), 'critical')")
def _p7(g):
    return g.claim.where(F.array_contains(F.coalesce(F.split("lanes", r"\|"), F.array()), "critical")).select("claim_id")


@query("P8_in_graph_flag", "SELECT doc_id, doc_id IN (SELECT doc_id FROM observation) OR doc_id IN (SELECT claim_id FROM claim) AS in_graph FROM evidence")
def _p8(g):
    o = g.observation.select("doc_id").distinct().withColumn("o", F.lit(True))
    c = g.claim.select(F.col("claim_id").alias("doc_id")).distinct().withColumn("c", F.lit(True))
    return g.evidence.select("doc_id").join(o, "doc_id", "left").join(c, "doc_id", "left").select("doc_id", (F.col("o").isNotNull() | F.col("c").isNotNull()).alias("in_graph"))


@query("P9_source_list_filter", "SELECT v.source, count(*) AS n FROM evidence v JOIN source s USING (source) WHERE v.lang IN ('en', 'de') AND (v.source LIKE '%1%' OR s.sensitivity LIKE '%1%' OR s.doc_status LIKE '%1%') GROUP BY 1")
def _p9(g, text="1", langs=("en", "de")):
    s = g.source.where(F.exists(F.array("source", "sensitivity", "doc_status"), lambda c: F.contains(c, F.lit(text))))
    return g.evidence.where(F.col("lang").isin(*langs)).join(s, "source", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query("P10_entity_list_filter", "SELECT account FROM account WHERE account LIKE '%5%' AND kind = 'customer' AND nationkey IN (SELECT nationkey FROM domain WHERE bd_status <> 'excluded')")
def _p10(g):
    a = g.account.where(F.contains("account", F.lit("5")) & (F.col("kind") == "customer"))
    return a.join(g.domain.where("bd_status <> 'excluded'"), "nationkey", "left_semi").select("account")


@query("P11_key_format_guard", "SELECT key, regexp_full_match(key, '[A-Za-z0-9#_ -]{1,64}') AS ok FROM (SELECT account AS key FROM account UNION SELECT name FROM feature)")
def _p11(g):
    k = g.account.select(F.col("account").alias("key")).union(g.feature.select("name")).distinct()
    return k.select("key", F.col("key").rlike("^[A-Za-z0-9#_ -]{1,64}$").alias("ok"))


@query("P12_property_table", "SELECT p_partkey AS id, unnest(['name', 'brand', 'type', 'size']) AS prop, unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part")
def _p12(g):
    return g.part.selectExpr("p_partkey AS id", "stack(4, 'name', p_name, 'brand', p_brand, 'type', p_type, 'size', string(p_size)) AS (prop, value)")


@query("P13_source_title", "SELECT page_id, url, list_last(string_split(rtrim(url, '/'), '/')) AS title FROM pages")
def _p13(g):
    return g.pages.select("page_id", "url", F.substring_index(F.rtrim("url", F.lit("/")), "/", -1).alias("title"))


@query("P14_locator_section", "SELECT doc_id, CASE WHEN contains(locator, '!') THEN trim(split_part(locator, '!', 1)) ELSE '' END AS section FROM evidence")
def _p14(g):
    return g.evidence.select("doc_id", F.when(F.contains("locator", F.lit("!")), F.trim(F.substring_index("locator", "!", 1))).otherwise("").alias("section"))


@query("P15_evidence_payload", "SELECT v.doc_id, v.locator, v.snippet, s.sensitivity, min(CAST(CAST(o.ts AS DATE) AS VARCHAR)) AS observed_at FROM evidence v LEFT JOIN source s USING (source) LEFT JOIN observation o USING (doc_id) GROUP BY 1, 2, 3, 4")
def _p15(g):
    o = g.observation.groupBy("doc_id").agg(F.to_date(F.min("ts")).cast("string").alias("observed_at"))
    return g.evidence.join(g.source, "source", "left").join(o, "doc_id", "left").select("doc_id", "locator", "snippet", "sensitivity", "observed_at")


@query("G2_ensure_focal", "WITH n AS (SELECT label, key, count(*) AS degree FROM (SELECT from_label AS label, from_key AS key FROM edge UNION ALL SELECT to_label, to_key FROM edge) GROUP BY 1, 2) SELECT label, key, CASE WHEN rn = 1 THEN 'focal' ELSE 'supporting' END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY degree DESC, key) AS rn FROM n) WHERE label <> 'Deal'")
def _g2(g):
    rn = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("degree"), "key"))
    return degrees(g.edge).where("label <> 'Deal'").select("label", "key", F.when(rn == 1, "focal").otherwise("supporting").alias("rank"))


@query("G6_top_entities_with_induced_edges", """
WITH b AS (SELECT * FROM edge WHERE type NOT IN ('WITH_ACCOUNT', 'IN_DOMAIN')), n AS (SELECT label, key, count(*) AS degree FROM (SELECT from_label AS label, from_key AS key FROM b UNION ALL SELECT to_label, to_key FROM b) GROUP BY 1, 2), t AS (SELECT * FROM n ORDER BY degree DESC, label, key LIMIT 20)
SELECT e.* FROM b e JOIN t a ON e.from_label = a.label AND e.from_key = a.key JOIN t b ON e.to_label = b.label AND e.to_key = b.key""")
def _g6(g, n=20):
    """The n best-connected entities of the business graph, without deals, and the edges among them."""
    e = g.edge.where(~F.col("type").isin("WITH_ACCOUNT", "IN_DOMAIN"))
    t = F.broadcast(degrees(e).orderBy(F.desc("degree"), "label", "key").limit(n).select("label", "key"))  # n rows
    e = e.join(t.toDF("from_label", "from_key"), ["from_label", "from_key"], "left_semi").join(t.toDF("to_label", "to_key"), ["to_label", "to_key"], "left_semi")
    return e.select("type", "from_label", "from_key", "to_label", "to_key")


@query("L8_top_nodes_by_degree", "SELECT label, key, count(*) AS degree FROM (SELECT from_label AS label, from_key AS key FROM edge UNION ALL SELECT to_label, to_key FROM edge) GROUP BY 1, 2 ORDER BY degree DESC, label, key LIMIT 20")
def _l8(g):
    return degrees(g.edge).orderBy(F.desc("degree"), "label", "key").limit(20)


@query("G9_reveal_depth", f"""WITH RECURSIVE {SEED}, both_ways AS (SELECT from_label AS a, from_key AS ak, to_label AS b, to_key AS bk FROM edge WHERE type <> 'WITH_ACCOUNT' AND type <> 'IN_DOMAIN' UNION ALL SELECT to_label, to_key, from_label, from_key FROM edge WHERE type <> 'WITH_ACCOUNT' AND type <> 'IN_DOMAIN'),
walk AS (SELECT label, key, 0 AS depth FROM seed UNION SELECT b, bk, depth + 1 FROM walk JOIN both_ways ON label = a AND key = ak WHERE depth < 2) SELECT label, key, min(depth) AS depth FROM walk GROUP BY 1, 2""")
def _g9(g, depth=2):
    """Layers of a breadth-first search, one join a layer; visited nodes are left out by an anti join."""
    e = g.edge.where(~F.col("type").isin("WITH_ACCOUNT", "IN_DOMAIN"))
    seen = seed(g).withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        hop = expand(e, front)
        ends = hop.select(F.col("from_label").alias("label"), F.col("from_key").alias("key")).unionAll(hop.select("to_label", "to_key")).distinct()
        front = ends.join(seen, ["label", "key"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen
