"""Question plans and answer checks: collection, retries, labels, anchoring, assembly and scoring against golden facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from provena.functions import text as X
from provena.operators.common import names, ordered_list, top_per_group
from provena.operators.patterns import permitted, status_rank
from provena.registry import query


@query("P2_key_set_filter", "SELECT account, kind FROM account WHERE custkey IN (SELECT custkey FROM deal WHERE outcome = 'lost')")
def _p2(g):
    return g.account.join(g.deal.where("outcome = 'lost'").select("custkey"), "custkey", "left_semi").select("account", "kind")


@query("U3_ordered_distinct", "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS k FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, '|' ORDER BY k) AS kinds FROM f GROUP BY 1")
def _u3(g):
    first = g.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("k"))
    return first.groupBy("user_id").agg(F.array_join(ordered_list("k", "event_type"), "|").alias("kinds"))


@query("U8_capped_merge", "SELECT key FROM (SELECT account AS key, CASE WHEN kind = 'prospect' THEN 0 ELSE 1 END AS p FROM account) ORDER BY p, key LIMIT 40")
def _u8(g, cap=40):
    """What is there already comes first; new keys fill up to the cap."""
    now, more = (g.account.where(F.col("kind") == k).select(F.col("account").alias("key"), F.lit(i).alias("p")) for i, k in enumerate(("prospect", "customer")))
    return now.unionByName(more).groupBy("key").agg(F.min("p").alias("p")).orderBy("p", "key").limit(cap).select("key")


_KEY_SQL = r"lower(regexp_replace(regexp_replace(regexp_replace({}, '[\(（][^)）]*[\)）]', ' ', 'g'), '(?i)(Inc\.?|Co\.?|Ltd\.?)', ' ', 'g'), '\s+', '', 'g'))"


@query("N9_do_not_merge", f"""WITH l AS (SELECT DISTINCT p_name AS a, CASE WHEN length(p_name) % 2 = 0 THEN upper(p_name) || ' (main) Ltd.' ELSE p_name || ' two' END AS b FROM part)
SELECT a, b FROM l WHERE {_KEY_SQL.format('a')} = {_KEY_SQL.format('b')}""")
def _n9(g):
    """Of a list of pairs that must stay apart, those that the key would merge."""
    name = F.col("p_name")
    listed = g.part.select(name.alias("a"), F.when(F.length(name) % 2 == 0, F.concat(F.upper(name), F.lit(" (main) Ltd."))).otherwise(F.concat(name, F.lit(" two"))).alias("b")).distinct()
    return listed.where(X.match_key(F.col("a")) == X.match_key(F.col("b")))


@query("N25_bound_amounts", r"SELECT p_partkey AS id, regexp_matches(s, '\d[^0-9]{0,12}(이하|이상|한도|≤|≥)') AS bound FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || '억 이하' WHEN 1 THEN p_size || '억 수준' ELSE '한도 ' || p_size END AS s FROM part)")
def _n25(g):
    n = F.col("p_size").cast("string")
    s = F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit("억 이하"))).when(F.col("p_partkey") % 3 == 1, F.concat(n, F.lit("억 수준"))).otherwise(F.concat(F.lit("한도 "), n))
    return g.part.select(F.col("p_partkey").alias("id"), s.rlike(r"\d[^0-9]{0,12}(이하|이상|한도|≤|≥)").alias("bound"))


@query("N27_candidate_absorption", "SELECT l.doc_id, contains(v.snippet, q.quote) AS kept FROM labels l JOIN evidence v USING (doc_id) JOIN (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 20) ELSE 'not in the text' END AS quote FROM documents) q USING (doc_id)")
def _n27(g):
    """Candidates are an input table; a quote that its excerpt doesn't hold is refused."""
    q = g.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 20)).otherwise("not in the text").alias("quote"))
    return g.labels.join(g.evidence.select("doc_id", "snippet"), "doc_id").join(q, "doc_id").select("doc_id", F.contains("snippet", "quote").alias("kept"))


@query("Q3_entity_collection", """
WITH o AS (SELECT custkey, count(*) AS observations FROM observation GROUP BY 1), c AS (SELECT custkey, count(*) AS claims, min(CASE status WHEN 'CRITICAL' THEN 0 WHEN 'VERIFIED' THEN 1 WHEN 'CANDIDATE' THEN 2 ELSE 3 END) AS best FROM claim GROUP BY 1), n AS (SELECT custkey, string_agg(DISTINCT need, '|' ORDER BY need) AS needs FROM has_need GROUP BY 1)
SELECT account, coalesce(observations, 0) AS observations, coalesce(claims, 0) AS claims, best, needs FROM account LEFT JOIN o USING (custkey) LEFT JOIN c USING (custkey) LEFT JOIN n USING (custkey)""")
def _q3(g):
    o = g.observation.groupBy("custkey").agg(F.count("*").alias("observations"))
    c = g.claim.groupBy("custkey").agg(F.count("*").alias("claims"), F.min(status_rank()).alias("best"))
    n = g.has_need.groupBy("custkey").agg(names("need").alias("needs"))
    a = g.account.join(o, "custkey", "left").join(c, "custkey", "left").join(n, "custkey", "left")
    return a.select("account", F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("claims", F.lit(0)).alias("claims"), "best", "needs")


@query("Q4_retry_without_terms", "SELECT need, account, true AS relaxed FROM has_need ORDER BY need, account LIMIT 25")
def _q4(g, term="no such need", limit=25):
    """A plan without rows is run once more without its terms, and says so."""
    strict = g.has_need.where(F.contains("need", F.lit(term)))
    relaxed = strict.isEmpty()
    rows = g.has_need if relaxed else strict
    return rows.select("need", "account", F.lit(relaxed).alias("relaxed")).orderBy("need", "account").limit(limit)


@query("Q6_raw_signals", "SELECT v.doc_id, v.source FROM evidence v JOIN source s USING (source) WHERE contains(v.snippet, 'token') AND s.sensitivity <> 'restricted' AND s.doc_status <> 'deprecated' AND v.doc_id NOT IN (SELECT claim_id FROM claim)")
def _q6(g):
    v = g.evidence.where(F.contains("snippet", F.lit("token"))).join(permitted(g.source), "source", "left_semi")
    return v.join(g.claim.select(F.col("claim_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id", "source")


@query("Q7_gap_trigger", "SELECT conv_id, turn, regexp_matches(lower(text), 'not |without|never|the') AS assess FROM conversations WHERE role = 'user'")
def _q7(g):
    return g.conversations.where("role = 'user'").select("conv_id", "turn", F.lower("text").rlike("not |without|never|the").alias("assess"))


@query("Q8_evidence_groups", "SELECT v.doc_id, CASE WHEN c.toxic = 1 THEN 'critical#' || v.doc_id WHEN r.n <= 12 THEN 'rare#' || v.source || '|' || v.lang ELSE 'raw#' || v.source END AS label FROM evidence v LEFT JOIN claim c ON c.claim_id = v.doc_id LEFT JOIN (SELECT source, lang, count(*) AS n FROM evidence GROUP BY 1, 2) r USING (source, lang)")
def _q8(g):
    r = g.evidence.groupBy("source", "lang").agg(F.count("*").alias("n"))
    v = g.evidence.join(g.claim.select(F.col("claim_id").alias("doc_id"), "toxic"), "doc_id", "left").join(r, ["source", "lang"], "left")
    label = F.coalesce(F.when(F.col("toxic") == 1, F.concat(F.lit("critical#"), F.col("doc_id").cast("string"))), F.when(F.col("n") <= 12, F.concat(F.lit("rare#"), "source", F.lit("|"), "lang")), F.concat(F.lit("raw#"), "source"))
    return v.select("doc_id", label.alias("label"))


_WORD_SETS_SQL = r"list_transform({}, lambda s: list_distinct(list_filter(regexp_split_to_array(lower(s), '\s+'), lambda w: w <> '')))"


@query("Q12_citation_anchoring", f"""WITH b AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
w AS (SELECT conv_id, turn, {_WORD_SETS_SQL.format(X.SENTENCES_SQL.format('text'))} AS a, {_WORD_SETS_SQL.format(X.SENTENCES_SQL.format('before'))} AS c FROM b WHERE before IS NOT NULL),
h AS (SELECT conv_id, turn, list_transform(a, lambda x: list_transform(c, lambda y: len(list_intersect(x, y)))) AS h FROM w)
SELECT conv_id, turn, '[' || array_to_string(list_transform(h, lambda v: CASE WHEN list_max(v) >= 2 THEN CAST(list_position(v, list_max(v)) - 1 AS VARCHAR) ELSE 'null' END), ',') || ']' AS anchors FROM h""")
def _q12(g):
    """Sentences of a turn are anchored to the sentences of the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = g.conversations.withColumn("before", F.lag("text").over(w)).where("before IS NOT NULL")
    return c.select("conv_id", "turn", F.to_json(X.anchors(X.sentences(F.col("text")), X.sentences(F.col("before"))), {"ignoreNullFields": "false"}).alias("anchors"))


_TERM_SQL = r"WITH p AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY turn) AS prose, string_agg(text, chr(10) ORDER BY turn) AS payload FROM conversations GROUP BY 1), b AS (SELECT DISTINCT conv_id, term FROM (SELECT conv_id, unnest(regexp_extract_all(text, '\S*@\S*|[[:alpha:]]{9,}')) AS term FROM conversations WHERE role = 'user'))"


@query("M3_banned_terms", _TERM_SQL + " SELECT conv_id, count(*) AS banned, count(*) FILTER (regexp_matches(term, '[@0-9]') AND contains(payload, term)) AS personal, count(*) FILTER (NOT regexp_matches(term, '[@0-9]') AND contains(coalesce(prose, ''), term)) AS said FROM b JOIN p USING (conv_id) GROUP BY 1")
def _m3(g):
    """Terms that an answer must not hold, of every conversation: its users' long words and addresses. Those that look like personal data are searched in all
    that is sent, the others in the answer's own words."""
    c = g.conversations
    b = c.where("role = 'user'").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit(r"\S*@\S*|[A-Za-z]{9,}"), F.lit(0))).alias("term")).distinct()
    said = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(x, F.struct("turn", "text")))), lambda r: r["text"]), "\n")
    p = c.groupBy("conv_id").agg(said(F.col("role") == "assistant").alias("prose"), said(F.lit(True)).alias("payload"))
    personal = F.col("term").rlike("[@0-9]")
    return b.join(p, "conv_id").groupBy("conv_id").agg(F.count("*").alias("banned"), F.count_if(personal & F.contains("payload", "term")).alias("personal"), F.count_if(~personal & F.contains("prose", "term")).alias("said"))


@query("M5_number_traceability", r"WITH e AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)*'), lambda x: replace(x, ',', ''))) AS ns FROM documents), a AS (SELECT doc_id, list_distinct(list_concat(list_slice(ns, 1, 2), [CAST(doc_id AS VARCHAR)])) AS said, ns FROM e) SELECT doc_id, CAST(len(said) AS BIGINT) AS numbers, CAST(len(list_filter(said, lambda n: NOT list_contains(ns, n))) AS BIGINT) AS untraced FROM a")
def _m5(g):
    """Numbers of an answer (two of the text's and the document's own id) against those of the whole text."""
    d = g.documents.select("doc_id", F.explode(F.array(F.array_distinct(F.coalesce(X.numbers(F.col("text")), F.array().cast("array<string>"))))).alias("ns"))
    said = F.array_distinct(F.concat(F.slice("ns", 1, 2), F.array(F.col("doc_id").cast("string"))))
    return d.select("doc_id", F.size(said).cast("long").alias("numbers"), F.size(F.array_except(said, "ns")).cast("long").alias("untraced"))


@query("H4_name_to_key", "SELECT p_name AS name, arg_min(p_brand, (-p_size, p_partkey)) AS key, count(DISTINCT p_brand) AS keys FROM part GROUP BY 1")
def _h4(g):
    """Names of an aggregate's rows, largest first, to their keys: of several rows of one name the first counts."""
    first = F.min_by("p_brand", F.struct((-F.col("p_size")).alias("place"), "p_partkey"))
    return g.part.groupBy(F.col("p_name").alias("name")).agg(first.alias("key"), F.countDistinct("p_brand").alias("keys"))


@query("H5_synthesis_input", "SELECT source, string_agg(substr(snippet, 1, 300), chr(10) ORDER BY doc_id) AS excerpts FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM evidence) WHERE rn <= 24 GROUP BY 1")
def _h5(g):
    t = top_per_group(g.evidence, ["source"], [F.col("doc_id")], 24).select("source", "rn", F.substring("snippet", 1, 300).alias("s"))
    return t.groupBy("source").agg(F.array_join(ordered_list("rn", "s"), "\n").alias("excerpts"))


@query("H7_drop_personal_data", r"SELECT doc_id FROM evidence WHERE NOT regexp_matches(snippet, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
def _h7(g):
    return g.evidence.where(~F.col("snippet").rlike(X.EMAIL)).select("doc_id")


@query("H9_citation_markers", r"""WITH t AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN ' so [1].' WHEN 2 THEN ' and [2] then [12], [2].' ELSE ' [x] [1234]' END AS s FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(s, '\[(\d{1,3})\]', 1), lambda x: CAST(x AS INT)))), ',') AS markers, trim(regexp_replace(regexp_replace(s, '\s*\[(1|2)\]', '', 'g'), '\s+([.,!?])', '\1', 'g')) AS without FROM t""")
def _h9(g, drop=(1, 2)):
    """The markers of an answer, and its text without those that no citation backs."""
    tail = F.element_at(F.array(*map(F.lit, ("", " so [1].", " and [2] then [12], [2].", " [x] [1234]"))), (F.col("turn") % 4 + 1).cast("int"))
    c = g.conversations.select("conv_id", "turn", F.concat("text", tail).alias("s"))
    m = F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))))
    gone = F.regexp_replace("s", rf"\s*\[({'|'.join(map(str, drop))})\]", "")
    return c.select("conv_id", "turn", F.array_join(F.transform(m, lambda x: x.cast("string")), ",").alias("markers"), F.trim(F.regexp_replace(gone, r"\s+([.,!?])", "$1")).alias("without"))


@query("H12_payload_labels", "SELECT claim_id, CASE status WHEN 'VERIFIED' THEN 'verified' WHEN 'CRITICAL' THEN 'critical' WHEN 'CANDIDATE' THEN 'candidate' ELSE 'unverified' END AS label, replace(lanes, '|', ' · ') AS lanes FROM claim")
def _h12(g):
    return g.claim.select("claim_id", F.lower("status").alias("label"), F.replace("lanes", F.lit("|"), F.lit(" · ")).alias("lanes"))


@query("H14_alias_index", "SELECT key, arg_min(name, seq) AS name FROM (SELECT lower(p_brand) AS key, p_name AS name, p_partkey AS seq FROM part) GROUP BY 1")
def _h14(g):
    """First name of a key wins."""
    return g.part.groupBy(F.lower("p_brand").alias("key")).agg(F.min_by("p_name", "p_partkey").alias("name"))


@query("G7_rows_to_subgraph", "SELECT DISTINCT 'HAS_NEED' AS type, account AS a, need AS b FROM has_need UNION SELECT 'ADDRESSED_BY', need, capability FROM addressed_by WHERE need IN (SELECT need FROM has_need)")
def _g7(g):
    n = g.has_need.select(F.lit("HAS_NEED").alias("type"), F.col("account").alias("a"), F.col("need").alias("b"))
    c = g.addressed_by.join(g.has_need, "need", "left_semi").select(F.lit("ADDRESSED_BY").alias("type"), F.col("need").alias("a"), F.col("capability").alias("b"))
    return n.unionByName(c).distinct()


_G3_SQL = """
WITH cited AS (SELECT doc_id, source FROM evidence WHERE contains(snippet, 'token') OR contains(snippet, 'Licensed')),
deg AS (SELECT a.account AS key, a.custkey, count(d.deal_id) AS degree FROM account a LEFT JOIN deal d USING (custkey) GROUP BY 1, 2),
carried AS (SELECT DISTINCT a.account AS key, o.doc_id FROM observation o JOIN account a USING (custkey) JOIN cited USING (doc_id) WHERE o.statement = 'purchase'),
r AS (SELECT key, CASE WHEN rn <= 5 THEN 0 WHEN key IN (SELECT key FROM carried) THEN 1 ELSE 2 END AS rank, degree FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, key) AS rn FROM deg)),
kept AS (SELECT key, rank FROM (SELECT *, row_number() OVER (ORDER BY rank, degree DESC, key) AS rn FROM r) WHERE rn <= 30),
loose AS (SELECT DISTINCT source FROM cited WHERE doc_id NOT IN (SELECT doc_id FROM carried WHERE key IN (SELECT key FROM kept)))
SELECT 'Account' AS label, key, rank FROM kept UNION ALL SELECT 'Source', source, 3 FROM loose"""


def citation_nodes(nodes: DataFrame, carried: DataFrame, cited: DataFrame, cap: int = 30, focal: int = 5) -> DataFrame:
    """(label, key, rank): the nodes that an answer's subgraph keeps.

    nodes (key, degree); carried (key, doc_id): citations that a node carries; cited (doc_id, source).  The
    `focal` best-connected nodes stay (rank 0), then nodes that carry a citation (1), then others (2), by
    degree, up to `cap`.  A citation that no kept node carries gets its source as a node (3), so that each marker has one.
    """
    first = nodes.orderBy(F.desc("degree"), "key").limit(focal).select("key", F.lit(0).alias("r0"))
    has = carried.select("key").distinct().withColumn("r1", F.lit(1))
    rank = F.coalesce("r0", "r1", F.lit(2))
    kept = nodes.join(first, "key", "left").join(has, "key", "left").select("key", rank.alias("rank"), "degree").orderBy("rank", F.desc("degree"), "key").limit(cap)
    placed = carried.join(kept, "key", "left_semi").select("doc_id")
    loose = cited.join(placed, "doc_id", "left_anti").select("source").distinct()
    return kept.select(F.lit("Account").alias("label"), "key", "rank").unionByName(loose.select(F.lit("Source").alias("label"), F.col("source").alias("key"), F.lit(3).alias("rank")))


@query("G3_citation_nodes", _G3_SQL)
def _g3(g):
    cited = g.evidence.where(F.contains("snippet", F.lit("token")) | F.contains("snippet", F.lit("Licensed"))).select("doc_id", "source")
    nodes = g.account.join(g.deal.groupBy("custkey").agg(F.count("*").alias("n")), "custkey", "left").select(F.col("account").alias("key"), "custkey", F.coalesce("n", F.lit(0)).alias("degree"))
    carried = g.observation.where("statement = 'purchase'").join(cited, "doc_id", "left_semi").join(nodes, "custkey").select("key", "doc_id").distinct()
    return citation_nodes(nodes.drop("custkey"), carried, cited)
