"""Windows, top-k search, set operations and evidence selection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from provena.functions import text as X
from provena.operators import postings
from provena.operators.common import top_per_group
from provena.operators.postings import B, K1
from provena.operators.quotes import holding
from provena.registry import query
from provena.session import run_folder, stored

def _tokens_sql(c: str) -> str:
    """DuckDB's list of search tokens."""
    words = rf"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '([{X.CJK}]+)', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"flatten(list_transform({words}, lambda w: CASE WHEN regexp_matches(w, '^[{X.CJK}]') AND length(w) > 1 THEN list_transform(range(1, length(w)), lambda i: substr(w, CAST(i AS INT), 2)) ELSE [w] END))"


_HITS_SQL = f"""q AS (SELECT item_id, unnest(list_distinct(list_slice({_tokens_sql('text')}, 1, 3))) AS term FROM ask),
tok AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS term FROM passage) GROUP BY 1, 2),
len AS (SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS dl FROM tok GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS av FROM len), df AS (SELECT term, count(*) AS df FROM tok GROUP BY 1),
hit AS (SELECT q.item_id, t.doc_id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * t.tf * {K1 + 1} / (t.tf + {K1} * ({1 - B} + {B} * len.dl / st.av))), 6) AS score
  FROM q JOIN tok t USING (term) JOIN df USING (term) JOIN len ON len.doc_id = t.doc_id CROSS JOIN st GROUP BY 1, 2)"""


def asked(g) -> DataFrame:
    first = F.array_distinct(F.slice(X.search_tokens(F.col("text")), 1, 3))
    return g.ask.select("item_id", F.explode(first).alias("term"))


def found(g) -> DataFrame:
    """(item_id, doc_id, score) of the asked terms, from the postings of all passages."""
    return postings.search(g.spark, postings.of(g), asked(g))


def _ranked(g, n: int) -> DataFrame:
    return top_per_group(found(g), ["item_id"], [F.desc("score"), F.col("doc_id")], n)


def _cut_sql(n: int) -> str:
    return f"cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM hit) WHERE rn <= {n})"


_STATUS_SQL = f"""tok AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS term FROM passage) GROUP BY 1, 2)"""


@query("S24_postings_status", f"WITH {_STATUS_SQL} SELECT 'cjk' AS analyzer, 1 AS segments, count(DISTINCT doc_id) AS docs, CAST(sum(tf) AS BIGINT) AS tokens, count(DISTINCT term) AS terms, count(*) AS postings FROM tok")
def _s24_status(g):
    return postings.status(g.spark, postings.of(g))


@query("S24_postings_refresh", f"""WITH {_STATUS_SQL}, t AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tok GROUP BY 1) SELECT term, df, tf, 2 AS segments FROM t""")
def _s24_refresh(g):
    """Document frequencies after an update: an older state of the passages is indexed first, then what differs from it.

    In the older state a tenth of the passages is missing, a tenth reads otherwise, and some are there that go.
    """
    path = f"{run_folder(g.spark)}/postings-{uuid.uuid4().hex[:12]}"
    p = g.passage.select("doc_id", "text")
    old = p.where("pmod(doc_id, 10) <> 1").select("doc_id", F.when(F.expr("pmod(doc_id, 10) = 2"), F.reverse("text")).otherwise(F.col("text")).alias("text"))
    gone = p.where("pmod(doc_id, 7) = 0").select((-1000 - F.col("doc_id")).alias("doc_id"), "text")
    postings.apply(old.unionByName(gone), path)
    index = postings.apply(p, path)
    v = postings._valid(g.spark, index, postings._read(g.spark, index))
    return v.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).withColumn("segments", F.lit(len(index.segments)))


@query("L1_full_text_topk", f"WITH {_HITS_SQL}, {_cut_sql(8)} SELECT item_id, doc_id, rn FROM cut")
def _l1(g):
    return _ranked(g, 8).select("item_id", "doc_id", "rn")


@query("L2_search_within_sources", f"""WITH {_HITS_SQL}, {_cut_sql(1200)}
SELECT item_id, doc_id, k FROM (SELECT c.item_id, c.doc_id, row_number() OVER (PARTITION BY c.item_id ORDER BY c.rn) AS k FROM cut c JOIN passage v USING (doc_id) WHERE v.source IN ('src1', 'src2')) WHERE k <= 5""")
def _l2(g, sources=("src1", "src2")):
    # the cut comes before the filter: what lies below the first 1200 is out, whatever its source
    inside = _ranked(g, 1200).join(g.passage.where(F.col("source").isin(*sources)).select("doc_id"), "doc_id", "left_semi")
    return top_per_group(inside, ["item_id"], [F.col("rn")], 5, "k").select("item_id", "doc_id", "k")


@query("L3_source_discovery", f"WITH {_HITS_SQL}, {_cut_sql(300)} SELECT c.item_id, v.source, min(c.rn) AS best FROM cut c JOIN passage v USING (doc_id) GROUP BY 1, 2")
def _l3(g):
    return _ranked(g, 300).join(g.passage.select("doc_id", "source"), "doc_id").groupBy("item_id", "source").agg(F.min("rn").alias("best"))


@query("A15_max_score_per_source", f"WITH {_HITS_SQL} SELECT v.source, max(h.score) AS score, count(*) AS hits FROM hit h JOIN passage v USING (doc_id) GROUP BY 1")
def _a15(g):
    return found(g).join(g.passage.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("score").alias("score"), F.count("*").alias("hits"))


@query("J21_full_text_linking", f"""WITH {_HITS_SQL}, {_cut_sql(8)},
l AS (SELECT c.item_id, a.account, count(DISTINCT o.obs_id) AS hits FROM cut c JOIN observation o USING (doc_id) JOIN account a USING (custkey) GROUP BY 1, 2)
SELECT item_id, account, hits FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, account) AS r FROM l) WHERE r <= 4""")
def _j21(g):
    l = _ranked(g, 8).join(g.observation, "doc_id").join(g.account, "custkey").groupBy("item_id", "account").agg(F.countDistinct("obs_id").alias("hits"))  # noqa: E741
    return top_per_group(l, ["item_id"], [F.desc("hits"), F.col("account")], 4).select("item_id", "account", "hits")


@query("L4_ranked_claims", "SELECT claim_id, status FROM claim ORDER BY CASE status WHEN 'CRITICAL' THEN 0 WHEN 'VERIFIED' THEN 1 WHEN 'CANDIDATE' THEN 2 ELSE 3 END, claim_id DESC LIMIT 25")
def _l4(g):
    from provena.operators.patterns import status_rank

    return g.claim.orderBy(status_rank(), F.desc("claim_id")).limit(25).select("claim_id", "status")


@query("L5_pagination", "SELECT account, (SELECT count(*) FROM account WHERE kind = 'customer') AS total FROM account WHERE kind = 'customer' ORDER BY account LIMIT 50 OFFSET 100")
def _l5(g, offset=100, limit=50):
    limit = max(1, min(limit, 200))
    a = g.account.where("kind = 'customer'")
    page = a.orderBy("account").offset(offset).limit(limit).select("account")
    return page.crossJoin(F.broadcast(a.agg(F.count("*").alias("total"))))


@query("L6_small_source_read", "WITH s AS (SELECT source, lang FROM evidence GROUP BY 1, 2 HAVING count(*) <= 12), x AS (SELECT v.doc_id, v.source, len(list_filter(['the', 'en', 'de', 'la', 'und'], lambda t: contains(lower(v.snippet), t))) AS hits FROM evidence v JOIN s USING (source, lang)) SELECT source, doc_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hits DESC, doc_id) AS rn FROM x) WHERE rn <= 12")
def _l6(g, ts=("the", "en", "de", "la", "und")):
    s = g.evidence.groupBy("source", "lang").count().where("count <= 12")
    hits = F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: F.contains(F.lower("snippet"), t))).cast("long")
    x = g.evidence.join(s, ["source", "lang"], "left_semi").select("source", "doc_id", hits.alias("hits"))
    return top_per_group(x, ["source"], [F.desc("hits"), F.col("doc_id")], 12).select("source", "doc_id", "hits")


@query("W1_relation_groups", "SELECT type, from_key, to_key FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY from_key, to_key) AS rn FROM edge) WHERE rn <= 40")
def _w1(g):
    return top_per_group(g.edge, ["type"], [F.col("from_key"), F.col("to_key")], 40).select("type", "from_key", "to_key")


@query("W2_source_quota", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM evidence) WHERE rn <= CASE WHEN n <= 12 THEN n WHEN n <= 500 THEN 12 ELSE 3 END")
def _w2(g):
    v = g.evidence
    n = v.groupBy("source").agg(F.count("*").alias("n"))
    # no source gives more than 12, so the window keeps 12 candidates and needs no count of its own
    top = top_per_group(v, ["source"], [F.col("doc_id")], 12).join(n, "source")
    return top.where("rn <= CASE WHEN n <= 12 THEN n WHEN n <= 500 THEN 12 ELSE 3 END").select("doc_id", "source")


@query("W3_round_robin", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM evidence) ORDER BY rn, source LIMIT 24")
def _w3(g, budget=24):
    return top_per_group(g.evidence, ["source"], [F.col("doc_id")], budget).orderBy("rn", "source").limit(budget).select("doc_id", "source")


@query("W4_running_budget", "WITH s AS (SELECT source, count(*) AS total FROM evidence GROUP BY 1), c AS (SELECT *, sum(total) OVER (ORDER BY total, source) AS cum, row_number() OVER (ORDER BY total, source) AS rn FROM s) SELECT source, total FROM c WHERE cum <= 400 OR rn = 1")
def _w4(g, budget=400):
    s = g.evidence.groupBy("source").agg(F.count("*").alias("total"))
    w = Window.orderBy("total", "source")  # over one row a source
    return s.withColumn("cum", F.sum("total").over(w)).withColumn("rn", F.row_number().over(w)).where(f"cum <= {budget} OR rn = 1").select("source", "total")


@query("W5_rare_first", "WITH n AS (SELECT source, lang, count(*) AS n FROM evidence GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY n <= 12 ORDER BY source, lang) AS rn FROM n) SELECT source, lang, n FROM r WHERE rn <= CASE WHEN n <= 12 THEN 8 ELSE 6 END")
def _w5(g):
    n = g.evidence.groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("rare", F.col("n") <= 12)
    return top_per_group(n, ["rare"], [F.col("source"), F.col("lang")], 8).where("rn <= CASE WHEN rare THEN 8 ELSE 6 END").select("source", "lang", "n")


def numbered(df: DataFrame, group: str, order: list[str], name: str = "pos") -> DataFrame:
    """`df` with each row's place within its group, 1 on, for groups of any size.

    Rows are dealt in ranges of (group, order) and numbered within a range; what the ranges before hold of the group is added, one number a
    range and group.  So a group that holds a third of all rows is spread over a third of the tasks.  Rows equal in `order` have their places in no fixed order.
    """
    dealt = stored(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), before.alias("_before"))
    inner = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)))
    on = inner[group].eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))
    return inner.join(starts, on).select(*df.columns, (F.col("_rn") + F.col("_before")).alias(name))


@query("W8_natural_order", """WITH e AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN locator WHEN 1 THEN 'sheet ' || doc_id // 7 || ' row ' || doc_id % 7 ELSE (doc_id % 50) || '-' || substr(source, 1, 3) || doc_id END AS locator FROM evidence),
k AS (SELECT doc_id, source, list_transform(regexp_extract_all(locator, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '1' || lpad(x, 30, '0') ELSE '0' || x END) AS k FROM e)
SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS pos FROM k""")
def _w8(g):
    """Documents of a source in the order of three kinds of locators: words before numbers, numbers by value, of any length; then by id."""
    i, text = F.col("doc_id"), lambda c: c.cast("string")
    sheet = F.concat(F.lit("sheet "), text(F.floor(i / 7)), F.lit(" row "), text(i % 7))
    at = F.when(i % 3 == 0, F.col("locator")).when(i % 3 == 1, sheet).otherwise(F.concat(text(i % 50), F.lit("-"), F.substring("source", 1, 3), text(i)))
    plain = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    chunk = F.transform(F.regexp_extract_all(at, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda x: F.struct(x.rlike("^[0-9]").alias("is_num"), F.when(x.rlike("^[0-9]"), F.length(plain(x))).alias("digits"), plain(x).alias("text")))
    return numbered(g.evidence.select("doc_id", "source", chunk.alias("k")), "source", ["k", "doc_id"]).select("doc_id", "pos")


@query("W9_occurrence_suffix", "SELECT p_partkey AS id, CASE WHEN rn = 1 THEN p_name ELSE p_name || ' (' || rn || ')' END AS locator FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)")
def _w9(g):
    rn = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    p = g.part.withColumn("rn", rn)
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("rn") == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ("), F.col("rn").cast("string"), F.lit(")"))).alias("locator"))


@query("W10_previous_value", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def _w10(g):
    return g.events.select("event_id", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


@query("W11_forward_fill", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations")
def _w11(g):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return g.conversations.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(w).alias("asked"))


def merge_first(df: DataFrame, key: list[str], seq: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """Merge rows of one identity: scalars keep their first value that isn't null, lists their ordered union."""
    out = []
    for c in df.columns:
        if c in key or c == seq:
            continue
        pairs = F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(seq, c))))
        out.append(F.array_distinct(F.flatten(pairs.getField(c))).alias(c) if c in lists else F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c))
    return df.groupBy(*key).agg(*out)


@query("U1_merge_on_identity", "WITH t AS (SELECT p_name AS name, p_partkey AS seq, CASE WHEN p_size > 10 THEN p_brand END AS brand, p_size AS size FROM part) SELECT name, arg_min(brand, seq) FILTER (brand IS NOT NULL) AS brand, arg_min(size, seq) AS size FROM t GROUP BY 1")
def _u1(g):
    t = g.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"), F.col("p_size").alias("size"))
    return merge_first(t, ["name"], "seq")


@query("U2_patch_and_replace", "WITH old AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS seg FROM customer WHERE c_acctbal >= 0), new AS (SELECT c_custkey AS id, lower(c_mktsegment) AS seg FROM customer WHERE c_acctbal < 5000) SELECT coalesce(o.id, n.id) AS id, coalesce(o.seg, n.seg) AS patched, coalesce(n.seg, o.seg) AS replaced FROM old o FULL JOIN new n ON o.id = n.id")
def _u2(g):
    old = g.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("old"))
    new = g.customer.where("c_acctbal < 5000").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("new"))
    return old.join(new, "id", "full").select("id", F.coalesce("old", "new").alias("patched"), F.coalesce("new", "old").alias("replaced"))


def scope_or_global(scoped: DataFrame, everything: DataFrame, least: int = 3) -> DataFrame:
    """(need, relaxed): the scoped rows; where they are fewer than `least`, all others too, marked as relaxed."""
    n = scoped.agg(F.count("*").alias("n"))
    rest = everything.join(scoped, "need", "left_anti").crossJoin(F.broadcast(n)).where(F.col("n") < least)  # one row
    return scoped.withColumn("relaxed", F.lit(False)).unionByName(rest.select("need", F.lit(True).alias("relaxed")))


@query("U4_scope_or_global", """
WITH sc AS (SELECT DISTINCT 'nation' AS scope, need FROM has_need WHERE nationkey = (SELECT max(nationkey) FROM (SELECT nationkey FROM has_need GROUP BY 1 HAVING count(DISTINCT need) >= 3))
  UNION SELECT 'account', need FROM has_need WHERE custkey = (SELECT min(custkey) FROM (SELECT custkey FROM has_need GROUP BY 1 HAVING count(*) < 3))), n AS (SELECT scope, count(*) AS n FROM sc GROUP BY 1)
SELECT scope, need, false AS relaxed FROM sc UNION ALL SELECT n.scope, h.need, true FROM n, (SELECT DISTINCT need FROM has_need) h WHERE n.n < 3 AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.scope = n.scope AND sc.need = h.need)""")
def _u4(g):
    """A nation with three needs or more keeps its own; an account with fewer gets the others too."""
    everything = g.has_need.select("need").distinct()
    nation = g.has_need.groupBy("nationkey").agg(F.countDistinct("need").alias("n")).where("n >= 3").agg(F.max("nationkey").alias("nationkey"))
    account = g.has_need.groupBy("custkey").agg(F.count("*").alias("n")).where("n < 3").agg(F.min("custkey").alias("custkey"))
    parts = [(name, g.has_need.join(F.broadcast(one), key, "left_semi").select("need").distinct()) for name, one, key in (("nation", nation, "nationkey"), ("account", account, "custkey"))]
    a, b = (scope_or_global(s, everything).select(F.lit(name).alias("scope"), "need", "relaxed") for name, s in parts)
    return a.unionByName(b)


@query("U5_priority_union", "SELECT source, min(p) AS priority FROM (SELECT source, 0 AS p FROM source WHERE sensitivity = 'restricted' UNION ALL SELECT DISTINCT source, 1 FROM evidence WHERE lang = 'en' UNION ALL SELECT source, 2 FROM source) GROUP BY 1")
def _u5(g):
    parts = [g.source.where("sensitivity = 'restricted'"), g.evidence.where("lang = 'en'"), g.source]
    u = parts[0].select("source", F.lit(0).alias("p"))
    for i, p in enumerate(parts[1:], 1):
        u = u.unionByName(p.select("source", F.lit(i).alias("p")))
    return u.groupBy("source").agg(F.min("p").alias("priority"))


@query("U6_keep_first_union", "SELECT doc_id, min_by(origin, p) AS origin FROM (SELECT doc_id, 'graph' AS origin, 0 AS p FROM observation UNION ALL SELECT claim_id, 'critical', 1 FROM claim WHERE toxic = 1 UNION ALL SELECT doc_id, 'raw', 2 FROM evidence) GROUP BY 1")
def _u6(g):
    u = g.observation.select("doc_id", F.lit("graph").alias("origin"), F.lit(0).alias("p")).unionByName(g.claim.where("toxic = 1").select(F.col("claim_id").alias("doc_id"), F.lit("critical").alias("origin"), F.lit(1).alias("p"))).unionByName(g.evidence.select("doc_id", F.lit("raw").alias("origin"), F.lit(2).alias("p")))
    return u.groupBy("doc_id").agg(F.min_by("origin", "p").alias("origin"))


@query("U7_flag_intersection", "SELECT claim_id, len(list_intersect(string_split(lanes, '|'), ['critical', 'conflict'])) > 0 AS flagged FROM claim")
def _u7(g):
    return g.claim.select("claim_id", F.arrays_overlap(F.split("lanes", r"\|"), F.array(F.lit("critical"), F.lit("conflict"))).alias("flagged"))


@query("A26_pool_idf", "WITH p AS (SELECT lower(snippet) AS s FROM evidence), t AS (SELECT unnest(['the', 'token', 'ción', 'idiot']) AS term) SELECT term, count(*) FILTER (contains(s, term)) AS df, round(ln((count(*) + 1.0) / (count(*) FILTER (contains(s, term)) + 1.0)), 6) AS idf FROM p, t GROUP BY 1")
def _a26(g, ts=("the", "token", "ción", "idiot")):
    # one pass over the pool: a conditional count for each term
    p = g.evidence.select(F.lower("snippet").alias("s"))
    row = p.agg(F.count("*").alias("n"), F.array(*[F.struct(F.lit(t).alias("term"), F.count_if(F.contains("s", F.lit(t))).alias("df")) for t in ts]).alias("x"))
    return row.select("n", F.inline("x")).select("term", "df", F.round(F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)), 6).alias("idf"))


@query("A27_aggregate_rank", "WITH r AS (SELECT need, dense_rank() OVER (ORDER BY need) - 1 AS i, orderkey FROM need_row), x AS (SELECT i, orderkey, row_number() OVER (PARTITION BY i ORDER BY orderkey) - 1 AS pos FROM r) SELECT orderkey, round(min(i + 0.06 * pos), 4) AS rank FROM x GROUP BY 1")
def _a27(g):
    # only the distinct needs are numbered in one task; positions are counted need by need
    number = g.need_row.select("need").distinct().withColumn("i", F.row_number().over(Window.orderBy("need")) - 1)
    pos = F.row_number().over(Window.partitionBy("need").orderBy("orderkey")) - 1
    ranked = g.need_row.select("need", "orderkey").withColumn("pos", pos).join(number, "need")
    return ranked.groupBy("orderkey").agg(F.round(F.min(F.col("i") + 0.06 * F.col("pos")), 4).alias("rank"))


@query("A28_marker_uniqueness", "SELECT s.sensitivity, count(*) FILTER (contains(v.snippet, 'token')) AS marked, count(DISTINCT v.source) FILTER (contains(v.snippet, 'token')) AS sources FROM evidence v JOIN source s USING (source) GROUP BY 1")
def _a28(g):
    has = F.contains("snippet", F.lit("token"))
    return g.evidence.join(g.source, "source").groupBy("sensitivity").agg(F.count_if(has).alias("marked"), F.countDistinct(F.when(has, F.col("source"))).alias("sources"))


@query("X5_evidence_score", "WITH p AS (SELECT doc_id, source, lower(snippet) AS s FROM evidence), t AS (SELECT term, ln((count(*) + 1.0) / (count(*) FILTER (contains(s, term)) + 1.0)) AS idf FROM p, (SELECT unnest(['the', 'token', 'reing']) AS term) GROUP BY 1) SELECT p.doc_id, round(3 * coalesce(sum(t.idf + 0.3), 0) + CASE WHEN p.doc_id % 7 = 0 THEN 4 * power(0.85, p.doc_id / 7) ELSE 0 END + CASE WHEN contains(p.source, 'src1') THEN 0.5 ELSE 0 END, 6) AS score FROM p LEFT JOIN t ON contains(p.s, t.term) GROUP BY p.doc_id, p.source".replace("p.doc_id / 7", "p.doc_id // 7"))
def _x5(g, ts=("the", "token", "reing")):
    p = g.evidence.select("doc_id", "source", F.lower("snippet").alias("s"))
    n = p.agg(F.count("*").alias("n"), *[F.count_if(F.contains("s", F.lit(t))).alias(f"d{i}") for i, t in enumerate(ts)])
    hits = sum((F.when(F.contains("s", F.lit(t)), F.log((F.col("n") + 1.0) / (F.col(f"d{i}") + 1.0)) + 0.3).otherwise(0.0) for i, t in enumerate(ts)), F.lit(0.0))
    ranked = F.when(F.col("doc_id") % 7 == 0, 4 * F.pow(F.lit(0.85), F.floor(F.col("doc_id") / 7))).otherwise(0.0)
    titled = F.when(F.contains("source", F.lit("src1")), 0.5).otherwise(0.0)
    return p.crossJoin(F.broadcast(n)).select("doc_id", F.round(3 * hits + ranked + titled, 6).alias("score"))


@query("H21_golden_quotes", "SELECT b.item_id, count(d.doc_id) AS documents FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def _h21(g):
    """How many documents hold each quote."""
    n = holding(g.documents, g.benchmark).groupBy("item_id").agg(F.count("*").alias("documents"))
    return g.benchmark.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"))
