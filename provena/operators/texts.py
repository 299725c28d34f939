"""Text functions applied to the tables: keys, excerpts, masking, overlaps, amounts and dates."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from provena.functions import text as X
from provena.operators.common import top_per_group
from provena.registry import query



@query("F2_fold", r"SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS folded FROM documents")
def _f2(g):
    return g.documents.select("doc_id", X.fold(F.col("text"), False).alias("folded"))


@query("F1_normalize", r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM passage")
def _f1(g):
    """No text of the tables holds a character that composition changes; a unit test has such."""
    return g.passage.select("doc_id", X.normalize(F.col("text")).alias("text"))


@query("F3_match_key", r"SELECT DISTINCT p_name, lower(regexp_replace(regexp_replace(regexp_replace(p_name, '[\(（][^)）]*[\)）]', ' ', 'g'), '(?i)(Inc\.?|Co\.?|Ltd\.?)', ' ', 'g'), '\s+', '', 'g')) AS key FROM part")
def _f3(g):
    return g.part.select("p_name", X.match_key(F.col("p_name")).alias("key")).distinct()


@query("F4_text_key", """SELECT doc_id, lower(regexp_replace(text, '[\\s·•\\-–—,.()\\[\\]/"''’“”]+', '', 'g')) AS key FROM documents""")
def _f4(g):
    return g.documents.select("doc_id", X.text_key(F.col("text")).alias("key"))


@query("F5_squeeze", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents")
def _f5(g):
    return g.documents.select("doc_id", X.squeeze(F.col("text")).alias("flat"))


def _terms_sql(text: str) -> str:
    """DuckDB's list of content terms."""
    cut = lambda w, ends: f"regexp_replace({w}, '^(.{{2,}}?)(?:{'|'.join(sorted(ends, key=len, reverse=True))})$', '\\1')"
    stem = f"lower({cut(cut(cut('w', X.PARTICLES), X.PARTICLES), X.ENDINGS)})"
    drop = ", ".join(f"'{w}'" for w in X.GENERIC + X.ENGLISH)
    return f"list_filter(list_distinct(list_transform(list_filter(regexp_split_to_array({text}, '[^0-9A-Za-z가-힣]+'), lambda w: w <> ''), lambda w: {stem})), lambda w: length(w) >= 2 AND w NOT IN ({drop}))"


@query("F6_content_terms", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS terms, list_min(t) AS first_term FROM (SELECT doc_id, {_terms_sql('text')} AS t FROM passage) WHERE len(t) > 0")
def _f6(g):
    t = g.passage.select("doc_id", X.content_terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("terms"), F.array_min("t").alias("first_term"))


@query("F7_search_terms", "SELECT item_id, array_to_string(list_sort(list_filter(" + _terms_sql("text") + ", lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in X.ONTOLOGY) + "))), ' ') AS terms FROM ask")
def _f7(g):
    return g.ask.select("item_id", F.array_join(F.sort_array(X.search_terms(F.col("text"))), " ").alias("terms"))


@query("F8_term_overlap", r"""
SELECT doc_id, array_to_string(list_filter(['the', 'reing', 'token', 'and of', 'été'], lambda t: CASE WHEN t = 'été' THEN contains(h, t) ELSE regexp_matches(h, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])') END), '|') AS hits
FROM (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents)""")
def _f8(g):
    terms = F.array(*map(F.lit, ("the", "reing", "token", "and of", "été")))
    return g.documents.select("doc_id", F.array_join(X.overlap(terms, F.col("text")), "|").alias("hits"))


@query("F10_sentence_count", r"""SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(regexp_replace(text, '([.!])(\s|$)', '\1' || chr(1) || '\2', 'g'), '([。?])', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10) || chr(9) || chr(13)) <> '')) AS n FROM documents""")
def _f10(g):
    ss = F.filter(F.split("text", r"(?<=[.!])(?=\s|$)|(?<=[。?])"), lambda s: F.regexp_replace(s, r"^[ \n\t\r]+|[ \n\t\r]+$", "") != "")
    return g.documents.select("doc_id", F.size(ss).cast("long").alias("n"))


@query("F11_number_tokens", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)*'), lambda x: replace(x, ',', '')))), '|') AS numbers FROM documents WHERE regexp_matches(text, '\d')")
def _f11(g):
    return g.documents.where(F.col("text").rlike(r"\d")).select("doc_id", F.array_join(F.sort_array(F.array_distinct(X.numbers(F.col("text")))), "|").alias("numbers"))


@query("F12_proper_nouns", f"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' (가상' || (doc_id % 7) || '은행)' WHEN 1 THEN ' 없는 보험, 새솔텔레콤 KB손해보험' ELSE ' 시스템' END AS text FROM documents)
SELECT doc_id, len(list_distinct(regexp_extract_all(text, '{X.PROPER}'))) AS n, array_to_string(regexp_extract_all(text, '{X.ORG}'), '|') AS organisations FROM t""")
def _f12(g):
    end = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" (가상"), (F.col("doc_id") % 7).cast("string"), F.lit("은행)"))).when(F.col("doc_id") % 3 == 1, " 없는 보험, 새솔텔레콤 KB손해보험").otherwise(" 시스템")
    t = g.documents.select("doc_id", F.concat("text", end).alias("text"))
    return t.select("doc_id", F.size(F.array_distinct(X.proper_nouns(F.col("text")))).cast("long").alias("n"), F.array_join(X.organisations(F.col("text")), "|").alias("organisations"))


_F13_SQL = """
WITH t AS (SELECT p_partkey AS id, p_size AS z, p_size || ['조 원', '억 달러', '만 엔', '천 유로', 'B USD', 'M USD', 'K USD'][1 + p_partkey % 7] || ' 대비 1,' || (100 + p_size) || '.5 원, ' || p_size || ' 개' AS s FROM part)
SELECT id, array_to_string(regexp_extract_all(s, '(\\d[\\d,]*(?:\\.\\d+)?)\\s*(조|억|만|천|B|M|K)?\\s*(달러|USD|원|엔|유로)', 1), '|') AS raw,
  ['원', '달러', '엔', '유로', 'USD', 'USD', 'USD'][1 + id % 7] || '|원' AS currencies, z * [1e12, 1e8, 1e4, 1e3, 1e9, 1e6, 1e3][1 + id % 7] + 1100.5 + z AS total FROM t"""


@query("F13_amounts", _F13_SQL)
def _f13(g):
    unit = F.element_at(F.array(*map(F.lit, ("조 원", "억 달러", "만 엔", "천 유로", "B USD", "M USD", "K USD"))), (1 + F.col("p_partkey") % 7).cast("int"))
    size = F.col("p_size").cast("string")
    t = g.part.select(F.col("p_partkey").alias("id"), X.amounts(F.concat(size, unit, F.lit(" 대비 1,"), (100 + F.col("p_size")).cast("string"), F.lit(".5 원, "), size, F.lit(" 개"))).alias("a"))
    return t.select("id", F.array_join("a.number", "|").alias("raw"), F.array_join("a.currency", "|").alias("currencies"), F.aggregate("a.value", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("F14_date_parse", """
WITH t AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 9 AS k FROM orders)
SELECT id, CASE WHEN k <= 4 THEN CAST(d AS VARCHAR) END AS day, CASE WHEN k <= 4 THEN 'ok' WHEN k <= 6 THEN 'empty' ELSE 'unparsable' END AS state FROM t""")
def _f14(g):
    """Orders' dates in five forms, two marks for none, a month that isn't, and a number that is no serial."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 9
    forms = [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyyMMdd"), F.date_format(d, "yyyy. M. d (E)"), F.concat(F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"), F.lit(".5")), F.date_format(d, "yyyy/M/d 09:00"), F.lit("N/A"), F.lit("  "), F.lit("2024-13-01"), F.lit("90001")]
    s = F.element_at(F.array(*forms), k.cast("int") + 1)
    x = g.orders.select(F.col("o_orderkey").alias("id"), X.parse_date(s).alias("p"))
    return x.select("id", F.col("p.day").cast("string").alias("day"), F.col("p.state").alias("state"))


@query("F15_recency_band", "SELECT custkey, CASE WHEN age <= 365 THEN 'current' WHEN age <= 730 THEN 'aging' ELSE 'stale' END AS band FROM (SELECT custkey, date_diff('day', CAST(max(observed_at) AS DATE), DATE '2000-06-01') AS age FROM deal GROUP BY 1)")
def _f15(g, today="2000-06-01"):
    age = F.datediff(F.lit(today).cast("date"), F.to_date(F.max("observed_at")))
    d = g.deal.groupBy("custkey").agg(age.alias("age"))
    return d.select("custkey", F.when(F.col("age") <= 365, "current").when(F.col("age") <= 730, "aging").when(F.col("age").isNull(), "unknown").otherwise("stale").alias("band"))


@query("F17_hash_id", "SELECT c_custkey AS id, sha256(c_name || '|' || coalesce(c_mktsegment, '')) AS key FROM customer")
def _f17(g):
    return g.customer.select(F.col("c_custkey").alias("id"), X.hash_id(F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@query("F19_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _f19(g):
    return g.events.select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


@query("F20_label_counts", "SELECT custkey, string_agg(statement || ':' || n, ',' ORDER BY statement) AS counts FROM (SELECT custkey, statement, count(*) AS n FROM observation GROUP BY 1, 2) GROUP BY 1")
def _f20(g):
    n = g.observation.groupBy("custkey", "statement").agg(F.count("*").alias("n"))
    m = n.groupBy("custkey").agg(F.sort_array(F.collect_list(F.struct("statement", "n"))).alias("m"))
    return m.select("custkey", F.array_join(F.transform("m", lambda x: F.concat(x.statement, F.lit(":"), x.n.cast("string"))), ",").alias("counts"))


@query("F21_locator_position", "SELECT doc_id, split_part(locator, '!', 1) AS source, CAST(regexp_extract(locator, '!D(\\d+)', 1) AS BIGINT) AS position FROM evidence")
def _f21(g):
    return g.evidence.select("doc_id", F.split_part("locator", F.lit("!"), F.lit(1)).alias("source"), F.regexp_extract("locator", r"!D(\d+)", 1).cast("long").alias("position"))


@query("F22_stage_labels", "SELECT deal_id, CASE outcome WHEN 'won' THEN 'closed won' WHEN 'lost' THEN 'closed lost' ELSE 'in progress' END AS label FROM deal")
def _f22(g):
    m = F.create_map(*map(F.lit, ("won", "closed won", "lost", "closed lost")))
    return g.deal.select("deal_id", F.coalesce(m[F.col("outcome")], F.lit("in progress")).alias("label"))


@query("F23_decay_weights", "SELECT doc_id % 20 AS r, round(4 * power(0.85, doc_id % 20), 6) AS w, count(*) AS n FROM evidence GROUP BY 1, 2")
def _f23(g):
    return g.evidence.select((F.col("doc_id") % 20).alias("r")).groupBy("r").agg(F.count("*").alias("n")).select("r", F.round(4 * F.pow(F.lit(0.85), F.col("r")), 6).alias("w"), "n")


@query("N1_packed_excerpts")
def _n1(g):
    """Line-preserving excerpts of at most 500 characters."""
    return g.documents.select("doc_id", F.posexplode(X.packed(F.col("text"))).alias("part", "excerpt"))


@query("N2_fixed_width_excerpts", "SELECT doc_id, i AS part, substr(text, 500 * i + 1, 500) AS excerpt FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500.0) AS INT))) AS i FROM documents)")
def _n2(g):
    return g.documents.select("doc_id", F.posexplode(X.excerpt_parts(F.col("text"))).alias("part", "excerpt"))


@query("N3_normalize_lines", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|[\r\x0b\x0c\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def _n3(g):
    return g.documents.select("doc_id", X.normalize_lines(F.col("text")).alias("text"))


_LIMBS_SQL = "list_transform(range(0, 8), lambda i: CAST(('0x' || substr(sha256({0}), CAST(i * 8 + 1 AS INT), 8)) AS BIGINT))"
_DIVIDE_SQL = "list_reduce(list_prepend(CAST([0] AS BIGINT[]), list_transform(a[1:8], lambda x: [x])), lambda q, b: list_concat([(q[1] * 4294967296 + b[1]) % 26], q[2:], [(q[1] * 4294967296 + b[1]) // 26]))"
_ALPHA_SQL = f"list_reduce(list_prepend({{0}}, list_transform(range(0, 24), lambda i: CAST([i] AS BIGINT[]))), lambda a, i: list_concat(({_DIVIDE_SQL})[2:9], a[9:], [({_DIVIDE_SQL})[1]]))"


@query("N4_evidence_ids", f"""
WITH l AS (SELECT doc_id, source, locator, snippet, {_LIMBS_SQL.format("source || '|' || locator")} AS limbs FROM evidence), c AS (SELECT *, {_ALPHA_SQL.format('limbs')} AS codes FROM l)
SELECT doc_id, 'ev_' || substr(sha256(source || '|' || locator || '|' || sha256(snippet)), 1, 16) AS evidence_id, 'ev_' || substr(sha256(source || '|' || locator), 1, 16) AS of_place, 'ev_' || array_to_string(list_transform(codes[9:], lambda r: chr(CAST(r + 97 AS INT))), '') AS of_cell FROM c""")
def _n4(g):
    """Ids by content, by place, and the form of spreadsheets' places, which has no digit."""
    ev = lambda c: F.concat(F.lit("ev_"), c)
    place = X.hash_id(F.col("source"), F.col("locator"))
    return g.evidence.select("doc_id", ev(F.substring(X.hash_id(F.col("source"), F.col("locator"), F.sha2(F.col("snippet").cast("binary"), 256)), 1, 16)).alias("evidence_id"), ev(F.substring(place, 1, 16)).alias("of_place"), ev(X.alpha_digest(F.concat_ws("|", "source", "locator"))).alias("of_cell"))


@query("N5_row_excerpt", "SELECT p_partkey AS id, concat_ws(' | ', 'name: ' || p_name, 'brand: ' || nullif(p_brand, ''), 'type: ' || p_type, 'size: ' || p_size) AS excerpt FROM part")
def _n5(g):
    cell = lambda k, c: F.concat(F.lit(f"{k}: "), F.nullif(F.col(c).cast("string"), F.lit("")))
    return g.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" | ", cell("name", "p_name"), cell("brand", "p_brand"), cell("type", "p_type"), cell("size", "p_size")).alias("excerpt"))


@query("N6_mask")
def _n6(g):
    m = g.documents.select("doc_id", X.masked(F.col("text")).alias("m"))
    return m.select("doc_id", "m.text", F.array_join(F.sort_array(F.transform(F.map_entries("m.hits"), lambda e: F.concat(e.key, F.lit(":"), e.value.cast("string")))), ",").alias("counts"))


@query("H15_row_evidence", r"""SELECT c_custkey AS id, 'name: ' || c_name || ' | contact: ' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '[담당자]' END || ' | phone: 010-****-**** | limit: ' || CASE WHEN c_custkey % 2 = 0 THEN 6000000000 + c_custkey ELSE c_custkey END AS excerpt,
  CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS hits, c_name AS raw_name FROM customer""")
def _h15(g):
    """Each cell of a row is masked as it is read; numeric cells aren't searched for numbers of businesses; raw cells keep what isn't personal."""
    key = F.col("c_custkey")
    cells = g.customer.select(
        key.alias("id"), F.col("c_name").alias("raw_name"), X.masked(F.col("c_name")).alias("name"),
        X.masked(F.when(key % 3 == 0, "").otherwise("Kim Lee"), column="담당자").alias("contact"),
        X.masked(F.concat(F.lit("010-"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("-5678"))).alias("phone"),
        X.masked(F.when(key % 2 == 0, 6000000000 + key).otherwise(key).cast("string"), number=True).alias("limit"))
    names = ("name", "contact", "phone", "limit")
    hits = sum((F.aggregate(F.map_values(f"{c}.hits"), F.lit(0), lambda a, x: a + x) for c in names), F.lit(0))
    return cells.select("id", F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.col(f"{c}.text")) for c in names]).alias("excerpt"), hits.alias("hits"), "raw_name")


@query("H17_email_allow_list", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'write to help@corp.example' ELSE 'write to ***@***.***' END AS text FROM customer")
def _h17(g, allow=("help@corp.example",)):
    """Addresses of public desks stay readable; all others go."""
    said = F.concat(F.lit("write to "), F.when(F.col("c_custkey") % 2 == 0, "help").otherwise(F.concat(F.lit("user"), F.col("c_custkey").cast("string"))), F.lit("@corp.example"))
    return g.customer.select(F.col("c_custkey").alias("id"), X.masked(said, allow)["text"].alias("text"))


@query("N7_mask_scan", r"SELECT lang, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))) AS BIGINT) AS emails, CAST(sum(len(regexp_extract_all(text, '\(\d{3}\) \d{3}-\d{4}'))) AS BIGINT) AS phones FROM documents GROUP BY 1")
def _n7(g):
    n = lambda rx: F.sum(F.regexp_count("text", F.lit(rx))).cast("long")
    return g.documents.groupBy("lang").agg(n(X.EMAIL).alias("emails"), n(r"\(\d{3}\) \d{3}-\d{4}").alias("phones"))


@query("N8_account_resolution", "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE coalesce(alias, lower(regexp_replace(c_name, '\\s+', '', 'g'))) END AS account FROM customer LEFT JOIN (SELECT c_custkey, 'group ' || c_nationkey AS alias FROM customer WHERE c_custkey % 10 = 0) USING (c_custkey)")
def _n8(g):
    """Exclusions, then exact aliases, then the display name's key; never a fuzzy match."""
    alias = g.customer.where("c_custkey % 10 = 0").select(X.match_key(F.col("c_name")).alias("k"), F.concat(F.lit("group "), F.col("c_nationkey").cast("string")).alias("alias"))
    c = g.customer.withColumn("k", X.match_key(F.col("c_name"))).join(alias, "k", "left")
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") != "MACHINERY", F.coalesce("alias", "k")).alias("account"))


@query("N11_product_mentions", "SELECT DISTINCT d.doc_id, w.t AS term FROM documents d JOIN (SELECT unnest(['license', 'token', 'reing', 'thion']) AS t) w ON contains(lower(d.text), w.t)")
def _n11(g, terms=("license", "token", "reing", "thion")):
    hit = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("text"), t))
    return g.documents.select("doc_id", F.explode(hit).alias("term")).distinct()


@query("N13_account_scope_split", "SELECT DISTINCT p_name, CASE WHEN split_part(p_name, ' ', 1) IN (SELECT split_part(p_name, ' ', 1) FROM part WHERE p_size > 45) AND contains(p_name, ' ') THEN split_part(p_name, ' ', 2) END AS scope FROM part")
def _n13(g):
    head = F.split_part("p_name", F.lit(" "), F.lit(1))
    known = g.part.where("p_size > 45").select(head.alias("head")).distinct().withColumn("known", F.lit(True))
    p = g.part.select("p_name", head.alias("head")).distinct().join(known, "head", "left")
    return p.select("p_name", F.when(F.col("known") & F.contains("p_name", F.lit(" ")), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("scope"))


@query("N15_parse_amount", "WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_size || '억' WHEN 1 THEN '4억 -> ' || p_size || '.5억 (잠정)' WHEN 2 THEN p_size || '원' WHEN 3 THEN '123456' || p_size ELSE p_size || '~3억' END AS s, p_size FROM part) SELECT id, CASE id % 5 WHEN 0 THEN p_size * 1e8 WHEN 1 THEN (p_size + 0.5) * 1e8 WHEN 3 THEN CAST(s AS DOUBLE) END AS won FROM t")
def _n15(g):
    z = F.col("p_size").cast("string")
    s = (F.when(F.col("p_partkey") % 5 == 0, F.concat(z, F.lit("억"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("4억 -> "), z, F.lit(".5억 (잠정)")))
         .when(F.col("p_partkey") % 5 == 2, F.concat(z, F.lit("원"))).when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("123456"), z)).otherwise(F.concat(z, F.lit("~3억"))))
    return g.part.select(F.col("p_partkey").alias("id"), X.parse_amount(s).alias("won"))


@query("N16_dedup_by_value", "SELECT stage, outcome, CAST(min(deal_id) AS BIGINT) AS kept, count(*) AS copies, string_agg(DISTINCT CAST(year(observed_at) AS VARCHAR), '|' ORDER BY CAST(year(observed_at) AS VARCHAR)) AS sheets FROM deal GROUP BY 1, 2")
def _n16(g):
    return g.deal.groupBy("stage", "outcome").agg(F.min("deal_id").alias("kept"), F.count("*").alias("copies"), F.array_join(F.sort_array(F.collect_set(F.year("observed_at").cast("string"))), "|").alias("sheets"))


@query("N17_dedup_by_change", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def _n17(g):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return g.events.withColumn("before", before).where("before IS NULL OR before <> event_type").select("event_id")


@query("N19_deal_outcomes", "SELECT o_orderstatus AS stage, CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'P' THEN 'lost' ELSE 'open' END AS outcome, count(*) AS n, count(TRY_CAST(o_orderpriority AS DOUBLE)) AS with_probability FROM orders GROUP BY 1, 2")
def _n19(g):
    outcome = F.when(F.col("o_orderstatus") == "F", "won").when(F.col("o_orderstatus") == "P", "lost").otherwise("open")
    return g.orders.groupBy(F.col("o_orderstatus").alias("stage"), outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count(F.col("o_orderpriority").try_cast("double")).alias("with_probability"))


_N20_LEVELS = [("name", 49), ("size", 46), ("area", 40), ("introduced_in", 30)]
_N20_SQL = " ".join(f"LEFT JOIN (SELECT {c}, min(capability) AS capability FROM feature WHERE feature.size >= {n} AND feature_id % 3 = 0 GROUP BY 1) l{i} ON l{i}.{c} = f.{c}" for i, (c, n) in enumerate(_N20_LEVELS))


@query("N20_most_specific_level", f"SELECT f.feature_id, coalesce(l0.capability, l1.capability, l2.capability, l3.capability) AS capability, CASE WHEN l0.capability IS NOT NULL THEN 'name' WHEN l1.capability IS NOT NULL THEN 'size' WHEN l2.capability IS NOT NULL THEN 'area' WHEN l3.capability IS NOT NULL THEN 'introduced_in' END AS level FROM feature f {_N20_SQL}")
def _n20(g):
    """Of four levels of hints, each a small table, the most specific one that knows a feature decides."""
    f = g.feature
    for i, (c, least) in enumerate(_N20_LEVELS):
        f = f.join(g.feature.where((F.col("size") >= least) & (F.col("feature_id") % 3 == 0)).groupBy(c).agg(F.min("capability").alias(f"l{i}")), c, "left")
    found = [F.col(f"l{i}") for i in range(len(_N20_LEVELS))]
    level = F.coalesce(*[F.when(x.isNotNull(), F.lit(c)) for x, (c, _) in zip(found, _N20_LEVELS, strict=True)])
    return f.select("feature_id", F.coalesce(*found).alias("capability"), level.alias("level"))


@query("N22_conflict_lane", "WITH k AS (SELECT custkey FROM claim GROUP BY 1 HAVING count(DISTINCT status) >= 2) SELECT claim_id, CASE WHEN custkey IN (SELECT custkey FROM k) THEN lanes || '|conflict' ELSE lanes END AS lanes FROM claim")
def _n22(g):
    k = g.claim.groupBy("custkey").agg((F.countDistinct("status") >= 2).alias("conflict"))
    c = g.claim.join(k, "custkey")
    return c.select("claim_id", F.when(F.col("conflict"), F.array_join(F.array_union(F.split("lanes", r"\|"), F.array(F.lit("conflict"))), "|")).otherwise(F.col("lanes")).alias("lanes"))


@query("N23_extraction_pool", """
WITH v AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS depth FROM evidence WHERE lang IN ('en', 'de') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND source <> 'src4')
SELECT doc_id, source, depth, pos FROM (SELECT *, row_number() OVER (ORDER BY depth, source) AS pos FROM v WHERE depth <= 10) WHERE pos <= 120""")
def _n23(g, cap=10, pool=120, langs=("en", "de"), skip=("src4",)):
    """Excerpts in turn from each source, deeper from round to round, without those that were extracted before and sources to skip."""
    done = g.labels.where("toxic = 1").select("doc_id")
    v = g.evidence.where(F.col("lang").isin(*langs) & ~F.col("source").isin(*skip)).join(done, "doc_id", "left_anti")
    v = top_per_group(v, ["source"], [F.col("doc_id")], cap, "depth").select("doc_id", "source", "depth")
    # the pool's first rows are taken before they are numbered, so the window without a partition sees no more than these
    first = v.orderBy("depth", "source").limit(pool)
    return first.withColumn("pos", F.row_number().over(Window.orderBy("depth", "source")))


@query("N26_best_amount", "SELECT custkey, deal_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY CASE outcome WHEN 'won' THEN 0 WHEN 'open' THEN 1 ELSE 2 END, observed_at DESC, amount DESC, deal_id) AS rn FROM deal) WHERE rn = 1")
def _n26(g):
    kind = F.when(F.col("outcome") == "won", 0).when(F.col("outcome") == "open", 1).otherwise(2)
    return top_per_group(g.deal, ["custkey"], [kind, F.desc("observed_at"), F.desc("amount"), F.col("deal_id")], 1).select("custkey", "deal_id", "amount")


@query("N28_ingest_statistics", "SELECT 'edge' AS kind, type AS name, count(*) AS n FROM edge GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM claim GROUP BY 2 UNION ALL SELECT 'lane', l, count(*) FROM (SELECT unnest(string_split(lanes, '|')) AS l FROM claim) GROUP BY 2")
def _n28(g):
    c = lambda df, kind, col: df.groupBy(F.lit(kind).alias("kind"), F.col(col).alias("name")).agg(F.count("*").alias("n"))
    lanes = g.claim.select(F.explode(F.split("lanes", r"\|")).alias("lane"))
    return c(g.edge, "edge", "type").unionByName(c(g.claim, "status", "status")).unionByName(c(lanes, "lane", "lane"))


@query("N29_graph_fingerprint", "SELECT type, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(from_key || '|' || to_key), 1, 8)) AS BIGINT)) AS BIGINT) AS fingerprint FROM edge GROUP BY 1")
def _n29(g):
    """An order-free sum of key hashes: the same for any partitioning, without one ordered list of all keys."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "from_key", "to_key").cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return g.edge.groupBy("type").agg(F.count("*").alias("n"), F.sum(h).alias("fingerprint"))


@query("N30_contract_validation", "SELECT p_partkey AS id, CASE WHEN p_size NOT BETWEEN 1 AND 45 THEN 'size out of range' WHEN p_type NOT IN ('STANDARD', 'SMALL', 'MEDIUM', 'LARGE', 'ECONOMY') THEN 'unknown type' END AS error FROM part WHERE p_size NOT BETWEEN 1 AND 45 OR p_type NOT IN ('STANDARD', 'SMALL', 'MEDIUM', 'LARGE', 'ECONOMY')")
def _n30(g):
    checks = [(~F.col("p_size").between(1, 45), "size out of range"), (~F.col("p_type").isin("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY"), "unknown type")]
    return g.part.select(F.col("p_partkey").alias("id"), F.coalesce(*[F.when(c, m) for c, m in checks]).alias("error")).where("error IS NOT NULL")


@query("N10_need_mapping", "WITH t AS (SELECT DISTINCT lower(p_name) AS k, min(p_partkey) AS need_id FROM part WHERE p_size <= 25 GROUP BY 1), b AS (SELECT need, row_number() OVER (PARTITION BY custkey ORDER BY orderkey, need) AS pos, custkey FROM need_row) SELECT b.custkey, arg_min(t.need_id, b.pos) AS need_id, count(*) FILTER (t.need_id IS NULL) AS unmapped FROM b LEFT JOIN t ON t.k = lower(b.need) GROUP BY 1")
def _n10(g):
    """Bullets map to a taxonomy by exact key; the first mapped one wins, misses are counted, never created."""
    t = g.part.where("p_size <= 25").groupBy(X.text_key(F.col("p_name")).alias("k")).agg(F.min("p_partkey").alias("need_id"))
    b = g.need_row.withColumn("pos", F.row_number().over(Window.partitionBy("custkey").orderBy("orderkey", "need"))).withColumn("k", X.text_key(F.col("need")))
    x = b.join(t, "k", "left")
    return x.groupBy("custkey").agg(F.min_by("need_id", F.when(F.col("need_id").isNotNull(), F.col("pos"))).alias("need_id"), F.count_if(F.col("need_id").isNull()).alias("unmapped"))


@query("N12_domain_split_rules", "WITH r AS (SELECT domain, nationkey, bd_status, CASE WHEN bd_status = 'candidate' THEN [domain || ' A', domain || ' B'] ELSE [domain] END AS parts FROM domain) SELECT domain, unnest(parts) AS mapped, bd_status = 'candidate' AND nationkey % 2 = 0 AS needs_human_confirm, CASE WHEN bd_status = 'excluded' THEN 'not settled' END AS refused FROM r")
def _n12(g):
    """Values of a cell by the rules of its column: some split, some wait for a person's word, some aren't settled and link nothing."""
    rule = F.when(F.col("bd_status") == "candidate", F.struct(F.lit("/").alias("mark"), (F.col("nationkey") % 2 == 0).alias("confirm"))).otherwise(F.struct(F.lit(None).cast("string").alias("mark"), F.lit(False).alias("confirm")))
    cell = F.when(F.col("bd_status") == "candidate", F.concat("domain", F.lit(" A / "), "domain", F.lit(" B"))).otherwise(F.col("domain"))
    d = g.domain.select("domain", "bd_status", rule.alias("r"), cell.alias("cell"))
    parts = F.when(F.col("r.mark").isNull(), F.array("cell")).otherwise(F.transform(F.split("cell", F.col("r.mark")), lambda x: F.trim(x)))
    return d.select("domain", F.explode(parts).alias("mapped"), F.col("r.confirm").alias("needs_human_confirm"), F.when(F.col("bd_status") == "excluded", "not settled").alias("refused"))


@query("N14_target_industries", "SELECT DISTINCT * FROM (SELECT p_name, unnest([p_name, p_type, p_brand]) AS industry FROM part)")
def _n14(g, generic=("etc",)):
    cell = F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit("/"), F.col("p_brand"), F.lit(", etc"))
    xs = F.array_distinct(F.filter(F.transform(F.split(cell, "[,/]"), lambda x: F.trim(x)), lambda x: ~x.isin(*generic)))
    return g.part.select("p_name", F.explode(xs).alias("industry")).distinct()


_N24_ROWS = "SELECT doc_id, source, concat(CASE WHEN doc_id % 4 = 0 THEN concat('Customer#', lpad(cast(doc_id AS string), 9, '0'), ' asks for ') WHEN doc_id % 4 = 1 THEN 'somebody asks for ' ELSE concat('customer#', lpad(cast(doc_id * 3 AS string), 9, '0'), ': ') END, CASE WHEN doc_id % 3 = 0 THEN concat(cast(doc_id AS string), '억') WHEN doc_id % 3 = 1 THEN 'no amount' ELSE '3천만원' END) AS text FROM {documents}"


@query("N24_deal_amount_pool", f"""WITH t AS ({_N24_ROWS.replace('{', '').replace('}', '').replace('AS string', 'AS VARCHAR')})
SELECT t.doc_id, a.account FROM t JOIN account a ON lower(a.account) = lower(regexp_extract(t.text, '(?i)customer#[0-9]+')) WHERE regexp_matches(t.text, '[0-9](억|천만원)')""")
def _n24(g):
    """Excerpts that name an account and an amount: account names are found as whole words by a join, whatever their number."""
    from provena.operators.questions import link

    t = g.spark.sql(_N24_ROWS, documents=g.documents).where(F.col("text").rlike(rf"\d\s*({'|'.join(X.UNITS)})"))
    names = g.account.select(F.lit("Account").alias("label"), F.col("account").alias("key"), F.col("account").alias("surface"), F.lit(0).alias("priority"))
    return link(t.withColumnRenamed("doc_id", "item_id"), names).select(F.col("item_id").alias("doc_id"), F.col("key").alias("account"))


@query("N21_claim_emission", "SELECT claim_id, sha256(custkey || '|' || status) AS key, 'SUPPORTS' AS edge, claim_id AS evidence FROM claim UNION ALL SELECT claim_id, sha256(custkey || '|' || status), 'ABOUT', custkey FROM claim")
def _n21(g):
    key = X.hash_id(F.col("custkey"), F.col("status"))
    both = F.inline(F.array(F.struct(F.lit("SUPPORTS").alias("edge"), F.col("claim_id").alias("evidence")), F.struct(F.lit("ABOUT").alias("edge"), F.col("custkey").alias("evidence"))))
    return g.claim.select("claim_id", key.alias("key"), both)


@query("F9_question_subject", r"SELECT conv_id, turn, substr(regexp_replace(rtrim(trim(regexp_replace(text, '\s+', ' ', 'g')), '?.!'), ' (is|are|of|and|the)$', ''), 1, 120) AS subject FROM conversations WHERE role = 'user'")
def _f9(g):
    """The question's own words without its closing marks and a trailing function word, at most 120 characters."""
    s = F.regexp_replace(F.rtrim(X.squeeze(F.col("text")), F.lit("?.!")), " (is|are|of|and|the)$", "")
    return g.conversations.where("role = 'user'").select("conv_id", "turn", F.substring(s, 1, 120).alias("subject"))


@query("F18_array_functions", "SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS has, len(string_split(text, ' ')) AS n, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS first_three FROM documents")
def _f18(g):
    ws = F.split("text", " ")
    return g.documents.select("doc_id", F.array_contains(ws, "the").alias("has"), F.size(ws).cast("long").alias("n"), F.array_join(F.slice(ws, 1, 3), " ").alias("first_three"))
