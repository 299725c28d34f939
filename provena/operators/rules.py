"""Rule tables compiled to columns: verdicts, criticality, authority, strength, gaps, contradictions, routing, output gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from provena.functions import text as X
from provena.operators.common import looked_up, ordered_list, top_per_group
from provena.operators.quotes import KEYS_IN_PLAN, holding
from provena.registry import query

#: Override rules in ascending precedence; a later one overwrites an earlier one.
OVERRIDES = [
    {"when": "extractor = 'llm'", "verified_allowed": False, "status": "CANDIDATE"},
    {"when": "critical", "lane": "critical", "status_if_allowed": "CRITICAL", "status_if_not": "UNVERIFIED"},
    {"when": "conflict", "lane": "conflict"},
    {"when": "unreadable", "verified_allowed": False, "status": "CANDIDATE"},
]


def verdict(df: DataFrame, rules: DataFrame) -> DataFrame:
    """`df` (source_type, claim_kind, extractor, critical, conflict, unreadable) with status and lanes.

    Rules are looked up by a broadcast join on their small table; missing pairs take the default. The last
    step keeps VERIFIED away from claims for which it isn't allowed.
    """
    x = df.join(F.broadcast(rules), ["source_type", "claim_kind"], "left")
    allowed = F.coalesce("verified_allowed", F.lit(False))
    status = F.coalesce("default_status", F.when(allowed, "VERIFIED").otherwise("CANDIDATE"))
    lanes = F.array(F.lit("default"))
    x = x.withColumn("_a", allowed).withColumn("_s", status).withColumn("_l", lanes)
    for o in OVERRIDES:
        on = F.expr(o["when"])
        if "verified_allowed" in o:
            x = x.withColumn("_a", F.when(on, o["verified_allowed"]).otherwise(F.col("_a")))
        if "lane" in o:
            x = x.withColumn("_l", F.when(on, F.array_union("_l", F.array(F.lit(o["lane"])))).otherwise(F.col("_l")))
        if "status" in o:
            x = x.withColumn("_s", F.when(on, o["status"]).otherwise(F.col("_s")))
        if "status_if_allowed" in o:
            x = x.withColumn("_s", F.when(on & F.col("_a"), o["status_if_allowed"]).when(on, o["status_if_not"]).otherwise(F.col("_s")))
    s = F.when(~F.col("_a") & (F.col("_s") == "VERIFIED"), "CANDIDATE").otherwise(F.col("_s"))
    return x.select(*df.columns, s.alias("status"), F.array_join("_l", "|").alias("lanes"))


@query("X1_verdicts", """
WITH t AS (SELECT l.doc_id, CASE d.lang WHEN 'en' THEN 'spec' WHEN 'de' THEN 'memo' ELSE 'other' END AS source_type, CASE WHEN quality = 1 THEN 'fact' ELSE 'judgment' END AS claim_kind, l.doc_id % 5 = 0 AS llm, toxic = 1 AS critical, l.doc_id % 7 = 0 AS conflict, l.doc_id % 11 = 0 AS unreadable FROM labels l JOIN documents d USING (doc_id)),
b AS (SELECT *, CASE WHEN llm OR unreadable THEN false ELSE source_type = 'spec' AND claim_kind = 'fact' END AS allowed, source_type = 'spec' AND claim_kind = 'fact' AND NOT llm AS allowed_then FROM t)
SELECT doc_id, CASE WHEN unreadable THEN 'CANDIDATE' WHEN critical AND allowed_then THEN 'CRITICAL' WHEN critical THEN 'UNVERIFIED' WHEN allowed THEN 'VERIFIED' ELSE 'CANDIDATE' END AS status,
  'default' || CASE WHEN critical THEN '|critical' ELSE '' END || CASE WHEN conflict THEN '|conflict' ELSE '' END AS lanes FROM b""")
def _x1(g):
    rules = g.spark.createDataFrame([("spec", "fact", True, "VERIFIED"), ("spec", "judgment", False, "CANDIDATE"), ("memo", "fact", False, None)], "source_type string, claim_kind string, verified_allowed boolean, default_status string")
    t = g.labels.join(g.documents.select("doc_id", "lang"), "doc_id").selectExpr(
        "doc_id", "CASE lang WHEN 'en' THEN 'spec' WHEN 'de' THEN 'memo' ELSE 'other' END AS source_type", "CASE WHEN quality = 1 THEN 'fact' ELSE 'judgment' END AS claim_kind",
        "CASE WHEN doc_id % 5 = 0 THEN 'llm' ELSE 'deterministic' END AS extractor", "toxic = 1 AS critical", "doc_id % 7 = 0 AS conflict", "doc_id % 11 = 0 AS unreadable")
    return verdict(t, rules).select("doc_id", "status", "lanes")


#: Source types that are the record for a domain of claims, and outward-facing ones.
OF_RECORD = {"product": ("spec", "code"), "deal": ("log",)}
OUTWARD = ("brochure",)


def tier(source_type: Column, domain: Column, neutral: Column) -> Column:
    """T1 of record, T4 outward-facing, T2 verifiable, T3 known, T5 unknown."""
    record = F.lit(False)
    for d, types in OF_RECORD.items():
        record = record | ((domain == d) & source_type.isin(*types))
    return F.when(source_type.isNull(), "T5").when(~neutral & record, "T1").when(source_type.isin(*OUTWARD), "T4").when(source_type.isin("spec", "code", "log"), "T2").when(source_type == "memo", "T3").otherwise("T5")


@query("X4_authority_tiers", """
WITH t AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'spec' WHEN 'de' THEN 'memo' WHEN 'fr' THEN 'brochure' ELSE 'log' END AS st, CASE WHEN regexp_matches(lower(text), 'token|secret') THEN 'product' WHEN regexp_matches(lower(text), 'licen') THEN 'deal' END AS domain FROM documents)
SELECT doc_id, coalesce(domain, 'neutral') AS domain, CASE WHEN (domain = 'product' AND st = 'spec') OR (domain = 'deal' AND st = 'log') THEN 'T1' WHEN st = 'brochure' THEN 'T4' WHEN st IN ('spec', 'log') THEN 'T2' ELSE 'T3' END AS tier FROM t""")
def _x4(g):
    t = F.lower("text")
    domain = F.when(t.rlike("token|secret"), "product").when(t.rlike("licen"), "deal")
    st = F.create_map(*map(F.lit, ("en", "spec", "de", "memo", "fr", "brochure", "es", "log")))[F.col("lang")]
    d = g.documents.select("doc_id", F.coalesce(domain, F.lit("neutral")).alias("domain"), st.alias("st"))
    return d.select("doc_id", "domain", tier(F.col("st"), F.col("domain"), F.col("domain") == "neutral").alias("tier"))


@query("X6_strength_band", """
WITH t AS (SELECT o.custkey, v.source, CASE v.lang WHEN 'en' THEN 0 WHEN 'fr' THEN 3 WHEN 'de' THEN 2 ELSE 1 END AS tier, CAST(o.ts AS DATE) AS d FROM observation o JOIN evidence v USING (doc_id)),
a AS (SELECT custkey, count(DISTINCT source) AS independent, min(tier) AS top, date_diff('day', max(d), DATE '2025-01-15') AS age FROM t GROUP BY 1)
SELECT custkey, independent, CASE WHEN top >= 3 THEN 'LOW' WHEN top = 0 AND age <= 730 THEN 'HIGH' ELSE 'MEDIUM' END AS band FROM a""")
def _x6(g, today="2025-01-15"):
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in {"en": 0, "fr": 3, "de": 2, "es": 1}.items() for x in kv])[F.col("lang")], F.lit(4))
    t = g.observation.select("custkey", "doc_id", "ts").join(g.evidence.select("doc_id", "source", "lang"), "doc_id")
    a = t.groupBy("custkey").agg(F.countDistinct("source").alias("independent"), F.min(rank).alias("top"), F.datediff(F.lit(today).cast("date"), F.to_date(F.max("ts"))).alias("age"))
    return a.select("custkey", "independent", F.when(F.col("top") >= 3, "LOW").when((F.col("top") == 0) & (F.col("age") <= 730), "HIGH").otherwise("MEDIUM").alias("band"))


@query("X11_deterministic_answer", """
SELECT source, string_agg(substr(snippet, 1, 200) || ' [' || rn || ']', ' ' ORDER BY rn) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM evidence) WHERE rn <= 4 GROUP BY 1""")
def _x11(g):
    t = top_per_group(g.evidence, ["source"], [F.col("doc_id")], 4).select("source", "rn", F.concat(F.substring("snippet", 1, 200), F.lit(" ["), F.col("rn").cast("string"), F.lit("]")).alias("s"))
    return t.groupBy("source").agg(F.array_join(ordered_list("rn", "s"), " ").alias("answer"))


@query("X13_prompt_compaction", """
WITH t AS (SELECT source, doc_id, substr(snippet, 1, 200) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS m FROM evidence),
c AS (SELECT *, sum(length(s)) OVER (PARTITION BY source ORDER BY rn) AS cum FROM t WHERE rn <= 10) SELECT source, doc_id, CASE WHEN m > 10 THEN '10 of ' || m ELSE '' END AS notice FROM c WHERE cum <= 1500""")
def _x13(g):
    n = g.evidence.groupBy("source").agg(F.count("*").alias("m"))
    t = top_per_group(g.evidence.select("source", "doc_id", F.length(F.substring("snippet", 1, 200)).alias("w")), ["source"], [F.col("doc_id")], 10).join(n, "source")
    cum = F.sum("w").over(Window.partitionBy("source").orderBy("rn"))
    return t.withColumn("cum", cum).where("cum <= 1500").select("source", "doc_id", F.when(F.col("m") > 10, F.concat(F.lit("10 of "), F.col("m").cast("string"))).otherwise("").alias("notice"))


@query("Q2_entity_linker", """
WITH s AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS surface, 'Color' AS label, 1 AS p FROM part UNION SELECT DISTINCT p_name, 'Need', 0 FROM part UNION SELECT DISTINCT p_type, 'Capability', 2 FROM part),
q AS (SELECT p_partkey AS id, 'where is ' || p_name || ' used for ' || p_type AS question FROM part),
h AS (SELECT q.id, s.* FROM q JOIN s ON contains(' ' || q.question || ' ', ' ' || s.surface || ' ')), k AS (SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.id = h.id AND b.surface <> h.surface AND contains(' ' || b.surface || ' ', ' ' || h.surface || ' ')))
SELECT id, surface, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, length(surface) DESC, surface) AS rn FROM k) WHERE rn <= 4""")
def _q2(g):
    """Surfaces in a question as whole words; one inside a longer one is skipped; labels in order of priority, then longer ones first.

    Surfaces meet questions by their first two words, so the lexicon may be of any size.
    """
    lex = g.part.select(F.inline(F.array(*[F.struct(c.alias("surface"), F.lit(label).alias("label"), F.lit(p).alias("p")) for c, label, p in (
        (F.split_part("p_name", F.lit(" "), F.lit(1)), "Color", 1), (F.col("p_name"), "Need", 0), (F.col("p_type"), "Capability", 2))]))).distinct()
    lex = lex.withColumn("w", X.beginning(F.col("surface")))
    q = g.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("where is "), "p_name", F.lit(" used for "), "p_type").alias("question"))
    inside = lambda a, b: F.contains(F.concat(F.lit(" "), a, F.lit(" ")), F.concat(F.lit(" "), b, F.lit(" ")))
    met = looked_up(q.withColumn("w", F.explode(X.beginnings(F.split("question", " ")))), lex, "w").where(inside(F.col("question"), F.col("surface")))
    # a question holds few surfaces, however many there are
    h = met.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("p", (-F.length("surface")).alias("n"), "surface", "label"))).alias("h"))
    k = F.filter("h", lambda x: ~F.exists("h", lambda y: (y.surface != x.surface) & inside(y.surface, x.surface)))
    return h.select("id", F.explode(F.slice(k, 1, 4)).alias("x")).select("id", "x.surface", "x.label")


def pieces(line: Column) -> Column:
    """A line's sentences with their spaces; blank ends go."""
    return F.filter(F.split(line, r"(?<=[.!])(?=\s|$)|(?<=[。?])"), lambda s: F.trim(s) != "")


def verified(text: Column, known: Column) -> Column:
    """struct<kept, dropped, text> of an answer whose markers cite the numbers `known`: sentences that only cite what isn't there go.

    A sentence with a good marker beside a bad one stays, as does one without any; without a bad marker the text stays as it is.
    """
    markers = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda m: m.cast("int")))
    bad = F.array_except(markers, known)
    alone = lambda s: F.array_join(F.transform(F.array(s), lambda x: F.aggregate(bad, x, lambda a, m: F.replace(a, F.concat(F.lit("["), m.cast("string"), F.lit("]")), F.lit("")))), "")
    cites_bad = lambda s: F.exists(bad, lambda m: F.contains(s, F.concat(F.lit("["), m.cast("string"), F.lit("]"))))
    keep = lambda line: F.trim(F.array_join(F.filter(pieces(line), lambda s: ~(cites_bad(s) & ~F.contains(alone(s), F.lit("[")))), " "))
    stripped = F.array_join(F.filter(F.transform(F.split(text, "\n"), keep), lambda x: x != ""), "\n")
    return F.struct(F.array_intersect(markers, known).alias("kept"), bad.alias("dropped"), F.when(F.size(bad) == 0, text).otherwise(stripped).alias("text"))


_Q9_END = " [1]. Unsaid [2]. Known [3].\n2.85 won [7]! Both [2][1]? Only [7] [2]"
_Q9_PIECES = r"list_filter(string_split_regex(regexp_replace(regexp_replace(line, '([.!])(\s|$)', '\1' || chr(1) || '\2', 'g'), '([。?])', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


@query("Q9_citation_check", rf"""
WITH a AS (SELECT doc_id, snippet || replace('{_Q9_END.replace(chr(10), '~')}', '~', chr(10)) AS t FROM evidence),
m AS (SELECT *, list_distinct(list_transform(regexp_extract_all(t, '\[(\d{{1,3}})\]', 1), lambda x: CAST(x AS INT))) AS ms FROM a), b AS (SELECT *, list_filter(ms, lambda x: x NOT IN (1, 3)) AS bad FROM m),
l AS (SELECT doc_id, bad, i, string_split(t, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM b)),
k AS (SELECT doc_id, i, trim(array_to_string(list_filter({_Q9_PIECES}, lambda s: NOT (len(list_filter(bad, lambda x: contains(s, '[' || x || ']'))) > 0 AND NOT contains(list_reduce(list_prepend(s, list_transform(bad, lambda x: '[' || x || ']')), lambda c, d: replace(c, d, '')), '['))), ' ')) AS line FROM l),
j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS said FROM k WHERE line <> '' GROUP BY 1)
SELECT doc_id, len(ms) - len(bad) AS kept, len(bad) AS dropped, said AS plain FROM b LEFT JOIN j USING (doc_id)""")
def _q9(g):
    """Answers that cite two of their evidences and two that aren't there; sentences that cite only these go."""
    a = g.evidence.select("doc_id", F.explode(F.array(verified(F.concat("snippet", F.lit(_Q9_END)), F.array(F.lit(1), F.lit(3))))).alias("v"))
    return a.select("doc_id", F.size("v.kept").cast("long").alias("kept"), F.size("v.dropped").cast("long").alias("dropped"), F.col("v.text").alias("plain"))


def hard_gate(df: DataFrame) -> DataFrame:
    """`df` (doc_id, support, sentences): sentences with personal data or with a number that `support` doesn't hold are removed.

    The numbers of the whole support are read once a row: exploding the one-item array keeps Spark from
    moving that work into the step for each sentence.
    """
    held = F.regexp_extract_all(F.regexp_replace("support", ",", ""), F.lit(r"\d+(?:\.\d+)*"), F.lit(0))
    none = F.array().cast("array<string>")
    said = F.flatten(F.transform("sentences", X.numbers))
    x = df.select("doc_id", F.coalesce("sentences", none).alias("sentences"), "support")
    x = x.select("doc_id", F.explode(F.array(F.struct("sentences", F.array_except(said, F.coalesce(held, none)).alias("unsupported")))).alias("x"))
    bad = lambda t: F.arrays_overlap(X.numbers(t), F.col("x.unsupported")) | t.rlike(X.EMAIL)
    x = x.select("doc_id", F.size("x.sentences").alias("n"), F.explode(F.array(F.filter("x.sentences", lambda t: ~bad(t)))).alias("kept"))
    return x.select("doc_id", F.array_join("kept", " ").alias("answer"), (F.col("n") - F.size("kept")).cast("long").alias("removed"))


def scrubbed(df: DataFrame, marked: bool = False) -> DataFrame:
    """`df` (doc_id, support, question, sentences) with `answer` and `log`: what each removed sentence held.

    A sentence goes for personal data, for a number that the support doesn't hold as a whole, and for a name (a capitalised word or an organisation) that
    neither support nor question holds.  Only the word would go from a sentence that misleads without it, so all of it goes.  The question's own
    numbers are allowed too.  With `marked`, markers such as [3] are no numbers of a sentence.
    """
    none = F.array().cast("array<string>")
    numbers = lambda c: F.coalesce(F.regexp_extract_all(F.regexp_replace(c, ",", ""), F.lit(r"\d+(?:\.\d+)*"), F.lit(0)), none)
    both = F.concat_ws("\n", "support", "question")
    x = df.select("doc_id", F.explode(F.array(F.struct(F.coalesce("sentences", none).alias("sentences"), both.alias("hay"), F.array_distinct(F.concat(numbers("support"), numbers("question"))).alias("held")))).alias("x"))
    names = lambda t: F.array_distinct(F.concat(X.proper_nouns(t), X.organisations(t)))
    bare = lambda t: F.regexp_replace(t, r"\[\d{1,3}\]", "") if marked else t
    fault = lambda t: F.struct(
        t.alias("sentence"), F.array_sort(F.array_distinct(F.array_except(X.numbers(bare(t)), F.col("x.held")))).alias("numbers"),
        F.array_sort(F.filter(names(t), lambda n: ~F.contains(F.col("x.hay"), n))).alias("terms"), F.regexp_extract_all(t, F.lit(X.EMAIL), F.lit(0)).alias("personal"))
    x = x.select("doc_id", F.explode(F.array(F.transform("x.sentences", fault))).alias("fs"))
    clean = lambda f: (F.size(f["numbers"]) == 0) & (F.size(f["terms"]) == 0) & (F.size(f["personal"]) == 0)
    return x.select("doc_id", F.array_join(F.transform(F.filter("fs", clean), lambda f: f["sentence"]), " ").alias("answer"), F.filter("fs", lambda f: ~clean(f)).alias("log"))


@query("Q10_hard_gate", rf"""WITH d AS (SELECT doc_id, snippet || chr(10) || 'What is said in ' || source || ' of Acme?' AS hay, regexp_extract_all(replace(snippet || chr(10) || source, ',', ''), '\d+(?:\.\d+)*') AS held,
  list_concat(coalesce({X.SENTENCES_SQL.format('snippet')}, []), ['Case ' || doc_id || ' is closed.', 'Then Acme and Zorbex met 새솔은행.', 'Nothing else was said.', 'and nothing else.']) AS said FROM evidence),
f AS (SELECT doc_id, i, said[i] AS t, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(said[i], '\d[\d,]*(?:\.\d+)*'), lambda x: replace(x, ',', '')), lambda x: NOT list_contains(held, x)))) AS ns,
  list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(said[i], '{X.PROPER}'), regexp_extract_all(said[i], '{X.ORG}')), lambda n: NOT contains(hay, n)))) AS ts, len(regexp_extract_all(said[i], '{X.EMAIL}')) AS ps FROM (SELECT *, unnest(range(1, len(said) + 1)) AS i FROM d))
SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY i) FILTER (len(ns) + len(ts) + ps = 0), '') AS answer, count(*) FILTER (len(ns) + len(ts) + ps > 0) AS removed,
  string_agg(array_to_string(ns, ',') || ':' || array_to_string(ts, ',') || ':' || ps, '|' ORDER BY i) FILTER (len(ns) + len(ts) + ps > 0) AS log FROM f GROUP BY 1""")
def _q10(g):
    """Answers are a document's sentences and four more: with its id, with a name of the question and two of nobody, and two without either."""
    more = [F.concat(F.lit("Case "), F.col("doc_id").cast("string"), F.lit(" is closed.")), *map(F.lit, ("Then Acme and Zorbex met 새솔은행.", "Nothing else was said.", "and nothing else."))]
    said = F.concat(F.coalesce(X.sentences(F.col("snippet")), F.array().cast("array<string>")), F.array(*more))
    out = scrubbed(g.evidence.select("doc_id", F.col("snippet").alias("support"), F.concat(F.lit("What is said in "), "source", F.lit(" of Acme?")).alias("question"), said.alias("sentences")))
    line = F.transform("log", lambda r: F.concat_ws(":", F.array_join(r["numbers"], ","), F.array_join(r["terms"], ","), F.size(r["personal"]).cast("string")))
    return out.select("doc_id", "answer", F.size("log").cast("long").alias("removed"), F.array_join(line, "|").alias("log"))


_LONGEST_SQL = r"(SELECT max_by(w, (length(w), w)) FROM (SELECT unnest(regexp_split_to_array(lower(b.text), '[^\p{L}\p{N}]+')) AS w))"


@query("Q14_unknowns", f"""WITH f AS (SELECT b.item_id, count(d.doc_id) AS found FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1), l AS (SELECT b.item_id, {_LONGEST_SQL} AS term FROM benchmark b),
t AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents)
SELECT item_id, CASE WHEN found = 0 THEN 'no evidence' WHEN t.term IS NULL THEN 'term unseen' ELSE 'evidence' END AS state FROM f JOIN l USING (item_id) LEFT JOIN t USING (term)""")
def _q14(g):
    """Questions without evidence, and those whose longest word no text holds."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    longest = F.element_at(F.array_sort(F.transform(words(F.col("text")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    l = g.benchmark.select("item_id", longest.alias("term"))  # noqa: E741
    few = [r.term for r in l.select("term").distinct().limit(KEYS_IN_PLAN + 1).collect()]  # a small set goes to the words, else they are joined
    ws = F.array_distinct(words(F.col("text")))
    rows = g.documents.select(F.explode(F.filter(ws, lambda w: w.isin(*few)) if len(few) <= KEYS_IN_PLAN else ws).alias("term"))
    seen = rows.join(l, "term", "left_semi").distinct().withColumn("seen", F.lit(True))
    hit = holding(g.documents, g.benchmark).select("item_id").distinct().withColumn("hit", F.lit(True))
    x = l.join(hit, "item_id", "left").join(seen, "term", "left")
    return x.select("item_id", F.when(F.col("hit").isNull(), "no evidence").when(F.col("seen").isNull(), "term unseen").otherwise("evidence").alias("state"))


@query("M2_evidence_match", r"""WITH e AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents), b AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q FROM benchmark)
SELECT b.item_id, count(e.doc_id) AS in_excerpts, count(e.doc_id) >= 1 AS enough FROM b LEFT JOIN e ON contains(e.t, b.q) GROUP BY 1""")
def _m2(g, least=1):
    """Quotes found in excerpts, without regard to case and runs of white space, and whether they are found often enough."""
    n = holding(g.documents, g.benchmark, squeezed=True).groupBy("item_id").agg(F.count("*").alias("in_excerpts"))
    count = F.coalesce("in_excerpts", F.lit(0))
    return g.benchmark.select("item_id").join(n, "item_id", "left").select("item_id", count.alias("in_excerpts"), (count >= least).alias("enough"))


@query("M4_masking_check", r"SELECT lang, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS failing, count(*) AS n FROM documents GROUP BY 1")
def _m4(g):
    return g.documents.groupBy("lang").agg(F.count_if(F.col("text").rlike(X.EMAIL)).alias("failing"), F.count("*").alias("n"))


def subgraph_faults(nodes: DataFrame, edges: DataFrame, cited: DataFrame, most_nodes: int = 50, most_edges: int = 100) -> DataFrame:
    """(graph, fault, n) of pictures: `nodes` (graph, key, rank), `edges` (graph, from_key, to_key), `cited` (graph, key).

    no focal node; too many nodes or edges; an edge with an end that isn't there; a cited key that has no node.
    """
    size = lambda df, most, what: df.groupBy("graph").agg((F.count("*") - most).alias("n")).where("n > 0").select("graph", F.lit(what).alias("fault"), "n")
    lost = lambda df, key, what: df.select("graph", F.col(key).alias("key")).distinct().join(nodes.select("graph", "key"), ["graph", "key"], "left_anti").groupBy("graph").agg(F.count("*").alias("n")).select("graph", F.lit(what).alias("fault"), "n")
    focal = nodes.groupBy("graph").agg(F.count_if(F.col("rank") == "focal").alias("f")).where("f = 0").select("graph", F.lit("no focal").alias("fault"), F.lit(1).cast("long").alias("n"))
    ends = edges.select("graph", F.col("from_key").alias("key")).unionByName(edges.select("graph", F.col("to_key").alias("key")))
    return focal.unionByName(size(nodes, most_nodes, "nodes")).unionByName(size(edges, most_edges, "edges")).unionByName(lost(ends, "key", "dangling")).unionByName(lost(cited, "key", "marker"))


@query("M7_subgraph_checks", """
WITH a AS (SELECT domain AS graph, account AS key, row_number() OVER (PARTITION BY domain ORDER BY account) AS rn, nationkey FROM account JOIN domain USING (nationkey)), n AS (SELECT graph, count(*) AS n, any_value(nationkey) AS nk FROM a GROUP BY 1)
SELECT graph, 'no focal' AS fault, 1 AS n FROM n WHERE nk % 5 = 0 UNION ALL SELECT graph, 'nodes', least(n, 55) + 1 - 50 FROM n WHERE least(n, 55) + 1 > 50 UNION ALL SELECT graph, 'edges', n - 100 FROM n WHERE n > 100
UNION ALL SELECT graph, 'dangling', n - 55 FROM n WHERE n > 55 UNION ALL SELECT graph, 'marker', count(*) FROM a WHERE rn > 55 AND key LIKE '%7' GROUP BY 1""")
def _m7(g):
    """A picture for each domain: its first 55 accounts as nodes, edges to all of them, and all accounts that end in 7 cited; every fifth has no focal node."""
    a = g.account.join(g.domain, "nationkey").select(F.col("domain").alias("graph"), F.col("account").alias("key"), "nationkey")
    head = g.domain.join(g.account.select("nationkey").distinct(), "nationkey").select(F.col("domain").alias("graph"), F.col("domain").alias("key"), F.when(F.col("nationkey") % 5 == 0, "cited").otherwise("focal").alias("rank"))
    nodes = head.unionByName(top_per_group(a, ["graph"], [F.col("key")], 55).select("graph", "key", F.lit("supporting").alias("rank")))
    return subgraph_faults(nodes, a.select("graph", F.col("graph").alias("from_key"), F.col("key").alias("to_key")), a.where(F.endswith("key", F.lit("7"))).select("graph", "key"))


@query("M8_conflict_sides", "SELECT custkey, count(DISTINCT status) >= 2 AS both_sides FROM claim GROUP BY 1")
def _m8(g):
    return g.claim.groupBy("custkey").agg((F.countDistinct("status") >= 2).alias("both_sides"))


@query("M9_check_summary", "SELECT 'masking' AS check_name, count(*) FILTER (NOT regexp_matches(text, '@')) AS passed, count(*) AS n FROM documents UNION ALL SELECT 'length', count(*) FILTER (n_chars = length(text)), count(*) FROM documents")
def _m9(g):
    d = g.documents.select(F.inline(F.array(F.struct(F.lit("masking").alias("check_name"), (~F.col("text").rlike("@")).alias("ok")), F.struct(F.lit("length").alias("check_name"), (F.col("n_chars") == F.length("text")).alias("ok")))))
    return d.groupBy("check_name").agg(F.count_if("ok").alias("passed"), F.count("*").alias("n"))


@query("H6_status_words", "SELECT conv_id, turn, len(list_filter(['the', 'and', 'of'], lambda w: contains(lower(text), w))) AS n FROM conversations")
def _h6(g):
    return g.conversations.select("conv_id", "turn", F.size(F.filter(F.array(*map(F.lit, ("the", "and", "of"))), lambda w: F.contains(F.lower("text"), w))).cast("long").alias("n"))


@query("H13_best_tier", "SELECT source, min(CASE lang WHEN 'en' THEN 'T1' WHEN 'es' THEN 'T2' WHEN 'de' THEN 'T3' ELSE 'T4' END) AS tier FROM evidence GROUP BY 1")
def _h13(g):
    t = F.coalesce(F.create_map(*map(F.lit, ("en", "T1", "es", "T2", "de", "T3")))[F.col("lang")], F.lit("T4"))
    return g.evidence.groupBy("source").agg(F.min(t).alias("tier"))


@query("H16_content_hash", "SELECT doc_id, sha256(text) AS content_hash, length(text) = n_chars AS ok FROM documents")
def _h16(g):
    return g.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), (F.length("text") == F.col("n_chars")).alias("ok"))


@query("H26_recent_questions", "SELECT user_id, event_type, last_at FROM (SELECT user_id, event_type, CAST(max(ts) AS VARCHAR)[:19] AS last_at, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-23' GROUP BY 1, 2) WHERE rn <= 3")
def _h26(g, since="2024-01-23", cap=3):
    e = g.events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).groupBy("user_id", "event_type").agg(F.max("ts").alias("t"))
    return top_per_group(e, ["user_id"], [F.desc("t"), F.col("event_type")], cap).select("user_id", "event_type", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("last_at"))
