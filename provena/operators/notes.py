"""Structured notes, notation, schema guards and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from provena.functions import text as X
from provena.operators.common import looked_up, top_per_group
from provena.registry import query
from provena.session import run_folder, stored
from provena.sources import snapshots

#: Fields that an extraction may never carry.
FORBIDDEN = ("status", "edges", "cypher", "lane")


def meeting_note(c: Column) -> Column:
    """struct<title, day, attendees, actions> of a note's text; null without a date or an `Attendees` line."""
    day = F.regexp_extract(c, r"(?m)^Date:\s*(\d{4}-\d{2}-\d{2})", 1)
    who = F.regexp_extract(c, r"(?m)^Attendees:\s*(.+)$", 1)
    people = F.filter(F.transform(F.split(who, ","), lambda x: F.trim(x)), lambda x: x != "")
    bullets = F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^\s*[-*]\s+(.+)$"), F.lit(1)), lambda x: F.trim(x))
    note = F.struct(F.regexp_extract(c, r"(?m)^#\s*(.+)$", 1).alias("title"), F.nullif(day, F.lit("")).alias("day"), people.alias("attendees"), bullets.alias("actions"))
    return F.when((day != "") | (who != ""), note)


@query("S18_meeting_notes", "SELECT o_orderkey AS id, 'Deal ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS day, 2 AS attendees, 'call ' || o_orderpriority AS action FROM orders WHERE o_orderstatus <> 'P'")
def _s18(g):
    body = F.concat(F.lit("# Deal "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("\nDate: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nAttendees: a, b"))).otherwise(""), F.lit("\n\nText.\n  - call "), F.col("o_orderpriority"))
    n = g.orders.select(F.col("o_orderkey").alias("id"), meeting_note(body).alias("n")).where("n IS NOT NULL")
    return n.select("id", "n.title", "n.day", F.size("n.attendees").alias("attendees"), F.col("n.actions")[0].alias("action"))


def restore_dates(c: Column, support: Column) -> Column:
    """A date in words goes back to its ISO form where the support has that form."""
    rx = r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"
    part = lambda i: F.regexp_extract(c, rx, i)
    iso = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(F.contains(support, iso) & (part(1) != ""), F.replace(c, F.regexp_extract(c, rx, 0), iso)).otherwise(c)


@query("F16_notation_restore", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'on ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'on ' || year(o_orderdate) || '년 ' || month(o_orderdate) || '월 ' || day(o_orderdate) || '일' END AS said FROM orders")
def _f16(g):
    d = F.col("o_orderdate")
    said = F.concat(F.lit("on "), F.year(d).cast("string"), F.lit("년 "), F.month(d).cast("string"), F.lit("월 "), F.dayofmonth(d).cast("string"), F.lit("일"))
    support = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise("")
    o = g.orders.select(F.col("o_orderkey").alias("id"), said.alias("said"), support.alias("support"))
    return o.select("id", restore_dates(F.col("said"), F.col("support")).alias("said"))


@query("H3_source_metadata", "SELECT source, sensitivity, doc_status FROM source")
def _h3(g):
    return g.source.select("source", "sensitivity", "doc_status")


_EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("H10_guard_log", f"""WITH s AS (SELECT doc_id, source, lang, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS s FROM (SELECT doc_id, source, lang, {X.SENTENCES_SQL.format('text')} AS x FROM documents)),
r AS (SELECT source, lang, doc_id, pos, regexp_replace(s, '{_EMAIL_SQL}', '***', 'g') AS entry, count(*) OVER (PARTITION BY source, lang) AS removed, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id, pos) AS rn FROM s WHERE regexp_matches(s, '{_EMAIL_SQL}'))
SELECT source, lang, removed, rn, doc_id, entry FROM r WHERE rn <= 12""")
def _h10(g, most=12):
    """Sentences that the gate removes: how many for each source and language, and the first of them, redacted."""
    s = g.documents.where(F.col("text").rlike(X.EMAIL)).select("doc_id", "source", "lang", F.posexplode(X.sentences(F.col("text"))).alias("pos", "s")).where(F.col("s").rlike(X.EMAIL))
    n = s.groupBy("source", "lang").agg(F.count("*").alias("removed"))
    top = top_per_group(s.withColumn("entry", F.regexp_replace("s", X.EMAIL, "***")), ["source", "lang"], [F.col("doc_id"), F.col("pos")], most)
    return top.join(n, ["source", "lang"]).select("source", "lang", "removed", "rn", "doc_id", "entry")


def version_claims(texts: DataFrame, features: DataFrame) -> DataFrame:
    """(id, name, said, introduced_in): sentences of `texts` (id, text) that give a feature another version than `features` (name, introduced_in).

    A sentence counts where it holds one version, `v` with a number; it meets features by the first two words of their names.
    """
    s = texts.select("id", F.explode(X.sentences(F.col("text"))).alias("s"))
    s = s.withColumn("vs", F.array_distinct(F.regexp_extract_all("s", F.lit(r"\bv\d+\b"), F.lit(0)))).where("size(vs) = 1")
    f = features.withColumn("w", X.beginning(F.col("name")))
    met = looked_up(s.withColumn("w", F.explode(X.beginnings(F.split("s", r"[^\w]+")))), f, "w")
    whole = F.contains(F.concat(F.lit(" "), F.regexp_replace("s", r"[^\w]+", " "), F.lit(" ")), F.concat(F.lit(" "), "name", F.lit(" ")))
    return met.where(whole & (F.col("vs")[0] != F.col("introduced_in"))).select("id", "name", F.col("vs")[0].alias("said"), "introduced_in").distinct()


@query("H18_version_misattribution", """WITH f AS (SELECT name, min(introduced_in) AS introduced_in FROM feature GROUP BY 1), t AS (SELECT feature_id AS id, name, 'v' || (1 + feature_id % 4) AS said FROM feature WHERE feature_id % 5 <> 0)
SELECT t.id, t.name, t.said, f.introduced_in FROM t JOIN f USING (name) WHERE t.said <> f.introduced_in""")
def _h18(g):
    """Prose says of each feature when it came; sentences with two versions aren't judged."""
    v = F.concat(F.lit("v"), (1 + F.col("feature_id") % 4).cast("string"))
    prose = F.concat(F.lit("No version is said here. We added "), "name", F.lit(" in "), v, F.when(F.col("feature_id") % 5 == 0, " or v9").otherwise(""), F.lit(". It works!"))
    f = g.feature.groupBy("name").agg(F.min("introduced_in").alias("introduced_in"))
    return version_claims(g.feature.select(F.col("feature_id").alias("id"), prose.alias("text")), f)


@query("H2_side_scope", "SELECT need FROM (SELECT DISTINCT need FROM has_need WHERE contains(lower(need), 'gear')) ORDER BY need LIMIT 10")
def _h2(g, term="gear", limit=10):
    return g.has_need.where(F.contains(F.lower("need"), F.lit(term))).select("need").distinct().orderBy("need").limit(limit)


def forbidden(df: DataFrame) -> list[str]:
    """Columns of a candidate table that an extraction must not have."""
    return sorted(set(df.columns) & set(FORBIDDEN))


def append_log(df: DataFrame, path: str) -> None:
    """Append audit or ledger rows; earlier ones are never touched."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


class Reader:
    """What query code may hold: tables to read, and no way to write."""

    def __init__(self, tables: dict[str, DataFrame]):
        self._tables = dict(tables)

    def table(self, name: str) -> DataFrame:
        return self._tables[name]


class Writer(Reader):
    """A reader that may also replace a table's files."""

    def replace(self, name: str, path: str) -> None:
        self._tables[name].write.mode("overwrite").parquet(path)


def reading(handle: Reader) -> Reader:
    """What query code is given: a handle that can write is refused, however it came there."""
    if not isinstance(handle, Reader) or isinstance(handle, Writer):
        raise TypeError("query code takes a reader, not a handle that can write")
    return handle


@query("S25_read_only_tables", "SELECT 'reader' AS handle, true AS accepted, count(*) AS n FROM account UNION ALL SELECT 'writer', false, 0 UNION ALL SELECT 'table', false, 0")
def _s25(g):
    """Which handles query code accepts, and what it reads through them."""
    out = None
    for name, handle in (("reader", Reader({"account": g.account})), ("writer", Writer({"account": g.account})), ("table", g.account)):
        try:
            n, ok = reading(handle).table("account").agg(F.count("*").alias("n")), True
        except TypeError:
            n, ok = g.spark.range(1).select(F.lit(0).cast("long").alias("n")), False
        row = n.select(F.lit(name).alias("handle"), F.lit(ok).alias("accepted"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def through_cache(asked: DataFrame, cache: str, answer: Column, run_id: str) -> DataFrame:
    """`asked` (key, ...) with `answer` and `cached`: what the cache, a keyed snapshot, holds isn't worked out again; the rest goes into it.

    The cache is replaced whole, so a reader sees it before or after, never half written.
    """
    spark = asked.sparkSession
    if snapshots.manifest(spark, cache) is None:
        known = spark.createDataFrame([], "key string, said string")
    else:
        known = snapshots.read(spark, cache).select("key", F.col("answer").alias("said"))
    x = stored(asked.join(known, "key", "left").withColumn("cached", F.col("said").isNotNull()).withColumn("answer", F.coalesce("said", answer)).drop("said"))
    snapshots.merge(x.where("NOT cached").select("key", "answer"), cache, ["key"], run_id)
    return x


@query("S26_log_and_cache", "WITH e AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS batch, CAST(ts AS DATE) || event_type AS said FROM events WHERE event_id % 2 = 0), f AS (SELECT DISTINCT said FROM e WHERE batch = 1) SELECT event_type, count(*) AS logged, count(*) FILTER (batch = 2 AND said IN (SELECT said FROM f)) AS from_cache, count(*) FILTER (batch = 2 AND said IN (SELECT said FROM f)) AS worked_out_first FROM e GROUP BY 1")
def _s26(g):
    """Two batches of questions are answered and logged; the second takes what the first worked out from the cache, which its answers show."""
    tag = uuid.uuid4().hex[:12]
    path, cache = f"{run_folder(g.spark)}/log-{tag}", f"{run_folder(g.spark)}/cache-{tag}"
    asked = g.events.where("event_id % 2 = 0").select("event_id", "event_type", F.sha2(F.concat(F.to_date("ts").cast("string"), "event_type").cast("binary"), 256).alias("key"))
    for run, batch in (("first", asked.where("event_id % 4 = 0")), ("second", asked.where("event_id % 4 <> 0"))):
        done = through_cache(batch, cache, F.concat(F.lit(f"{run}: "), F.upper("event_type")), run)
        append_log(done.select("event_id", "event_type", "answer", "cached"), path)
    log = g.spark.read.schema("event_id long, event_type string, answer string, cached boolean").json(path)
    return log.groupBy("event_type").agg(F.count("*").alias("logged"), F.count_if("cached").alias("from_cache"), F.count_if(F.col("cached") & F.startswith("answer", F.lit("first: "))).alias("worked_out_first"))


def candidate_faults(c: Column, required: tuple[str, ...]) -> Column:
    """What keeps a candidate (JSON) out: fields that an extraction may never carry, and required ones that are missing."""
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    lit = lambda xs: F.array(*map(F.lit, xs))
    return F.concat(F.transform(F.array_intersect(lit(FORBIDDEN), keys), lambda k: F.concat(F.lit("forbidden "), k)), F.transform(F.array_except(lit(required), keys), lambda k: F.concat(F.lit("missing "), k)))


@query("X9_extraction_schema", "SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'forbidden status' END, CASE WHEN p_partkey % 7 = 0 THEN 'forbidden edges' END, CASE WHEN p_partkey % 11 = 0 THEN 'missing quote' END) AS faults FROM part")
def _x9(g):
    key = F.col("p_partkey")
    record = F.to_json(F.struct(F.col("p_name").alias("name"), F.when(key % 11 != 0, F.col("p_brand")).alias("quote"), F.when(key % 5 == 0, "VERIFIED").alias("status"), F.when(key % 7 == 0, F.array(F.lit("x"))).alias("edges")))
    return g.part.select(key.alias("id"), F.array_join(candidate_faults(record, ("name", "quote")), ",").alias("faults"))


def brief(sentences: Column, refs: Column, limit: int) -> Column:
    """The text of a brief: a sentence whose numbers no marker backs gets the marker of the first cited excerpt that
    holds them all; markers of no citation go; `limit` sentences stay.  refs: array<struct<marker, snippet>>.
    """
    numbers = lambda s: X.numbers(F.regexp_replace(s, r"\[\d{1,3}\]", ""))
    backs = lambda s: F.filter(refs, lambda r: F.size(F.array_except(numbers(s), X.numbers(r.snippet))) == 0)
    mark = lambda s: F.regexp_replace(s, r"(?s)^(.*?)([.!?]?)$", F.concat(F.lit("$1 ["), F.get(backs(s), F.lit(0))["marker"].cast("string"), F.lit("]$2")))
    bare = lambda s: ~s.rlike(r"\[\d{1,3}\]") & (F.size(numbers(s)) > 0) & (F.size(backs(s)) > 0)
    known = F.transform(refs, lambda r: F.concat(F.lit("["), r.marker.cast("string"), F.lit("]")))
    odd = lambda s: F.array_except(F.regexp_extract_all(s, F.lit(r"\[\d{1,3}\]"), F.lit(0)), known)
    valid = lambda s: F.aggregate(odd(s), s, lambda a, m: F.replace(a, m, F.lit("")))
    tidy = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"[ \t]{2,}", " "), r"\s+([.,!?)\]}])", "$1"))
    out = F.transform(sentences, lambda s: tidy(valid(F.when(bare(s), mark(s)).otherwise(s))))
    return F.array_join(F.slice(out, 1, limit), " ")


@query("H19_brief_support", """SELECT p_partkey AS id, 'Size is ' || p_size || CASE WHEN p_size > 9 THEN ' [2].' ELSE '.' END || ' Made well.' || ' Seen.' AS text FROM part""")
def _h19(g, limit=3):
    """A brief of four sentences: one number to anchor, one marker that no citation has, one sentence too many."""
    size = F.col("p_size").cast("string")
    said = F.array(F.concat(F.lit("Size is "), size, F.lit(".")), F.lit("Made well [9]."), F.lit("Seen."), F.lit("Too long."))
    refs = F.array(F.struct(F.lit(1).alias("marker"), F.lit("no number").alias("snippet")), F.struct(F.lit(2).alias("marker"), F.when(F.col("p_size") > 9, F.concat(F.lit("size "), size)).otherwise("small").alias("snippet")))
    b = g.part.select(F.col("p_partkey").alias("id"), said.alias("said"), refs.alias("refs"))
    return b.select("id", brief(F.col("said"), F.col("refs"), limit).alias("text"))
