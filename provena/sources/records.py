"""Sources and sinks: parsed-record snapshots, HTML pages, Markdown, chat dumps, and keyed rewrites."""

from __future__ import annotations

import re
import uuid
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from provena.operators.quotes import holding
from provena.registry import query
from provena.session import run_folder
from provena.sources import snapshots
from provena.sources.pages import heading_units, visible

EVIDENCE = "evidence_id string, source_id string, locator string, excerpt string, unit string, authored_at string, raw_len int, structured map<string,string>"


def snapshot(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """Evidence lines of a snapshot folder with their file; blank lines and unreadable ones are left out."""
    df = spark.read.schema(EVIDENCE + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(f"{path}/*.jsonl")
    df = df.select("*", F.col("_metadata.file_name").alias("file")).where("evidence_id IS NOT NULL").drop("_corrupt")
    return df.where(F.col("source_id").isin(*only)) if only else df


def write_keyed(df: DataFrame, path: str, key: list[str], partition: str | None = None) -> None:
    """Rewrite a keyed table: the last row of a key by `updated_at` stays; readers see whole snapshots."""
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last("updated_at"))
    out = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").write.mode("overwrite")
    (out.partitionBy(partition) if partition else out).parquet(path)


class _Text(HTMLParser):
    """Visible text by heading path."""

    def __init__(self):
        super().__init__()
        self.units: list[tuple[str, list[str]]] = [("", [])]
        self.path: list[str] = []
        self.skip, self.level, self.head = 0, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.level, self.head = int(tag[1]), []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif self.level and tag == f"h{self.level}":
            title = " ".join(" ".join(self.head).split())
            self.path = [*self.path[: self.level - 1], title]
            self.units.append((" > ".join(p for p in self.path if p), []))
            self.level = 0

    def handle_data(self, data):
        if not self.skip:
            (self.head if self.level else self.units[-1][1]).append(data)


#: An unescaped reading is taken where it has so many times the text, and the headings of documents of questions and answers.
UNESCAPE_GAIN = 1.5
SECTION = re.compile("^[\U0001f300-\U0001faff☀-➿]️?\\s*(?:★\\s*)?(INTRO|MAIN|APPENDIX|REVIEW)\\b")
ITEM, NUMBER = re.compile(r"^(Q\d+)$"), re.compile(r"^(0[1-9])$")


def _read(html: str) -> _Text:
    p = _Text()
    p.feed(html)
    p.close()
    return p


def _length(p: _Text) -> int:
    return sum(len(line.strip()) for _, texts in p.units for t in texts for line in t.splitlines())


def question_units(lines: list[str]) -> list[dict]:
    """Units by the document's own labels, SECTION or SECTION/ITEM; what carries one label is put together, first seen first."""
    found: dict[str, list[str]] = {}
    section, item = None, None
    for line in lines:
        if m := SECTION.match(line):
            section, item = m[1], None
        elif section and (m := ITEM.match(line) or (NUMBER.match(line) if section == "INTRO" else None)):
            item = m[1]
        found.setdefault("COVER" if section is None else f"{section}/{item}" if item else section, []).append(line)
    return [{"path": k, "text": "\n".join(v)} for k, v in found.items()]


def html_units(html: str | None) -> list[dict]:
    """Units by heading path; where the page holds its text as escaped markup, units by its own labels."""
    raw = html or ""
    p = _read(raw)
    if "\\u003c" in raw or "&lt;" in raw:
        q = _read(unescape(raw.replace("\\u003c", "<").replace("\\u003e", ">").replace('\\"', '"')))
        if _length(q) > UNESCAPE_GAIN * _length(p):
            return question_units([x for _, texts in q.units for t in texts for line in t.splitlines() if (x := line.strip())])
    return [{"path": k, "text": t} for k, v in p.units if (t := " ".join(" ".join(v).split()))]


@F.pandas_udf(T.ArrayType(T.StructType().add("path", T.StringType()).add("text", T.StringType())))
def _units(s: pd.Series) -> pd.Series:
    return s.map(lambda h: None if h is None else html_units(h))


@query("S14_html_units", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)\b.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
u AS (SELECT page_id, unnest(string_split_regex(h, '<h[1-6][^>]*>')) AS piece, generate_subscripts(string_split_regex(h, '<h[1-6][^>]*>'), 1) AS i FROM p)
SELECT page_id, count(*) FILTER (trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(piece, '(?s)^.*?</h[1-6]>', ''), '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '\s+', ' ', 'g')) <> '') AS units FROM u GROUP BY 1""")
def _s14(g):
    """How many units a page has."""
    n = html_pages(g).groupBy("page_id").agg(F.count("*").alias("units"))
    return g.pages.select("page_id").join(n, "page_id", "left").select("page_id", F.coalesce("units", F.lit(0)).alias("units"))


def html_pages(g):
    """Units of text by heading path; repeated paths get a number.  Only pages that hold escaped markup are read by a parser in Python."""
    page = F.coalesce("html", F.lit(""))
    p = g.pages.select("page_id", F.when(F.contains(page, F.lit("\\u003c")) | F.contains(page, F.lit("&lt;")), page).alias("hidden"), visible(page).alias("page"))
    u = p.select("page_id", F.posexplode(F.coalesce(_units("hidden"), heading_units(F.col("page")))).alias("pos", "u")).select("page_id", "pos", "u.path", "u.text")
    n = F.row_number().over(Window.partitionBy("page_id", "path").orderBy("pos"))
    return u.withColumn("n", n).select("page_id", "pos", F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat("path", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).alias("locator"), "text")


def markdown_units(lines: DataFrame) -> DataFrame:
    """Sections of Markdown lines (doc, no, line): fences hide headings, text before the first heading is dropped."""
    w = Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.sum(F.col("line").rlike("^\\s*(```|~~~)").cast("int")).over(w) % 2
    x = lines.withColumn("fenced", (fence == 1) | F.col("line").rlike("^\\s*(```|~~~)"))
    x = x.withColumn("head", ~F.col("fenced") & F.col("line").rlike("^#{1,6}\\s"))
    x = x.withColumn("section", F.sum(F.col("head").cast("int")).over(w)).where("section > 0")
    return x.groupBy("doc", "section").agg(
        F.max(F.when(F.col("head"), F.regexp_replace("line", r"^#+\s*", ""))).alias("title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("no", "line")))), lambda v: v.line), "\n").alias("text"))


# An anchor line and a fence of AsciiDoc.
ANCHOR, FENCE = r"^\[#([A-Za-z0-9_\-.]+)\]$", r"^-{4,}\s*$"


def asciidoc_units(lines: DataFrame) -> DataFrame:
    """(doc, section, level, title, anchor, path, text) of AsciiDoc lines (doc, no, line).

    `=` to `=====` open sections; an anchor line names the section that follows; blocks between `----` hide
    both.  Text before the first heading is section 0, the preamble, where it isn't blank.
    """
    upto = Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(FENCE)
    x = lines.withColumn("block", (F.sum(fence.cast("int")).over(upto) % 2 == 1) | fence)
    x = x.withColumn("level", F.when(~F.col("block") & F.col("line").rlike("^={1,5}\\s+\\S"), F.length(F.regexp_extract("line", "^=+", 0))))
    x = x.withColumn("anchor", F.when(~F.col("block"), F.nullif(F.regexp_extract(F.trim("line"), ANCHOR, 1), F.lit(""))))
    x = x.withColumn("section", F.count("level").over(upto))
    x = x.withColumn("named", F.last("anchor", True).over(Window.partitionBy("doc", "section").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    said = F.sort_array(F.collect_list(F.when(F.col("level").isNull() & ~((F.col("section") == 0) & F.col("anchor").isNotNull()), F.struct("no", "line"))))
    u = x.groupBy("doc", "section").agg(
        F.max("level").alias("level"), F.max(F.when(F.col("level").isNotNull(), F.trim(F.regexp_replace("line", "^=+\\s+", "")))).alias("title"), F.max("named").alias("named"),
        F.array_join(F.transform(said, lambda v: v.line), "\n").alias("text"))
    order = Window.partitionBy("doc").orderBy("section")
    u = u.withColumn("anchor", F.lag("named").over(order))
    above = order.rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for k in range(1, 6):  # the last title of a level counts until a heading above it
        title = F.last(F.when(F.col("level") == k, F.struct("section", "title")), True).over(above)
        higher = F.last(F.when(F.col("level") < k, F.col("section")), True).over(above)
        parts.append(F.when((F.col("level") >= k) & (title["section"] > F.coalesce(higher, F.lit(0))), title["title"]))
    u = u.withColumn("path", F.when(F.col("section") == 0, "(preamble)").otherwise(F.concat_ws(" > ", *parts)))
    return u.where((F.col("section") > 0) | F.col("text").rlike(r"\S")).select("doc", "section", "level", "title", "anchor", "path", "text")


#: Fixed value: how a route is declared in TypeScript.
ROUTE = r"(?s)([A-Za-z_]\w*)\s*:\s*defineRoute(?:<.*?>)?\(\s*'([^']+)'"


def route_symbols(files: DataFrame) -> DataFrame:
    """(doc, key, path) of the routes that TypeScript files (doc, text) define."""
    pick = lambda i: F.regexp_extract_all("text", F.lit(ROUTE), F.lit(i))
    return files.select("doc", F.inline(F.arrays_zip(pick(1).alias("key"), pick(2).alias("path"))))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("doc", F.posexplode(F.split("text", "\n")).alias("no", "line"))


#: What reads the texts (doc, text) of a format into units (doc, locator, text).
READERS = {
    "md": lambda t: markdown_units(_lines(t)).select("doc", F.col("title").alias("locator"), "text"),
    "adoc": lambda t: asciidoc_units(_lines(t)).select("doc", F.col("path").alias("locator"), "text"),
    "ts": lambda t: route_symbols(t).select("doc", F.col("key").alias("locator"), F.col("path").alias("text")),
    "transcript": lambda t: page_units(t).select("doc", F.concat(F.lit("PAGE "), F.col("page").cast("string")).alias("locator"), "text"),
    "txt": lambda t: t.select("doc", F.lit("all").alias("locator"), "text"),
}


def parse(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units (doc, format, locator, text) of texts (doc, format, text), and notes (doc, note) on formats without a reader."""
    units = None
    for form, read in READERS.items():
        u = read(texts.where(F.col("format") == form).select("doc", "text")).select("doc", F.lit(form).alias("format"), "locator", "text")
        units = u if units is None else units.unionByName(u)
    odd = texts.where(~F.coalesce("format", F.lit("")).isin(*READERS))
    return units, odd.select("doc", F.concat(F.lit("no reader for "), F.coalesce("format", F.lit("no format"))).alias("note"))


def write_snapshot(sources: DataFrame, evidence: DataFrame, path: str) -> None:
    """Sources and their evidence lines, one folder of JSON lines a source; evidence without an id or text is refused."""
    bad = evidence.where("evidence_id IS NULL OR excerpt IS NULL OR length(excerpt) > 500").limit(1).collect()
    if bad:
        raise ValueError(f"not a record of evidence: {bad[0]}")
    sources.write.mode("overwrite").json(f"{path}/sources")
    evidence.write.mode("overwrite").partitionBy("source_id").json(f"{path}/evidence")


def read_snapshot(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """(source_id, record_kind, n, note): each registered source with its evidence by kind; one without any gets a note."""
    s = spark.read.schema("source_id string, format string").json(f"{path}/sources")
    e = spark.read.schema("source_id string, evidence_id string, structured struct<record_kind: string>").json(f"{path}/evidence")
    s, e = (x.where(F.col("source_id").isin(*only)) if only else x for x in (s, e))
    n = e.where("evidence_id IS NOT NULL").groupBy("source_id", F.coalesce("structured.record_kind", F.lit("none")).alias("record_kind")).agg(F.count("*").alias("n"))
    return s.join(n, "source_id", "left").select("source_id", "record_kind", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "no evidence file").alias("note"))


_PARSED_SQL = """
SELECT p_partkey AS doc, 'md' AS format, p_name AS locator, p_brand AS text FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT p_partkey, 'adoc', '(preamble)', ':home: /app' FROM part WHERE p_partkey % 6 = 1
UNION ALL SELECT p_partkey, 'adoc', p_name, '[#' || p_type || ']' FROM part WHERE p_partkey % 6 = 1
UNION ALL SELECT p_partkey, 'adoc', p_name || ' > ' || p_type, p_brand || chr(10) || '----' || chr(10) || '== no heading' || chr(10) || '----' FROM part WHERE p_partkey % 6 = 1
UNION ALL SELECT p_partkey, 'ts', x.k, '/' || p_type || x.t FROM part, (VALUES ('home', ''), ('detail', '/:id')) AS x(k, t) WHERE p_partkey % 6 = 2
UNION ALL SELECT p_partkey, 'transcript', 'PAGE ' || x.n, CASE x.n WHEN 1 THEN p_name ELSE p_brand END FROM part, (VALUES (1), (12)) AS x(n) WHERE p_partkey % 6 = 3
UNION ALL SELECT p_partkey, 'txt', 'all', p_name FROM part WHERE p_partkey % 6 = 4"""


def _files(g):
    """A file of one of six formats for each part."""
    form = F.element_at(F.array(*map(F.lit, ("md", "adoc", "ts", "transcript", "txt", "hwp"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    say = lambda *x: F.concat(*[F.col(v[1:]) if v.startswith("$") else F.lit(v) for v in x])
    text = {
        "md": say("lost\n# ", "$p_name", "\n", "$p_brand"), "adoc": say(":home: /app\n== ", "$p_name", "\n[#", "$p_type", "]\n=== ", "$p_type", "\n", "$p_brand", "\n----\n== no heading\n----"),
        "ts": say("export const r = { home: defineRoute<A<B>>( '/", "$p_type", "'), detail : defineRoute('/", "$p_type", "/:id') }"),
        "transcript": say("===== PAGE 1 =====\n", "$p_name", "\n===== PAGE 12 =====\n", "$p_brand"), "txt": say("$p_name"),
    }
    body = F.coalesce(*[F.when(F.col("format") == k, v) for k, v in text.items()], F.lit("?"))
    return g.part.withColumn("format", form).select(F.col("p_partkey").alias("doc"), "format", body.alias("text"))


@query("S20_parser_dispatch", f"SELECT doc, format, locator, text, '' AS note FROM ({_PARSED_SQL}) UNION ALL SELECT p_partkey, 'hwp', '', '', 'no reader for hwp' FROM part WHERE p_partkey % 6 = 5")
def _s20(g):
    """Each file goes to the reader of its format; a format without one leaves a note."""
    units, notes = parse(_files(g))
    none = F.lit("")
    return units.select("doc", "format", "locator", "text", none.alias("note")).unionByName(notes.select("doc", F.lit("hwp").alias("format"), none.alias("locator"), none.alias("text"), "note"))


@query("S16_asciidoc_and_routes", f"WITH u AS ({_PARSED_SQL}) SELECT doc, locator, text, CASE WHEN contains(locator, ' > ') THEN split_part(locator, ' > ', 2) END AS anchor FROM u WHERE format = 'adoc' UNION ALL SELECT doc, locator, text, NULL FROM u WHERE format = 'ts'")
def _s16(g):
    f = _files(g)
    a = asciidoc_units(_lines(f.where("format = 'adoc'"))).select("doc", F.col("path").alias("locator"), "text", "anchor")
    return a.unionByName(route_symbols(f.where("format = 'ts'")).select("doc", F.col("key").alias("locator"), F.col("path").alias("text"), F.lit(None).cast("string").alias("anchor")))


@query("S1_snapshot_scan", """SELECT s.source AS source_id, v.kind AS record_kind, coalesce(v.n, 0) AS n, CASE WHEN v.n IS NULL THEN 'no evidence file' END AS note FROM source s
LEFT JOIN (SELECT source, CASE lang WHEN 'en' THEN 'doc_section' WHEN 'de' THEN 'feature_row' ELSE 'none' END AS kind, count(*) AS n FROM evidence WHERE source NOT IN ('src3', 'src4') GROUP BY 1, 2) v ON v.source = s.source WHERE s.source <> 'src9'""")
def _s1(g):
    """A snapshot is written and read back: registered sources with their records by kind; two have no evidence, one isn't asked for."""
    path = f"{run_folder(g.spark)}/snapshot-{uuid.uuid4().hex[:12]}"
    kind = F.when(F.col("lang") == "en", "doc_section").when(F.col("lang") == "de", "feature_row")
    e = g.evidence.where("source NOT IN ('src3', 'src4')").select(
        F.col("source").alias("source_id"), F.concat(F.lit("ev_"), F.col("doc_id").cast("string")).alias("evidence_id"), F.substring("snippet", 1, 500).alias("excerpt"), F.struct(kind.alias("record_kind")).alias("structured"))
    write_snapshot(g.source.select(F.col("source").alias("source_id"), F.lit("txt").alias("format")), e, path)
    names = [r.source for r in g.source.where("source <> 'src9'").select("source").collect()]  # one row a registered source
    return read_snapshot(g.spark, path, names)


@query("S27_golden_sources", """WITH q AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN substr(text, 1, 12) WHEN 1 THEN 'not said' ELSE text END AS quote, turn + CASE turn % 5 WHEN 4 THEN 100 ELSE 0 END AS at FROM conversations)
SELECT q.conv_id, q.turn, 'message' AS kind, CASE WHEN max(c.text) IS NULL THEN 'no such place' WHEN max(CASE WHEN contains(c.text, q.quote) THEN 1 ELSE 0 END) = 1 THEN 'found' ELSE 'not there' END AS state FROM q LEFT JOIN conversations c ON c.conv_id = q.conv_id AND c.turn = q.at GROUP BY 1, 2
UNION ALL SELECT NULL, b.item_id, 'text', CASE WHEN count(d.doc_id) > 0 THEN 'found' ELSE 'not there' END FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 2""")
def _s27(g):
    """Quotes of a golden list against their sources: a message by thread and turn, or any text."""
    part = F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 12)).when(F.col("turn") % 3 == 1, "not said").otherwise(F.col("text"))
    q = g.conversations.select("conv_id", "turn", part.alias("quote"), (F.col("turn") + F.when(F.col("turn") % 5 == 4, 100).otherwise(0)).alias("at"))
    c = g.conversations.select("conv_id", F.col("turn").alias("at"), F.col("text").alias("said"))
    m = q.join(c, ["conv_id", "at"], "left").groupBy("conv_id", "turn").agg(F.max("said").alias("said"), F.max(F.contains("said", "quote").cast("int")).alias("hit"))
    m = m.select("conv_id", "turn", F.lit("message").alias("kind"), F.when(F.col("said").isNull(), "no such place").when(F.col("hit") == 1, "found").otherwise("not there").alias("state"))
    t = g.benchmark.select("item_id").join(holding(g.documents, g.benchmark).select("item_id").distinct().withColumn("hit", F.lit(True)), "item_id", "left")
    return m.unionByName(t.select(F.lit(None).cast("long").alias("conv_id"), F.col("item_id").alias("turn"), F.lit("text").alias("kind"), F.when(F.col("hit"), "found").otherwise("not there").alias("state")))


@query("S15_markdown_sections", "WITH l AS (SELECT conv_id AS doc, turn, CASE WHEN role = 'user' THEN '# ' || split_part(text, ' ', 1) ELSE replace(text, chr(10), ' ') END AS line FROM conversations), s AS (SELECT *, sum(CASE WHEN starts_with(line, '# ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY turn) AS section FROM l) SELECT doc, CAST(section AS BIGINT) AS section, max(CASE WHEN starts_with(line, '# ') THEN substr(line, 3) END) AS title, coalesce(string_agg(CASE WHEN NOT starts_with(line, '# ') THEN line END, chr(10) ORDER BY turn), '') AS text FROM s WHERE section > 0 GROUP BY 1, 2")
def _s15(g):
    line = F.when(F.col("role") == "user", F.concat(F.lit("# "), F.split_part("text", F.lit(" "), F.lit(1)))).otherwise(F.regexp_replace("text", "\n", " "))
    return markdown_units(g.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("no"), line.alias("line")))


@query("S17_chat_scan", "SELECT conv_id, turn, role, text, conv_id || '#' || turn AS locator FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS rn FROM conversations) WHERE rn = 1 AND text IS NOT NULL")
def _s17(g):
    """Messages once a (thread, ts), the first kept; the locator names the thread."""
    n = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    c = g.conversations.withColumn("rn", n).where("rn = 1 AND text IS NOT NULL")
    return c.select("conv_id", "turn", "role", "text", F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("locator"))


@query("S2_source_registration", "SELECT source, sensitivity, CASE doc_status WHEN 'deprecated' THEN 'superseded' ELSE doc_status END AS doc_status FROM source WHERE sensitivity <> ''")
def _s2(g):
    """Sources of the configuration only; an empty sensitivity is rejected."""
    status = F.coalesce(F.create_map(F.lit("deprecated"), F.lit("superseded"))[F.col("doc_status")], F.col("doc_status"))
    return g.source.where(F.coalesce("sensitivity", F.lit("")) != "").select("source", "sensitivity", status.alias("doc_status"))


#: Marks by which a transcript says that it could not be read for certain.
UNCERTAIN = ("[판독불가]", "[판독주의]")


def page_units(transcripts: DataFrame) -> DataFrame:
    """(doc, page, text, uncertain) of transcripts (doc, text) with `===== PAGE n =====` lines, in the order of the text."""
    pages = F.regexp_extract_all("text", F.lit(r"(?s)=====\s*PAGE\s+(\d+)\s*=====\n?(.*?)(?======\s*PAGE\s|\z)"), F.lit(1))
    texts = F.regexp_extract_all("text", F.lit(r"(?s)=====\s*PAGE\s+(\d+)\s*=====\n?(.*?)(?======\s*PAGE\s|\z)"), F.lit(2))
    p = transcripts.select("doc", F.inline(F.arrays_zip(pages.alias("page"), texts.alias("text"))))
    p = p.select("doc", F.col("page").cast("long").alias("page"), F.regexp_replace("text", r"\n+$", "").alias("text"))
    return p.withColumn("uncertain", F.exists(F.array(*map(F.lit, UNCERTAIN)), lambda m: F.contains("text", m)))


@query("S12_page_markers", """SELECT o_custkey AS doc, rn AS page, o_orderpriority || chr(10) || 'order ' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN ' [판독주의]' ELSE '' END AS text, o_orderstatus = 'P' AS uncertain
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)""")
def _s12(g):
    """Transcripts of a customer's orders, a page each, with ten pages or more, split back into their pages."""
    said = F.concat("o_orderpriority", F.lit("\norder "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", f" {UNCERTAIN[1]}").otherwise(""))
    o = g.orders.select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"), said.alias("said"))
    page = F.transform(F.sort_array(F.collect_list(F.struct("n", "said"))), lambda x: F.concat(F.lit("===== PAGE "), x.n.cast("string"), F.lit(" =====\n"), x.said))
    return page_units(o.groupBy(F.col("o_custkey").alias("doc")).agg(F.array_join(page, "\n").alias("text")))


@query("S23_purge_by_prefix", "SELECT type, count(*) AS n FROM edge WHERE NOT starts_with(from_key, 'Customer#00000000') AND NOT starts_with(to_key, 'Customer#00000000') GROUP BY 1")
def _s23(g, prefix="Customer#00000000"):
    e = g.edge.where(~F.startswith("from_key", F.lit(prefix)) & ~F.startswith("to_key", F.lit(prefix)))
    return e.groupBy("type").agg(F.count("*").alias("n"))


@query("S21_upsert_snapshot", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 4 = 0 THEN 'run-2' ELSE 'run-1' END AS run_id,
  '2024-01-01' AS created, CASE WHEN c_custkey % 4 = 0 THEN '2024-02-01' ELSE '2024-01-01' END AS updated, 2 AS version FROM customer""")
def _s21(g):
    """Three runs into a keyed snapshot: all rows, a batch in which every fourth differs, and the same batch again, which changes nothing."""
    root, day = f"{run_folder(g.spark)}/nodes-{uuid.uuid4().hex[:12]}", lambda d: F.lit(d).cast("timestamp")
    first = g.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal")).alias("balance"))
    again = first.select("id", F.when(F.col("id") % 4 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"), F.lit(None).cast("double").alias("balance"))
    snapshots.merge(first, root, ["id"], "run-1", day("2024-01-01"), buckets=16)
    snapshots.merge(again, root, ["id"], "run-2", day("2024-02-01"))
    version = snapshots.merge(again, root, ["id"], "run-3", day("2024-03-01"))
    days = [F.date_format(c, "yyyy-MM-dd").alias(c.removesuffix("_at")) for c in ("created_at", "updated_at")]
    return snapshots.read(g.spark, root).select("id", "name", "balance", "run_id", *days, F.lit(version).alias("version"))


@query("S23_reset_run", """
WITH n AS (SELECT account AS key FROM account UNION SELECT need FROM has_need WHERE length(need) % 2 = 1), e AS (SELECT DISTINCT account, need FROM has_need)
SELECT 'node' AS kind, count(*) AS n FROM n UNION ALL SELECT 'edge', count(*) FROM e WHERE need IN (SELECT key FROM n)""")
def _s23_reset(g):
    """What is left when the nodes of one run go, with the edges that end in them."""
    nodes, edges = (f"{run_folder(g.spark)}/{kind}-{uuid.uuid4().hex[:12]}" for kind in ("nodes", "edges"))
    need = g.has_need.select(F.col("need").alias("key")).distinct()
    hand = g.account.select(F.col("account").alias("key")).unionByName(need.where("length(key) % 2 = 1"))
    snapshots.merge(hand, nodes, ["key"], "by hand", buckets=8)
    snapshots.merge(need.where("length(key) % 2 = 0"), nodes, ["key"], "pipeline")
    snapshots.merge(g.has_need.select(F.col("account").alias("from_key"), F.col("need").alias("to_key")), edges, ["from_key", "to_key"], "pipeline", buckets=8)
    snapshots.reset_run(g.spark, nodes, "pipeline", edges)
    count = lambda kind, root: snapshots.read(g.spark, root).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count("node", nodes).unionByName(count("edge", edges))


#: The key that is unique for each label.
UNIQUE = {"Account": ("account", "account"), "BusinessDomain": ("domain", "domain"), "Deal": ("deal", "deal_id"), "Feature": ("feature", "feature_id"), "Source": ("source", "source"), "Evidence": ("evidence", "locator"), "Claim": ("claim", "claim_id"), "Observation": ("observation", "obs_id"), "Need": ("need_row", "need")}
_UNIQUE_SQL = " UNION ALL ".join(f"SELECT '{label}' AS label, count(*) AS n, count(*) - count(DISTINCT {key}) AS repeats, count(*) FILTER ({key} IS NULL) AS nulls FROM {view}" for label, (view, key) in UNIQUE.items())


@query("S24_uniqueness_checks", f"SELECT label, n, repeats, nulls, CASE WHEN repeats + nulls = 0 THEN 'online' ELSE 'failed' END AS state FROM ({_UNIQUE_SQL})")
def _s24(g):
    """State of the uniqueness constraints; needs as they stand in order lines repeat, so that one fails."""
    c = [getattr(g, view).agg(F.lit(label).alias("label"), F.count("*").alias("n"), (F.count("*") - F.countDistinct(key)).alias("repeats"), F.count_if(F.col(key).isNull()).alias("nulls")) for label, (view, key) in UNIQUE.items()]
    state = F.when(F.col("repeats") + F.col("nulls") == 0, "online").otherwise("failed")
    return reduce(DataFrame.unionByName, c).withColumn("state", state)


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """`edges` and `new` (type, from_key, to_key), each once; an unknown type or a missing end is an error."""
    odd = new.where(~F.col("type").isin(*types)).limit(1).collect()
    if odd:
        raise ValueError(f"no such edge type: {odd[0].type}")
    lost = missing_ends(new, nodes).limit(3).collect()
    if lost:
        raise LookupError("no such node: " + ", ".join(r.key for r in lost))
    return edges.unionByName(new).distinct()


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key): ends of edges that are no nodes."""
    ends = edges.select(F.col("from_key").alias("key")).unionByName(edges.select(F.col("to_key").alias("key"))).distinct()
    return ends.join(nodes, "key", "left_anti")


@query("S22_edge_endpoints", """WITH new AS (SELECT DISTINCT p_name AS need, p_type AS capability FROM part WHERE p_size <= 2), node AS (SELECT need AS key FROM has_need UNION SELECT capability FROM feature)
SELECT 'refused' AS state, need AS from_key, capability AS to_key FROM new WHERE need NOT IN (SELECT key FROM node)
UNION ALL SELECT 'kept', need, capability FROM (SELECT * FROM addressed_by WHERE need IN (SELECT key FROM node) UNION SELECT * FROM new WHERE need IN (SELECT key FROM node))""")
def _s22(g):
    """New edges are put in where both ends are nodes; the others are refused, not half written."""
    node = g.has_need.select(F.col("need").alias("key")).unionByName(g.feature.select(F.col("capability").alias("key"))).distinct()
    as_edge = lambda df: df.select(F.lit("ADDRESSED_BY").alias("type"), F.col("need").alias("from_key"), F.col("capability").alias("to_key"))
    new = as_edge(g.part.where("p_size <= 2").select(F.col("p_name").alias("need"), F.col("p_type").alias("capability")).distinct())
    known = node.select(F.col("key").alias("from_key"))
    good, bad = new.join(known, "from_key", "left_semi"), new.join(known, "from_key", "left_anti")
    kept = upsert_edges(as_edge(g.addressed_by).join(known, "from_key", "left_semi"), good, node, ("ADDRESSED_BY",))
    return bad.select(F.lit("refused").alias("state"), "from_key", "to_key").unionByName(kept.select(F.lit("kept").alias("state"), "from_key", "to_key"))


@query("H11_evidence_extras", "SELECT doc_id, locator, regexp_matches(snippet, '\\[(EMAIL|PHONE)\\]') AS masked, length(snippet) AS chars FROM evidence")
def _h11(g):
    return g.evidence.select("doc_id", "locator", F.col("snippet").rlike(r"\[(EMAIL|PHONE)\]").alias("masked"), F.length("snippet").alias("chars"))


@query("H20_text_surfaces", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS surface FROM conversations GROUP BY 1")
def _h20(g):
    t = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("s"))))
    return g.conversations.groupBy("conv_id").agg(t.alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: x.s), "\n").alias("surface"))


