"""Tables in workbooks without a known layout: their heading row is searched, rows become `label: value` texts, and an audit tells which cells no excerpt holds.

Defined cases: the heading is the first of the first rows in which enough cells are filled and none is long; without one, labels are column letters; columns
beyond MAX_COLUMNS are left out; of rows that differ in white space only the first of a document stays; values of one character and trivial ones aren't audited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from provena.functions import text as X
from provena.registry import query
from provena.sources.office import _grid, cells, column_letters, workbooks

# Rows that are searched, cells that a heading has at least, its longest label, and columns of a table.
HEADER_ROWS, HEADER_CELLS, LONG_LABEL, MAX_COLUMNS = 10, 2, 40, 30
#: Values that tell nothing.
TRIVIAL = ("-", "0", "O", "X", "N/A")
#: A longer value counts as held where its beginning is.
PREFIX = 60


def heading_rows(c: DataFrame) -> DataFrame:
    """(doc, sheet, head_row) of cells (doc, sheet, row, col, value, own); only cells of their own make a heading."""
    own = c.where(F.col("own") & (F.col("row") <= HEADER_ROWS) & (F.col("col") <= MAX_COLUMNS) & (F.trim("value") != ""))
    rows = own.groupBy("doc", "sheet", "row").agg(F.count("*").alias("n"), F.max(F.length(X.squeeze(F.col("value")))).alias("longest"))
    return rows.where((F.col("n") >= HEADER_CELLS) & (F.col("longest") <= LONG_LABEL)).groupBy("doc", "sheet").agg(F.min("row").alias("head_row"))


def table_rows(c: DataFrame) -> DataFrame:
    """(doc, sheet, row, locator, text) of the rows below the headings, each text once a document."""
    c = c.where((F.col("col") <= MAX_COLUMNS) & (F.trim("value") != "")).withColumn("value", X.squeeze(F.col("value")))
    c = c.join(heading_rows(c), ["doc", "sheet"], "left")
    # a label goes down its column in one window over the sheet's cells
    label = F.max(F.when(F.col("row") == F.col("head_row"), F.col("value"))).over(Window.partitionBy("doc", "sheet", "col"))
    c = c.withColumn("label", F.coalesce(label, column_letters(F.col("col")))).where("head_row IS NULL OR row > head_row")
    part = F.struct("col", F.concat("label", F.lit(": "), "value").alias("t"))
    r = c.groupBy("doc", "sheet", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), " | ").alias("text"))
    first = F.row_number().over(Window.partitionBy("doc", F.sha2(F.regexp_replace("text", r"\s+", "").cast("binary"), 256)).orderBy("sheet", "row"))
    r = r.withColumn("_n", first).where("_n = 1")
    return r.select("doc", "sheet", "row", F.concat("sheet", F.lit("!R"), F.col("row").cast("string")).alias("locator"), "text")


def audit(c: DataFrame, excerpts: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """(doc, sheet, row, col, value, state) of cells below the headings, against `excerpts` (doc, sheet, row, text).

    covered: the row's own excerpt holds it; merged: the row has none, another row's of the sheet holds it; orphan: the row has none and none holds it;
    masked: it is personal data; missing: the row's excerpt should hold it and doesn't; trivial.  Cells of rows without an excerpt meet excerpts by
    the sheet and the value's words, not by all pairs.
    """
    c = c.where((F.col("col") <= MAX_COLUMNS) & (F.trim("value") != "")).select("doc", "sheet", "row", "col", X.squeeze(F.col("value")).alias("value"))
    h = heading_rows(c.withColumn("own", F.lit(True))) if head is None else head
    c = c.join(h, ["doc", "sheet"], "left").where("head_row IS NULL OR row > head_row").drop("head_row")
    own = excerpts.groupBy("doc", "sheet", "row").agg(F.array_join(F.collect_list("text"), "\n").alias("hay"))
    x = c.join(own, ["doc", "sheet", "row"], "left")
    held = _held(F.col("hay"), F.col("value"))
    personal = F.size(X.masked(F.col("value"))["hits"]) > 0
    state = F.when((F.length("value") < 2) | F.col("value").isin(*TRIVIAL), "trivial").when(F.col("hay").isNull(), "?").when(held, "covered").when(personal, "masked").otherwise("missing")
    x = x.withColumn("state", state).drop("hay").withColumn("w", F.split(F.substring("value", 1, PREFIX), r"[^\p{L}\p{N}]+"))
    # a value of no excerpt of its own: its longest word, which is whole in any excerpt that holds the value between marks, finds candidates
    lone = x.where("state = '?'").withColumn("key", F.lower(F.array_max(F.transform("w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).getField("w")))
    asked = lone.select("doc", "sheet", "key", "value").distinct()
    words = excerpts.select("doc", "sheet", "text", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("key"))
    found = asked.join(words, ["doc", "sheet", "key"]).where(_held(F.col("text"), F.col("value"))).select("doc", "sheet", "value").distinct().withColumn("there", F.lit(True))
    lone = lone.drop("key").join(found, ["doc", "sheet", "value"], "left")
    lone = lone.withColumn("state", F.when(F.col("there"), "merged").when(F.size(X.masked(F.col("value"))["hits"]) > 0, "masked").otherwise("orphan")).drop("there")
    cols = ["doc", "sheet", "row", "col", "value", "state"]
    return x.where("state <> '?'").select(cols).unionByName(lone.select(cols))


def _held(hay: Column, value: Column) -> Column:
    """The value, its beginning, or its number with or without thousands marks."""
    bare = F.regexp_replace(value, ",", "")
    number = value.rlike(r"^-?[\d,]+(\.0)?$")
    return F.contains(hay, F.substring(value, 1, PREFIX)) | F.coalesce(number & (F.contains(hay, bare) | F.contains(hay, F.regexp_replace(F.format_number(bare.try_cast("double"), 0), r"\.0+$", ""))), F.lit(False))


def _files(g) -> DataFrame:
    """Workbooks of parts: a long title, an empty row, headings and rows; every third has no headings. Rows of equal name and type repeat but for spaces."""
    n = F.row_number().over(Window.partitionBy("doc").orderBy("p_partkey"))
    p = g.part.withColumn("doc", F.floor(F.col("p_partkey") / 100)).withColumn("sheet", F.lit("parts")).withColumn("n", n)
    plain = F.col("doc") % 3 == 2
    row = F.when(plain, F.col("n")).otherwise(F.col("n") + 4)
    body = _grid(p, (row, 1, F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "  ").otherwise(" "), F.lit("x"))), (row, 2, F.col("p_type")), (row, 3, F.when(plain, F.lit("a value that is much too long to be a label of any column").cast("string"))))
    d = p.where(~plain).select("doc", "sheet").distinct()
    head = _grid(d, (F.lit(1), 1, "The list of all parts, as it was on the day of the last review"), (F.lit(1), 2, "x"), (F.lit(3), 1, "only one"), (F.lit(4), 1, "part name"), (F.lit(4), 2, "kind"))
    return workbooks(body.unionByName(head))


_S10_SQL = """p AS (SELECT *, p_partkey // 100 AS doc, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) AS n FROM part),
t AS (SELECT doc, CASE WHEN doc % 3 = 2 THEN n ELSE n + 4 END AS row, p_partkey, CASE WHEN doc % 3 = 2 THEN 'A: ' || p_name || ' x | B: ' || p_type || ' | C: a value that is much too long to be a label of any column' ELSE 'part name: ' || p_name || ' x | kind: ' || p_type END AS text FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY doc, replace(text, ' ', '') ORDER BY row) AS k FROM t)"""


@query("S10_table_row_dedup", f"WITH {_S10_SQL} SELECT doc, 'parts!R' || row AS locator, text FROM s WHERE k = 1")
def _s10(g):
    return table_rows(cells(_files(g))).select("doc", "locator", "text")


@query("M12_cell_coverage", f"""WITH {_S10_SQL}, e AS (SELECT doc, row, CASE WHEN row % 5 = 0 THEN replace(text, 'kind: ', 'kind: no ') ELSE text END AS text, row % 5 = 0 AS spoilt FROM s WHERE k = 1 AND row % 7 <> 0),
c AS (SELECT t.doc, t.row, 1 AS col, p_name || ' x' AS value FROM t JOIN part USING (p_partkey) UNION ALL SELECT t.doc, t.row, 2, p_type FROM t JOIN part USING (p_partkey) UNION ALL SELECT doc, row, 3, 'a value that is much too long to be a label of any column' FROM t WHERE doc % 3 = 2),
x AS (SELECT c.doc, c.row, c.col, CASE WHEN e.doc IS NOT NULL THEN CASE WHEN contains(CASE WHEN e.spoilt THEN regexp_replace(e.text, ' \\| (kind|B): .*', '') ELSE e.text END, c.value) THEN 'covered' ELSE 'missing' END
  ELSE CASE WHEN EXISTS (SELECT 1 FROM e o WHERE o.doc = c.doc AND contains(CASE WHEN o.spoilt THEN regexp_replace(o.text, ' \\| (kind|B): .*', '') ELSE o.text END, c.value)) THEN 'merged' ELSE 'orphan' END END AS state
  FROM c LEFT JOIN e ON e.doc = c.doc AND e.row = c.row)
SELECT doc, col, state, count(*) AS n, min(row) AS first FROM x GROUP BY 1, 2, 3""")
def _m12(g):
    """Cells against excerpts of which every seventh row's is lost, and every fifth row's goes without all but its first column."""
    c = cells(_files(g))
    e = table_rows(c).where("row % 7 <> 0").withColumn("text", F.when(F.col("row") % 5 == 0, F.regexp_replace("text", r" \| (kind|B): .*", "")).otherwise(F.col("text")))
    return audit(c, e).groupBy("doc", "col", "state").agg(F.count("*").alias("n"), F.min("row").alias("first"))
