"""The gate behind model extraction: what an item says has to stand in the quote that it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provena.registry import query

# Fields whose whole value must stand in the quote, fields that only address it, and a number.
BOUND = ("entity", "account", "company", "customer", "competitor", "product", "person", "org", "organization", "vendor", "partner")
ADDRESS = ("source_id", "locator")
NUMBER = r"\d[\d,]*(?:\.\d+)?"
#: Terms meet values by at most so many of their first characters.
KEY_CHARS = 8


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def reasons(quote: Column, fields: Column, bound: tuple[str, ...]) -> Column:
    """Numbers of any field and values of bound fields that the quote doesn't hold, as `field: kind value`."""
    q = _plain(quote)
    digits = F.replace(q, F.lit(","), F.lit(""))
    number = lambda name, t: F.transform(F.filter(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), lambda n: ~F.contains(digits, F.replace(n, F.lit(","), F.lit("")))), lambda n: F.concat(name, F.lit(": number "), n))
    value = lambda name, t: F.when(name.isin(*bound) & (_plain(t) != "") & ~F.contains(q, _plain(t)), F.array(F.concat(name, F.lit(": name "), _plain(t)))).otherwise(F.array().cast("array<string>"))
    each = lambda e: F.flatten(F.transform(F.filter(e["value"], lambda t: t.isNotNull()), lambda t: F.concat(number(e["key"], t), value(e["key"], t))))
    said = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*ADDRESS) & e["value"].isNotNull())
    return F.coalesce(F.flatten(F.transform(said, each)), F.array().cast("array<string>"))


def unquoted_terms(items: DataFrame, lexicon: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, terms): terms of `lexicon` (term), whatever its size, that a field holds and the quote doesn't, as `field: term x`.

    A term can start at any character of a value, so values are cut at each of them and meet the terms by their first characters, as many as
    the term has and at most `KEY_CHARS`; whole terms are compared then.  Only lengths that the lexicon has are cut.
    """
    low = lambda c: F.lower(_plain(c))
    t = lexicon.select(F.col("term").alias("shown"), low(F.col("term")).alias("term")).where("term <> ''").groupBy("term").agg(F.min("shown").alias("shown"))
    t = t.select("term", "shown", F.substring("term", 1, KEY_CHARS).alias("key"))
    lengths = sorted(r[0] for r in t.select(F.length("key")).distinct().collect())  # at most KEY_CHARS numbers
    v = items.select("item_id", F.explode("fields").alias("name", "texts")).where(~F.col("name").isin(*ADDRESS, *exempt))
    v = v.select("item_id", "name", F.explode("texts").alias("value")).select("item_id", "name", low(F.col("value")).alias("value")).where("value <> ''").distinct()
    starts = lambda n: F.when(F.length("value") >= n, F.transform(F.sequence(F.lit(1), F.length("value") - n + 1), lambda i: F.substr("value", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(F.array().cast("array<string>"), *map(starts, lengths)))
    hit = v.select("*", F.explode(keys).alias("key")).join(t, "key").where(F.contains("value", "term")).select("item_id", "name", "term", "shown").distinct()
    lost = hit.join(items.select("item_id", low(F.col("quote")).alias("quote")), "item_id").where(~F.contains("quote", "term"))
    return lost.groupBy("item_id").agg(F.sort_array(F.collect_set(F.concat("name", F.lit(": term "), "shown"))).alias("terms"))


def gate(items: DataFrame, lexicon: DataFrame, more_bound: tuple[str, ...] = (), exempt: tuple[str, ...] = ()) -> DataFrame:
    """`items` (item_id, unique; quote; fields map<string, array<string>>) with `reasons`, sorted and distinct; an item without any is kept.

    A blank or null quote is the only reason of its item.  Numbers count in every field but the address; `exempt` fields are free of names and terms
    (the caller holds them against the excerpt), not of numbers.
    """
    bound = tuple(f for f in (*BOUND, *more_bound) if f not in exempt)
    x = items.join(unquoted_terms(items, lexicon, exempt), "item_id", "left")
    said = F.array_sort(F.array_distinct(F.concat(reasons(F.col("quote"), F.col("fields"), bound), F.coalesce("terms", F.array().cast("array<string>")))))
    blank = F.coalesce(_plain(F.col("quote")), F.lit("")) == ""
    return x.withColumn("reasons", F.when(blank, F.array(F.lit("no quote"))).otherwise(said)).drop("terms")


_ITEMS = """SELECT d.doc_id AS item_id, CASE WHEN d.doc_id % 11 = 0 THEN '  ' ELSE substr(d.text, 1, 300) END AS quote,
  CASE WHEN d.doc_id % 3 = 0 THEN substr(d.text, 1, 20) ELSE p.p_name END AS entity, concat('sum of ', d.doc_id % 50, ' for ', p.p_name) AS statement, p.p_brand AS amount_of
FROM {documents} d JOIN {part} p ON p.p_partkey = d.doc_id % 100"""


@query("X8_extraction_gate", rf"""WITH i AS ({_ITEMS.replace('{', '').replace('}', '')}),
q AS (SELECT *, trim(regexp_replace(quote, '[\s\x0B]+', ' ', 'g')) AS n FROM i), t AS (SELECT DISTINCT unnest([p_name, string_split(p_name, ' ')[1]]) AS term FROM part),
s AS (SELECT item_id, n, unnest(['entity', 'statement', 'amount_of']) AS name, unnest([entity, statement, amount_of]) AS v FROM q WHERE n <> ''),
r AS (SELECT item_id, name || ': number ' || x AS reason FROM (SELECT *, unnest(regexp_extract_all(v, '{NUMBER}')) AS x FROM s) WHERE NOT contains(replace(n, ',', ''), replace(x, ',', ''))
  UNION SELECT item_id, 'entity: name ' || trim(regexp_replace(v, '\s+', ' ', 'g')) FROM s WHERE name = 'entity' AND NOT contains(n, trim(regexp_replace(v, '\s+', ' ', 'g')))
  UNION SELECT item_id, name || ': term ' || term FROM s JOIN t ON contains(lower(v), term) WHERE name <> 'amount_of' AND NOT contains(lower(n), term) UNION SELECT item_id, 'no quote' FROM q WHERE n = '')
SELECT item_id, coalesce(string_agg(reason, '|' ORDER BY reason), '') AS reasons FROM q LEFT JOIN r USING (item_id) GROUP BY 1""")
def _x8(g):
    """Items of every document: an entity from its text or not, a statement with a number and a product's name, and an exempt field."""
    one = lambda n: F.array(n)
    i = g.spark.sql(_ITEMS, documents=g.documents, part=g.part).select("item_id", "quote", F.create_map(*[x for n in ("entity", "statement", "amount_of") for x in (F.lit(n), one(n))]).alias("fields"))
    lexicon = g.part.select(F.explode(F.array("p_name", F.substring_index("p_name", " ", 1))).alias("term"))
    return gate(i, lexicon, exempt=("amount_of",)).select("item_id", F.array_join("reasons", "|").alias("reasons"))
