"""Amounts that contradict each other: asked for a magnitude, two sources name values in one currency that lie far apart.

Excerpts with an amount meet the questions by shared terms; of each (question, currency) one aggregation takes the
least and the greatest value with excerpt, source and wording.  Questions without terms are about everything: their extremes
come from an aggregation by currency over all amounts, not from pairs.

Defined cases: of equal least values the one of the lowest excerpt id and place counts, of equal greatest values that of the highest; the currency that
comes first in the order of excerpts is told, one dispute a question; both sides in one source, values of zero, and
equal wordings are none; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from provena.functions import text as X
from provena.operators.tagging import on_topic
from provena.registry import query

# Questions for a magnitude, and how far apart values have to lie.
MAGNITUDE = r"얼마|규모|금액|벌금|비용|가격|몇\s*(억|만|건|원)"
FACTOR = 2.0


def amounts_of(evidence: DataFrame) -> DataFrame:
    """(evidence_id, source, place, wording, currency, value) of all amounts in `evidence` (evidence_id, source, snippet)."""
    wording = F.transform(F.regexp_extract_all("snippet", F.lit(X.AMOUNT), F.lit(0)), lambda s: F.trim(s))
    x = evidence.where(F.col("snippet").rlike(X.AMOUNT)).select("evidence_id", "source", F.posexplode(F.arrays_zip(X.amounts(F.col("snippet")).alias("a"), wording.alias("w"))).alias("place", "x"))
    return x.select("evidence_id", "source", "place", F.col("x.w").alias("wording"), F.col("x.a.currency").alias("currency"), F.col("x.a.value").alias("value"))


def _extremes() -> list[Column]:
    side = F.struct("value", "evidence_id", "place", "source", "wording")
    return [F.min(side).alias("low"), F.max(side).alias("high"), F.min(F.struct("evidence_id", "place")).alias("first")]


def detect(questions: DataFrame, evidence: DataFrame, magnitude: str = MAGNITUDE, factor: float = FACTOR) -> DataFrame:
    """(item_id, currency, low, high): `questions` has (item_id, text, terms), low and high are structs with value, evidence_id, source and wording."""
    asked = questions.where(F.col("text").rlike(magnitude))
    amounts = amounts_of(evidence)
    texts = evidence.where(F.col("snippet").rlike(X.AMOUNT)).select("evidence_id", F.col("snippet").alias("text"))
    about = on_topic(texts, asked, 1).join(amounts, "evidence_id").groupBy("item_id", "currency").agg(*_extremes())
    all_ = amounts.groupBy("currency").agg(*_extremes())
    free = asked.where("coalesce(size(terms), 0) <= 0").select("item_id").withColumn("_one", F.lit(1)).join(all_.withColumn("_one", F.lit(1)), "_one")  # a row for each currency
    x = about.unionByName(free.select(about.columns))
    apart = (F.col("low.source") != F.col("high.source")) & (F.col("low.value") > 0) & (F.col("high.value") >= factor * F.col("low.value")) & (X.fold(F.col("low.wording"), False) != X.fold(F.col("high.wording"), False))
    first = F.row_number().over(Window.partitionBy("item_id").orderBy("first"))
    return x.where(apart).withColumn("rn", first).where("rn = 1").select("item_id", "currency", "low", "high")


#: Deals as sentences of the regions' sources: every fourth in thousands, the currency by priority.
_DEALS = """SELECT d.deal_id AS evidence_id, concat('src', cast(d.deal_id % 5 AS string)) AS source,
concat('deal of c', cast(d.custkey AS string), ' is ', CASE WHEN d.deal_id % 4 = 0 THEN concat(cast(cast(floor(d.amount / 1000) AS bigint) AS string), 'K') ELSE cast(cast(floor(d.amount) AS bigint) AS string) END, CASE WHEN d.stage < '3' THEN ' USD' ELSE ' 유로' END) AS snippet FROM {deal} d"""


@query("X7_contradictions", f"""
WITH e AS ({_DEALS.replace('{deal}', 'deal')}),
a AS (SELECT evidence_id, source, substr(split_part(snippet, ' ', 3), 2) AS item, trim(regexp_extract(snippet, 'is (.*)$', 1)) AS wording, CASE WHEN snippet LIKE '%USD' THEN 'USD' ELSE '유로' END AS currency,
  CAST(regexp_extract(snippet, 'is ([0-9]+)', 1) AS DOUBLE) * CASE WHEN contains(snippet, 'K ') THEN 1000 ELSE 1 END AS value FROM e),
x AS (SELECT CAST(item AS BIGINT) AS item_id, currency, arg_min(evidence_id, (value, evidence_id)) AS low_id, min(value) AS low, arg_max(evidence_id, (value, evidence_id)) AS high_id, max(value) AS high, min(evidence_id) AS first FROM a GROUP BY 1, 2
  UNION ALL SELECT 0, currency, arg_min(evidence_id, (value, evidence_id)), min(value), arg_max(evidence_id, (value, evidence_id)), max(value), min(evidence_id) FROM a GROUP BY 2),
y AS (SELECT x.*, row_number() OVER (PARTITION BY item_id ORDER BY first) AS rn FROM x WHERE low_id % 5 <> high_id % 5 AND low > 0 AND high >= 2 * low AND (item_id = 0 OR item_id % 2 = 0))
SELECT item_id, currency, low_id, low, high_id, high FROM y WHERE rn = 1""")
def _x7(g):
    """Of every account, what its deals are worth by different sources; every second question asks for something else than a magnitude."""
    evidence = g.spark.sql(_DEALS, deal=g.deal)
    of = g.account.select(F.col("custkey").alias("item_id"), F.when(F.col("custkey") % 2 == 0, "얼마인가?").otherwise("어디인가?").alias("text"), F.array(F.concat(F.lit("c"), F.col("custkey").cast("string"))).alias("terms"))
    every = g.spark.range(1).select(F.lit(0).cast("long").alias("item_id"), F.lit("총 얼마?").alias("text"), F.array().cast("array<string>").alias("terms"))
    return detect(of.unionByName(every), evidence).select("item_id", "currency", F.col("low.evidence_id").alias("low_id"), F.col("low.value").alias("low"), F.col("high.evidence_id").alias("high_id"), F.col("high.value").alias("high"))
