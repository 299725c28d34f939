"""Which texts hold which quotes: joins on runs of words with a comparison of the quote itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provena.functions import text as X

#: Words of a quote that make its key; the first and the last word may be parts of longer ones in a text.
KEY_WORDS = 4
#: Keys of short quotes up to this number filter a text's keys before they become rows.
KEYS_IN_PLAN = 5_000


def _words(c: Column) -> Column:
    return F.split(c, r"\s+")


def _grams(ws: Column, k: int) -> Column:
    return F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(1), F.size(ws) - k + 1), lambda i: F.xxhash64(F.lit(k), F.array_join(F.slice(ws, i, k), " "))))


def holding(docs: DataFrame, quotes: DataFrame, squeezed: bool = False) -> DataFrame:
    """(item_id, doc_id) where the text of `docs` (doc_id, text) contains that of `quotes` (item_id, text).

    A quote's key is the run of up to KEY_WORDS words after its first; a text that holds the quote holds
    the run as whole words, so an equi join finds it and `contains` confirms it.  Quotes of one or two
    words have no such run; their key is the pair of characters they begin with, or the one they have.
    An empty quote is in every text.  With `squeezed`, case doesn't count and runs of white space are one space.
    """
    form = (lambda c: F.lower(X.squeeze(c))) if squeezed else (lambda c: c)
    q = quotes.where("text IS NOT NULL").select("item_id", form(F.col("text")).alias("q"))
    q = q.withColumn("ws", _words(F.col("q"))).withColumn("k", F.least(F.lit(KEY_WORDS), F.size("ws") - 2))
    d = docs.where("text IS NOT NULL").select("doc_id", form(F.col("text")).alias("t"))
    sizes = range(1, KEY_WORDS + 1)
    key = F.coalesce(*[F.when(F.col("k") == k, F.xxhash64(F.lit(k), F.array_join(F.slice("ws", 2, k), " "))) for k in sizes])
    long = q.where("k > 0").select("item_id", "q", key.alias("key"))
    used = [r.k for r in q.where("k > 0").select("k").distinct().collect()]  # at most KEY_WORDS numbers
    none = F.array().cast("array<bigint>")
    grams = F.concat(*[F.coalesce(_grams(F.col("ws"), k), none) for k in sorted(used)]) if used else none
    keyed = d.select("doc_id", F.explode(F.array(_words(F.col("t")))).alias("ws")).select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
    pairs = keyed.join(long.select("item_id", "key"), "key").select("item_id", "doc_id").distinct()
    found = pairs.join(long.select("item_id", "q"), "item_id").join(d, "doc_id").where(F.contains("t", "q")).select("item_id", "doc_id").distinct()
    short = q.where("k <= 0").select("item_id", "q")
    if short.isEmpty():
        return found
    short = short.withColumn("key", F.substring("q", 1, 2))
    few = [r.key for r in short.select("key").distinct().limit(KEYS_IN_PLAN + 1).collect()]
    heads = F.concat(F.regexp_extract_all("t", F.lit("(?s)(?=(..))"), F.lit(1)), F.regexp_extract_all("t", F.lit("(?s)."), F.lit(0)) if len(few) > KEYS_IN_PLAN or any(len(k) == 1 for k in few) else F.array().cast("array<string>"), F.array(F.lit("")))
    heads = F.array_distinct(F.filter(heads, lambda k: k.isin(*few)) if len(few) <= KEYS_IN_PLAN else heads)
    met = d.select("doc_id", "t", F.explode(heads).alias("key")).join(short, "key").where(F.contains("t", "q"))
    return found.unionByName(met.select("item_id", "doc_id").distinct())
