"""Access policies, budgets, prices, schema faults, backfills and briefs: the tables around calls of a model, without the calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from provena.functions import text as X
from provena.registry import query

#: What each account may read.
POLICIES = {"demo": ("public", "internal", "restricted"), "viewer": ("public", "internal")}


def readable(sources: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """(account, source): what each account may read; a source without a known sensitivity is for nobody."""
    p = F.array(*[F.struct(F.lit(a).alias("account"), F.array(*map(F.lit, s)).alias("allowed")) for a, s in policies.items()])
    return sources.select("source", "sensitivity", F.inline(p)).where(F.array_contains("allowed", F.col("sensitivity"))).select("account", "source")


@query("H22_access_policies", "SELECT 'demo' AS account, source FROM source WHERE sensitivity IN ('public', 'internal', 'restricted') UNION ALL SELECT 'viewer', source FROM source WHERE sensitivity IN ('public', 'internal')")
def _h22(g):
    return readable(g.source)


def within_budget(calls: DataFrame, most: float, reserve: float, most_calls: int) -> DataFrame:
    """Calls (run, stage, seq, cost) with `allowed`: whether a run may still make them, in the order of seq.

    A call is made while the run has spent less than its ceiling and made fewer calls than `most_calls`; the last call may go over.
    Stage 'extract' leaves the reserve alone; stage 'map' comes after it and may use it; calls of any other stage, or of none, have no budget and aren't allowed.  Costs are not negative.
    """
    reserve = min(max(reserve, 0.0), most)
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy("run", *by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = calls.where("stage = 'extract'").withColumn("_n", before(F.lit(1))).withColumn("_s", before("cost"))
    first = first.withColumn("allowed", (F.col("_s") < most - reserve) & (F.col("_n") < most_calls)).drop("_n", "_s")
    spent = first.where("allowed").groupBy("run").agg(F.sum("cost").alias("_c"), F.count("*").alias("_k"))
    then = calls.where("stage = 'map'").join(spent, "run", "left").withColumn("_n", before(F.lit(1)) + F.coalesce("_k", F.lit(0))).withColumn("_s", before("cost") + F.coalesce("_c", F.lit(0)))
    then = then.withColumn("allowed", (F.col("_s") < most) & (F.col("_n") < most_calls))
    other = calls.where("stage IS NULL OR stage NOT IN ('extract', 'map')").withColumn("allowed", F.lit(False))
    return first.unionByName(then.select(first.columns)).unionByName(other.select(first.columns))


@query("H23_run_budget", """WITH c AS (SELECT user_id AS run, CASE WHEN event_type IN ('purchase', 'signup') THEN 'map' ELSE 'extract' END AS stage, event_id AS seq, 1 + event_id % 3 AS cost FROM events),
e AS (SELECT *, coalesce(sum(cost) OVER w, 0) < 20 - 6 AND row_number() OVER (PARTITION BY run ORDER BY seq) <= 12 AS allowed FROM c WHERE stage = 'extract' WINDOW w AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT run, sum(cost) AS spent, count(*) AS k FROM e WHERE allowed GROUP BY 1),
m AS (SELECT c.*, coalesce(s.spent, 0) + coalesce(sum(cost) OVER w, 0) < 20 AND coalesce(s.k, 0) + row_number() OVER (PARTITION BY run ORDER BY seq) <= 12 AS allowed FROM c LEFT JOIN s USING (run) WHERE stage = 'map' WINDOW w AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run, stage, seq, cost, allowed FROM e UNION ALL SELECT run, stage, seq, cost, allowed FROM m""")
def _h23(g):
    stage = F.when(F.col("event_type").isin("purchase", "signup"), "map").otherwise("extract")
    calls = g.events.select(F.col("user_id").alias("run"), stage.alias("stage"), F.col("event_id").alias("seq"), (1 + F.col("event_id") % 3).alias("cost"))
    return within_budget(calls, 20, 6, 12)


def priced(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Calls (model, tokens_in, tokens_out) with `cost`: the price a million tokens of the longest name that the model's begins with.

    A model without a price gets null: a cost of nought would make a budget useless.
    """
    table = F.array(*[F.struct(F.lit(len(k)).alias("n"), F.lit(k).alias("name"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in prices.items()])
    best = F.array_max(F.filter(table, lambda p: F.startswith("model", p["name"])))
    return calls.withColumn("_p", best).withColumn("cost", (F.col("tokens_in") * F.col("_p.a") + F.col("tokens_out") * F.col("_p.b")) / 1e6).drop("_p")


@query("H24_model_prices", """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'small-2' WHEN 'assistant' THEN 'small-plus-1' ELSE 'other' END AS model, round(CASE role WHEN 'user' THEN (length(text) * 1.0 + turn * 5.0) / 1e6 WHEN 'assistant' THEN (length(text) * 3.0 + turn * 15.0) / 1e6 END, 9) AS cost FROM conversations""")
def _h24(g):
    model = F.when(F.col("role") == "user", "small-2").when(F.col("role") == "assistant", "small-plus-1").otherwise("other")
    c = g.conversations.select("conv_id", "turn", model.alias("model"), F.length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    return priced(c, {"small": (1, 5), "small-plus": (3, 15)}).select("conv_id", "turn", "model", F.round("cost", 9).alias("cost"))


def schema_faults(c: Column, properties: dict[str, str], required: tuple[str, ...]) -> Column:
    """What is wrong with a JSON text, by place: no object, missing fields, wrong types (string, number, array), unknown fields."""
    v = F.try_parse_json(c)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$['{k}']", "variant"))
    types = {"string": "^STRING$", "number": "^(BIGINT|DECIMAL|DOUBLE)", "array": "^ARRAY"}
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    lacks = [F.when(~F.array_contains(keys, k), F.lit(f"$: '{k}' is missing")) for k in required]
    wrong = [F.when(F.array_contains(keys, k) & ~kind(k).rlike(types[t]), F.lit(f"$['{k}']: not of type {t}")) for k, t in properties.items()]
    odd = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, properties)))), lambda k: F.concat(F.lit("$: '"), k, F.lit("' is not allowed")))
    whole = F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("OBJECT"))
    return F.when(whole, F.concat(F.array_compact(F.array(*lacks, *wrong)), odd)).otherwise(F.array(F.lit("$: not an object")))


def repair_prompt(asked: Column, answer: Column, faults: Column, most: int = 10, chars: int = 2000) -> Column:
    """The question once more with the answer and what is wrong with it; null where nothing is."""
    listed = F.array_join(F.transform(F.slice(faults, 1, most), lambda f: F.concat(F.lit("- "), f)), "\n")
    return F.when(F.size(faults) > 0, F.concat(asked, F.lit("\n\n---\n[answer]\n"), F.substring(answer, 1, chars), F.lit("\n\n[faults]\n"), listed))


@query("H25_schema_repair", """WITH f AS (SELECT p_partkey AS id, p_name, list_filter([CASE WHEN p_partkey % 4 = 0 THEN '$: ''quote'' is missing' END, CASE WHEN p_partkey % 3 = 0 THEN '$[''size'']: not of type number' END, CASE WHEN p_partkey % 5 = 0 THEN '$: ''status'' is not allowed' END], lambda x: x IS NOT NULL) AS faults FROM part WHERE p_partkey % 7 <> 0)
SELECT id, array_to_string(faults, '; ') AS faults, CASE WHEN len(faults) > 0 THEN len('ask ' || p_name) + len('[faults]') + len(array_to_string(faults, chr(10) || '- ')) END AS chars FROM f UNION ALL SELECT p_partkey, '$: not an object', len('ask ' || p_name) + len('[faults]') + len('$: not an object') FROM part WHERE p_partkey % 7 = 0""")
def _h25(g):
    """Answers with one fault or another, one in seven no JSON; the prompt's length without its answer and frame."""
    key = F.col("p_partkey")
    size = F.when(key % 3 == 0, F.lit('"big"')).otherwise(F.col("p_size").cast("string"))
    answer = F.concat(F.lit('{"size": '), size, F.when(key % 4 != 0, F.lit(', "quote": "q"')).otherwise(""), F.when(key % 5 == 0, F.lit(', "status": [1]')).otherwise(""), F.lit("}"))
    p = g.part.select(key.alias("id"), F.concat(F.lit("ask "), "p_name").alias("asked"), F.when(key % 7 == 0, F.lit("sorry, {")).otherwise(answer).alias("answer"))
    p = p.withColumn("faults", schema_faults(F.col("answer"), {"quote": "string", "size": "number"}, ("quote",)))
    prompt = repair_prompt(F.col("asked"), F.col("answer"), F.col("faults"))
    frame = F.length("answer") + len("\n\n---\n[answer]\n") + len("\n\n") + len("\n- ")
    return p.select("id", F.array_join("faults", "; ").alias("faults"), (F.length(prompt) - frame).cast("long").alias("chars"))


def backfill(nodes: DataFrame, cached: DataFrame, field: str) -> DataFrame:
    """`nodes` (key, field, ...) with missing values of a field taken from cached items (key, at, value), the newest of a key; known ones stay.

    An item of no node makes none; `patched` tells which nodes were changed.
    """
    newest = cached.where("value IS NOT NULL").groupBy("key").agg(F.max_by("value", "at").alias("_v"))
    x = nodes.join(newest, "key", "left")
    return x.select(*[F.coalesce(field, "_v").alias(field) if c == field else F.col(c) for c in nodes.columns], (F.col(field).isNull() & F.col("_v").isNotNull()).alias("patched"))


@query("H27_backfill", """WITH n AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer), v AS (SELECT o_custkey AS key, arg_max(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT key, coalesce(segment, v) AS segment, segment IS NULL AND v IS NOT NULL AS patched FROM n LEFT JOIN v USING (key)""")
def _h27(g):
    nodes = g.customer.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    items = g.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("value"))
    return backfill(nodes, items, "segment")


def checked_brief(sections: Column, rearranged: Column, sentences: int = 2) -> Column:
    """struct<text, raw>: a rearrangement of sections' sentences if it says nothing that they don't, else their first sentences.

    Sections without a sentence give nothing; an empty rearrangement counts as none.
    """
    said = F.transform(sections, lambda s: F.coalesce(X.sentences(s), F.array().cast("array<string>")))
    new = F.coalesce(X.sentences(rearranged), F.array().cast("array<string>"))
    good = (F.size(new) > 0) & (F.size(F.array_except(new, F.flatten(said))) == 0)
    raw = F.array_join(F.filter(F.transform(said, lambda s: F.array_join(F.slice(s, 1, sentences), " ")), lambda t: t != ""), "\n")
    return F.struct(F.when(good, F.array_join(new, " ")).otherwise(raw).alias("text"), (~good).alias("raw"))


@query("Q15_checked_brief", f"""WITH d AS (SELECT doc_id, {X.SENTENCES_SQL.format('text')} AS s FROM documents), e AS (SELECT *, list_reverse(list_filter(s, lambda t: regexp_matches(t, '[.!?。]$'))) AS back FROM d)
SELECT doc_id, CASE WHEN len(back) > 0 AND doc_id % 2 = 0 THEN array_to_string(back, ' ') ELSE array_to_string(list_filter([array_to_string(s[1:2], ' '), 'One. Two.'], lambda t: t <> ''), chr(10)) END AS text, NOT (len(back) > 0 AND doc_id % 2 = 0) AS raw FROM e""")
def _q15(g):
    """The whole sentences of even documents are told backwards, which is allowed; odd ones with a sentence of the teller's own."""
    ended = F.filter(F.coalesce(X.sentences(F.col("text")), F.array().cast("array<string>")), lambda t: t.rlike("[.!?。]$"))
    s = g.documents.select("doc_id", "text", F.reverse(ended).alias("back"))
    told = F.array_join(F.when(F.col("doc_id") % 2 == 0, F.col("back")).otherwise(F.concat("back", F.array(F.lit("I made this up.")))), " ")
    b = s.select("doc_id", checked_brief(F.array("text", F.lit("One. Two. Three.")), told).alias("b"))
    return b.select("doc_id", "b.text", "b.raw")
