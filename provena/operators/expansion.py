"""Expansion of many nodes at once under budgets, for an interface that shows a growing picture.

`one_hop` is a click on a node: its neighbours up to what is left of the picture's budget.  `neighbourhood` is a node's page: neighbours by name,
then their neighbours while there is room, then the edges among all of them.  Seeds are rows, so a thousand clicks are one job.  Every cut is a
window over (seed) or (node) that Spark prunes before the shuffle, or of arrays that are short, so a node with millions of neighbours sends on a few dozen of them.

Defined cases: neighbours are in order of key and label; a loop at a node is no neighbour, but counts as a row; repeated edges count once; a seed that is
no node, or whose budget is used up, has an empty picture; more than one hop is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from provena.operators.common import looked_up, top_per_group
from provena.registry import query
from provena.session import run_folder, scratch, stored

# Nodes of one expansion, of all expansions of a picture, of a page, and edges of a picture.
CAP, BUDGET, PAGE, EDGES = 30, 150, 24, 160


def both_ways(edges: DataFrame) -> DataFrame:
    """(label, key, other_label, other_key, type, out) of distinct edges from both ends."""
    e = edges.select("type", "from_label", "from_key", "to_label", "to_key").distinct()
    ends = lambda out, a, b: F.struct(F.col(f"{a}_label").alias("label"), F.col(f"{a}_key").alias("key"), F.col(f"{b}_label").alias("other_label"), F.col(f"{b}_key").alias("other_key"), "type", F.lit(out).alias("out"))
    return e.select(F.inline(F.array(ends(True, "from", "to"), ends(False, "to", "from"))))


def one_hop(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(seed, nodes, edges, truncated) for `seeds` (seed, label, key, already): structs of the new nodes and of the edges that reach them.

    Twice the budget of rows is looked at, as many nodes as the budget are taken.
    """
    if hops != 1:
        raise ValueError("one hop at a time")
    budget = F.greatest(F.lit(0), F.least(F.lit(CAP), F.lit(BUDGET) - F.greatest("already", F.lit(0))))
    s = seeds.withColumn("budget", budget)
    order = [F.col("other_key"), F.col("other_label"), F.col("type"), F.col("out")]
    near = top_per_group(both_ways(edges), ["label", "key"], order, 2 * CAP)  # as many as any seed may look at
    x = s.where("budget > 0").join(near, ["label", "key"]).where("rn <= 2 * budget")
    loop = (F.col("other_key") == F.col("key")) & (F.col("other_label") == F.col("label"))
    rank = F.dense_rank().over(Window.partitionBy("seed", loop).orderBy("other_key", "other_label"))
    x = x.withColumn("n", F.when(~loop, rank))
    kept = F.col("n") <= F.col("budget")
    far = F.struct(F.col("other_key").alias("key"), F.col("other_label").alias("label"))
    ends = [F.when(F.col("out"), F.col(a)).otherwise(F.col(b)) for a, b in (("key", "other_key"), ("other_key", "key"))]
    edge = F.struct("n", ends[0].alias("from_key"), ends[1].alias("to_key"), "type")
    g = x.groupBy("seed").agg(F.array_sort(F.collect_set(F.when(kept, far))).alias("nodes"), F.slice(F.array_sort(F.collect_set(F.when(kept, edge))), 1, EDGES).alias("edges"), F.count("*").alias("rows"))
    out = s.select("seed", "budget").join(g, "seed", "left")
    none = lambda c: F.coalesce(F.col(c), F.filter(F.col(c), lambda v: F.lit(False)), F.array().cast(dict(g.dtypes)[c]))
    return out.select("seed", none("nodes").alias("nodes"), none("edges").alias("edges"), (F.coalesce("rows", F.lit(0)) > F.coalesce(F.size("nodes"), F.lit(0))).alias("more"), "budget").select("seed", "nodes", "edges", (F.col("more") | (F.col("budget") == 0)).alias("truncated"))


def _structs(kind: str) -> str:
    return f"array<struct<{kind}>>"


#: Nodes in order of name, and edges in the order in which a page shows them.
_NODE, _EDGE = "key string, label string", "from_key string, to_key string, type string, from_label string, to_label string"


def _none(kind: str) -> Column:
    return F.lit(None).cast(_structs(kind))


def _neighbours() -> Column:
    """The other ends of a node's `es`, in order, each once; loops are none."""
    far = F.filter("es", lambda x: (x.other_key != F.col("key")) | (x.other_label != F.col("label")))
    return F.array_distinct(F.transform(far, lambda x: F.struct(x.other_key.alias("key"), x.other_label.alias("label"))))


def pages(edges: DataFrame, nodes: DataFrame, limit: int = PAGE) -> DataFrame:
    """(label, key, first, two, edges) for distinct `nodes` (label, key): neighbours, their neighbours while there is room, and the edges among all of these.

    A page is one row of arrays all the way.  Of any neighbour the first `limit` names but the node's own are enough: at most as many of them as
    there are neighbours are known, and what is left fills the room.  The edges inside are looked up without pairs: each edge lies with one end that has
    few neighbours, `from` first, so every node has a short list, and edges between two nodes of many are a table of their own.
    Pages that show the same but for their node are looked up once.
    """
    spark, node = edges.sparkSession, ["label", "key"]
    keep = [f"{run_folder(spark)}/table-{uuid.uuid4().hex[:12]}" for _ in range(2)]
    with scratch(spark):
        e = edges.select("type", "from_label", "from_key", "to_label", "to_key")
        ends = lambda out, a, b: F.struct(F.col(f"{a}_label").alias("label"), F.col(f"{a}_key").alias("key"), F.col(f"{b}_key").alias("other_key"), F.col(f"{b}_label").alias("other_label"), "type", F.lit(out).alias("out"))
        loop = (F.col("label") == F.col("other_label")) & (F.col("key") == F.col("other_key"))
        ways = e.select(F.inline(F.array(ends(True, "from", "to"), ends(False, "to", "from")))).where(~loop | F.col("out"))
        # a loop comes first, then the neighbours: one more than a node of few has
        rank = F.dense_rank().over(Window.partitionBy(*node).orderBy(F.when(loop, 0).otherwise(1), "other_key", "other_label"))
        near = ways.withColumn("rn", rank).where(F.col("rn") <= limit + 3).groupBy(*node)
        near = stored(near.agg(F.sort_array(F.collect_set(F.struct("other_key", "other_label", "type", "out"))).alias("es")))
        hubs = stored(near.where(F.size(_neighbours()) > limit + 1).select(node))

        marked = e
        for end in ("from", "to"):
            many = hubs.select(F.col("label").alias(f"{end}_label"), F.col("key").alias(f"{end}_key"), F.lit(True).alias(f"{end}_hub"))
            marked = looked_up(marked, many, [f"{end}_label", f"{end}_key"], "left")
        edge = F.struct("from_key", "to_key", "type", "from_label", "to_label")
        at = lambda c: F.when(F.col("from_hub").isNull(), F.col(f"from_{c}")).otherwise(F.col(f"to_{c}"))
        lists = marked.where("from_hub IS NULL OR to_hub IS NULL").groupBy(at("label").alias("label"), at("key").alias("key")).agg(F.collect_set(edge).alias("es"))
        between = stored(marked.where("from_hub AND to_hub").select(e.columns).distinct())

        own = nodes.select(node).join(near, node, "left").withColumn("ns", F.slice(F.coalesce(_neighbours(), F.array().cast(_structs(_NODE))), 1, limit))
        mine = F.filter("es", lambda x: (x.other_key == F.col("key")) & (x.other_label == F.col("label")) | F.array_contains("ns", F.struct(x.other_key.alias("key"), x.other_label.alias("label"))))
        k, o = F.col("key"), F.col("label")
        turned = F.transform(mine, lambda x: F.struct(*[F.when(x.out, y).otherwise(z).alias(c) for y, z, c in ((k, x.other_key, "from_key"), (x.other_key, k, "to_key"), (x.type, x.type, "type"), (o, x.other_label, "from_label"), (x.other_label, o, "to_label"))]))
        own = stored(own.select("label", "key", F.col("ns").alias("first"), F.coalesce(turned, F.array().cast(_structs(_EDGE))).alias("own")))

        ask = own.where(F.size("first") < limit).select(F.col("label").alias("of_label"), F.col("key").alias("of_key"), F.inline("first"))
        far = F.filter("ns", lambda n: (n["key"] != F.col("of_key")) | (n["label"] != F.col("of_label")))
        met = ask.join(near.select(*node, F.slice(_neighbours(), 1, limit + 1).alias("ns")).hint("merge"), node).select(F.col("of_label").alias("label"), F.col("of_key").alias("key"), _none(_NODE).alias("first"), _none(_EDGE).alias("own"), F.slice(far, 1, limit).alias("far"))
        both = own.withColumn("far", _none(_NODE)).unionByName(met).groupBy(*node).agg(F.first("first", True).alias("first"), F.first("own", True).alias("own"), F.flatten(F.collect_list("far")).alias("far"))
        both = both.withColumn("two", F.slice(F.array_except(F.sort_array("far"), "first"), 1, F.lit(limit) - F.size("first"))).drop("far")
        rest = F.concat("first", "two")
        both = stored(both.withColumn("page", F.unhex(F.sha2(F.to_json(rest).cast("binary"), 256))), keep[0])

        shown = both.where(F.size(rest) > 0).groupBy("page").agg(F.first(rest).alias("rest"))
        shown = stored(shown.withColumn("n", F.monotonically_increasing_id()))  # a short key for the many rows that follow
        asked = shown.select("n", F.inline("rest"))
        few = asked.join(lists.hint("merge"), node).select("n", _none(_NODE).alias("rest"), "es")
        hs = looked_up(asked, hubs, node).groupBy("n").agg(F.collect_set(F.struct(*node)).alias("hs"))
        hs = hs.select("n", "hs", F.explode("hs").alias("a")).select("n", "a", F.explode("hs").alias("b")).select("n", *[F.col(f"{x}.{c}").alias(f"{end}_{c}") for x, end in (("a", "from"), ("b", "to")) for c in node])
        many = looked_up(hs, between, e.columns[1:]).select("n", _none(_NODE).alias("rest"), F.array(edge).alias("es"))
        found = shown.withColumn("es", _none(_EDGE)).unionByName(few, True).unionByName(many, True).groupBy("n").agg(F.first("page", True).alias("page"), F.first("rest", True).alias("rest"), F.flatten(F.collect_list("es")).alias("es"))
        inside = lambda x, end: F.array_contains("rest", F.struct(x[f"{end}_key"].alias("key"), x[f"{end}_label"].alias("label")))
        found = stored(found.select("page", F.filter("es", lambda x: inside(x, "from") & inside(x, "to")).alias("es")), keep[1])
    all_edges = F.concat("own", F.coalesce("es", F.array().cast(_structs(_EDGE))))
    return both.join(found.hint("merge"), "page", "left").select("label", "key", "first", "two", F.slice(F.sort_array(all_edges), 1, EDGES).alias("edges"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, limit: int = PAGE) -> DataFrame:
    """(seed, node rows and edge rows) for `seeds` (seed, label, key): kind 'node' with its hop, kind 'edge' with both ends."""
    p = seeds.select("seed", "label", "key").join(pages(edges, seeds.select("label", "key").distinct(), limit).hint("merge"), ["label", "key"])
    at = lambda c, hop: F.transform(c, lambda n: F.struct(n["label"].alias("label"), n["key"].alias("key"), F.lit(hop).alias("hop")))
    nodes, none = [at(F.array(F.struct("label", "key")), 0), at("first", 1), at("two", 2)], F.lit(None).cast("string")
    as_node = p.select("seed", F.lit("node").alias("kind"), F.inline(F.concat(*nodes))).withColumns({"type": none, "to_key": none})
    as_edge = p.select("seed", F.explode("edges").alias("e")).select("seed", F.lit("edge").alias("kind"), F.col("e.from_label").alias("label"), F.col("e.from_key").alias("key"), F.lit(None).cast("int").alias("hop"), "e.type", "e.to_key")
    return as_node.unionByName(as_edge)


_NODES_SQL = "SELECT from_label AS label, from_key AS key FROM edge UNION SELECT to_label, to_key FROM edge"
_WAYS_SQL = "SELECT from_label AS label, from_key AS key, to_label AS other_label, to_key AS other_key, type, true AS out FROM e UNION ALL SELECT to_label, to_key, from_label, from_key, type, false FROM e"


def every_node(g) -> DataFrame:
    return g.edge.select(F.col("from_label").alias("label"), F.col("from_key").alias("key")).unionByName(g.edge.select(F.col("to_label").alias("label"), F.col("to_key").alias("key"))).distinct()


@query("G4_capped_expand", f"""
WITH e AS (SELECT DISTINCT * FROM edge), w AS ({_WAYS_SQL}), s AS (SELECT label, key, least(30, 150 - length(key) % 3 * 74) AS budget FROM ({_NODES_SQL})),
x AS (SELECT s.*, w.other_label, w.other_key, w.type, w.out, row_number() OVER (PARTITION BY s.label, s.key ORDER BY other_key, other_label, type, out) AS rn FROM s JOIN w USING (label, key)),
y AS (SELECT *, dense_rank() OVER (PARTITION BY label, key ORDER BY other_key, other_label) AS n FROM x WHERE rn <= 2 * budget),
z AS (SELECT label, key, count(*) AS rows, count(DISTINCT other_label || other_key) FILTER (n <= budget) AS nodes, least(160, count(DISTINCT other_key || type || out) FILTER (n <= budget)) AS edges, max(other_key) FILTER (n <= budget) AS last FROM y GROUP BY 1, 2)
SELECT label, key, nodes, edges, last, rows > nodes AS truncated FROM z""")
def _g4(g):
    """A click on each node of the graph, in pictures that hold 0, 74 or 148 nodes already."""
    seeds = every_node(g).withColumn("already", F.length("key") % 3 * 74).withColumn("seed", F.struct("label", "key"))
    x = one_hop(g.edge, seeds)
    return x.select("seed.label", "seed.key", F.size("nodes").cast("long").alias("nodes"), F.size("edges").cast("long").alias("edges"), F.array_max(F.transform("nodes", lambda n: n["key"])).alias("last"), "truncated")


@query("G5_two_hop_neighbourhood", f"""
WITH e AS (SELECT DISTINCT * FROM edge), w AS (SELECT DISTINCT label, key, other_label, other_key FROM ({_WAYS_SQL})), s AS (SELECT label, key FROM ({_NODES_SQL}) WHERE label <> 'Deal'),
a AS (SELECT * FROM (SELECT s.label AS sl, s.key AS sk, w.other_label AS label, w.other_key AS key, row_number() OVER (PARTITION BY s.label, s.key ORDER BY other_key, other_label) AS n FROM s JOIN w USING (label, key)) WHERE n <= 24),
k AS (SELECT sl, sk, label, key, 1 AS hop FROM a UNION ALL SELECT label, key, label, key, 0 FROM s), r AS (SELECT sl, sk, 24 - count(*) AS room FROM a GROUP BY 1, 2),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, key ORDER BY other_key, other_label) AS cut FROM w) WHERE cut <= 60),
b AS (SELECT DISTINCT sl, sk, room, c.other_label AS label, c.other_key AS key FROM a JOIN r USING (sl, sk) JOIN c USING (label, key) WHERE room > 0),
t AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY sl, sk ORDER BY key, label) AS n FROM b ANTI JOIN k USING (sl, sk, label, key)) WHERE n <= room),
v AS (SELECT * FROM k UNION ALL SELECT sl, sk, label, key, 2 FROM t),
i AS (SELECT x.sl, x.sk, count(*) AS edges FROM v x JOIN e ON e.from_label = x.label AND e.from_key = x.key JOIN v y ON y.sl = x.sl AND y.sk = x.sk AND e.to_label = y.label AND e.to_key = y.key GROUP BY 1, 2)
SELECT sl AS label, sk AS key, count(*) FILTER (hop = 1) AS first, count(*) FILTER (hop = 2) AS second, max(v.key) FILTER (hop = 2) AS last, least(160, any_value(edges)) AS edges FROM v JOIN i USING (sl, sk) GROUP BY 1, 2""")
def _g5(g):
    """The page of every node but deals: its 24 nodes in two hops and the edges among them."""
    p = pages(g.edge, every_node(g).where("label <> 'Deal'"))
    n = lambda c: F.size(c).cast("long")
    return p.select("label", "key", n("first").alias("first"), n("two").alias("second"), F.array_max(F.transform("two", lambda x: x["key"])).alias("last"), n("edges").alias("edges"))
