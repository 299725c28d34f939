"""Order-dependent selection over bounded candidates, one pandas group a question.

Candidates are cut to a stated pool in Spark first, so a group never holds more than the pool.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from provena.operators.common import top_per_group
from provena.operators.selection import _HITS_SQL, found
from provena.registry import query

POOL, LIMIT = 140, 24


def balanced(rows: list[tuple], limit: int) -> list:
    """One id of each group in turn, then deeper, without repeats; rows are (group, id) in order."""
    queues: dict = defaultdict(list)
    for group, i in rows:
        queues[group].append(i)
    out, seen = [], set()
    while queues and len(out) < limit:
        for group in list(queues):
            while queues[group] and queues[group][0] in seen:
                queues[group].pop(0)
            if not queues[group]:
                del queues[group]
                continue
            if len(out) < limit:
                i = queues[group].pop(0)
                seen.add(i)
                out.append(i)
    return out


def rotated(rows: list[tuple], limit: int) -> list:
    """Best scores first; among equal scores the least used group, then the least used source, then order."""
    taken_g: dict = defaultdict(int)
    taken_s: dict = defaultdict(int)
    left, out = list(rows), []
    while left and len(out) < limit:
        best = max(r[1] for r in left)
        pick = min((r for r in left if r[1] == best), key=lambda r: (taken_g[r[2]], taken_s[r[3]], r[4]))
        left.remove(pick)
        taken_g[pick[2]] += 1
        taken_s[pick[3]] += 1
        out.append(pick[0])
    return out


def grow(nodes: dict, edges: list[tuple], most: int = 50) -> list:
    """A connected subgraph: focal nodes, then the best ranked neighbour of what is in; a new seed comes with a partner."""
    near: dict = defaultdict(set)
    for a, b in edges:
        if a in nodes and b in nodes and a != b:
            near[a].add(b)
            near[b].add(a)
    key = lambda n: (nodes[n], -len(near[n]), n)
    out = [n for n in sorted(nodes, key=key) if nodes[n] == 0 and near[n]][:most]
    while len(out) < most:
        edge = {m for n in out for m in near[n]} - set(out)
        if edge:
            out.append(min(edge, key=key))
            continue
        rest = [n for n in nodes if n not in out and near[n]]
        if not rest or len(out) + 2 > most:
            break
        seed = min(rest, key=key)
        out += [seed, min(near[seed], key=key)]
    return out


def _candidates(g) -> DataFrame:
    """(question, doc_id, source, score): evidence for each benchmark item by its first words, at most POOL each."""
    hit = found(g).join(g.evidence.select("doc_id", "source", "lang"), "doc_id")
    return top_per_group(hit, ["item_id"], [F.desc("score"), F.col("doc_id")], POOL)


_CAND_SQL = f"""{_HITS_SQL},
cand AS (SELECT * FROM (SELECT h.item_id, h.doc_id, h.score, v.source, v.lang, row_number() OVER (PARTITION BY h.item_id ORDER BY h.score DESC, h.doc_id) AS rn FROM hit h JOIN evidence v USING (doc_id)) WHERE rn <= {POOL})"""


# candidates are there once, so a round takes the next depth of each group
@query("W6_balanced_pool", f"""WITH {_CAND_SQL},
d AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY rn) AS depth, min(rn) OVER (PARTITION BY item_id, source) AS head FROM cand)
SELECT item_id, doc_id, pos FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY depth, head) - 1 AS pos FROM d) WHERE pos < {LIMIT}""")
def _w6(g):
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        ids = balanced(list(zip(pdf.source, pdf.doc_id, strict=True)), LIMIT)
        return pd.DataFrame({"item_id": pdf.item_id.iloc[0], "doc_id": ids, "pos": range(len(ids))})

    return _candidates(g).groupBy("item_id").applyInPandas(pick, "item_id long, doc_id long, pos long")


@query("W7_tie_rotation", f"""WITH RECURSIVE {_CAND_SQL},
r AS (
  SELECT DISTINCT item_id, 0 AS n, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS ls, CAST([] AS VARCHAR[]) AS ss FROM cand
  UNION ALL
  SELECT item_id, n + 1, list_append(ids, doc_id), list_append(ls, lang), list_append(ss, source) FROM (
    SELECT r.*, c.doc_id, c.lang, c.source, row_number() OVER (PARTITION BY r.item_id ORDER BY round(c.score, 1) DESC, len(list_filter(r.ls, lambda x: x = c.lang)), len(list_filter(r.ss, lambda x: x = c.source)), c.rn) AS k
    FROM r JOIN cand c USING (item_id) WHERE r.n < {LIMIT} AND NOT list_contains(r.ids, c.doc_id)) WHERE k = 1),
last AS (SELECT item_id, arg_max(ids, n) AS ids FROM r GROUP BY 1)
SELECT item_id, unnest(ids) AS doc_id, unnest(range(0, len(ids))) AS pos FROM last WHERE len(ids) > 0""")
def _w7(g):
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        ids = rotated(list(zip(pdf.doc_id, pdf.tier, pdf.lang, pdf.source, pdf.rn, strict=True)), LIMIT)
        return pd.DataFrame({"item_id": pdf.item_id.iloc[0], "doc_id": ids, "pos": range(len(ids))})

    return _candidates(g).withColumn("tier", F.round("score", 1)).groupBy("item_id").applyInPandas(pick, "item_id long, doc_id long, pos long")


def select(rows: list[tuple], limit: int = LIMIT, share: float = 0.25) -> list:
    """Final evidence: a small pool as it is; else a reserved share for rare and raw rows, then the best graph rows, then what is left.

    Rows are (id, score, is_rare, order).
    """
    if len(rows) <= limit:
        return [r[0] for r in rows]
    best = sorted(rows, key=lambda r: (-r[1], r[3]))
    kept = max(3, int(share * limit))
    rare = [r[0] for r in best if r[2]][:kept]
    graph = [r[0] for r in best if not r[2]][: limit - len(rare)]
    out = rare + graph
    return out + [r[0] for r in best if r[0] not in set(out)][: limit - len(out)]


@query("L7_final_selection", f"""WITH {_CAND_SQL},
b AS (SELECT *, lang <> 'en' AS rare, count(*) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rn) AS best, row_number() OVER (PARTITION BY item_id, lang <> 'en' ORDER BY score DESC, rn) AS own FROM cand),
k AS (SELECT *, least(6, count(*) FILTER (rare) OVER (PARTITION BY item_id)) AS rares FROM b),
o AS (SELECT *, CASE WHEN n <= {LIMIT} THEN 0 WHEN rare AND own <= 6 THEN 0 WHEN NOT rare AND own <= {LIMIT} - rares THEN 1 ELSE 2 END AS part FROM k)
SELECT item_id, doc_id, pos FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY part, CASE WHEN n <= {LIMIT} THEN rn ELSE best END) - 1 AS pos FROM o) WHERE pos < {LIMIT}""")
def _l7(g):
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        ids = select(list(zip(pdf.doc_id, pdf.score, pdf.lang != "en", pdf.rn, strict=True)))
        return pd.DataFrame({"item_id": pdf.item_id.iloc[0], "doc_id": ids, "pos": range(len(ids))})

    return _candidates(g).groupBy("item_id").applyInPandas(pick, "item_id long, doc_id long, pos long")


@query("G1_subgraph_builder", """WITH RECURSIVE e AS (SELECT industry, domain, need, count(*) AS n FROM has_need JOIN domain USING (nationkey) JOIN industry USING (regionkey) GROUP BY 1, 2, 3),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY n DESC, domain, need) AS rn FROM e) WHERE rn <= 120),
w AS (SELECT industry, 'd' || domain AS a, 'n' || need AS b FROM t UNION SELECT industry, 'n' || need, 'd' || domain FROM t),
v AS (SELECT w.industry, a AS node, list(b) AS near, count(*) AS degree, CASE WHEN a[1] = 'n' THEN 2 WHEN a = 'd' || f.domain THEN 0 ELSE 1 END AS rank FROM w JOIN (SELECT industry, domain FROM t WHERE rn = 1) f USING (industry) GROUP BY w.industry, a, f.domain),
u AS (SELECT v.*, (SELECT arg_min(p.node, (p.rank, -p.degree, p.node)) FROM v p WHERE p.industry = v.industry AND list_contains(v.near, p.node)) AS partner FROM v),
g AS (
  SELECT industry, list(node) AS ns, 1 AS step FROM v WHERE rank = 0 GROUP BY 1
  UNION ALL
  SELECT industry, CASE WHEN linked THEN list_append(ns, node) ELSE list_append(list_append(ns, node), partner) END, step + 1 FROM (
    SELECT g.industry, g.ns, g.step, u.node, u.partner, len(list_intersect(u.near, g.ns)) > 0 AS linked, row_number() OVER (PARTITION BY g.industry ORDER BY len(list_intersect(u.near, g.ns)) = 0, u.rank, -u.degree, u.node) AS k
    FROM g JOIN u USING (industry) WHERE len(g.ns) < 50 AND NOT list_contains(g.ns, u.node)) WHERE k = 1 AND (linked OR len(ns) + 2 <= 50)),
last AS (SELECT industry, arg_max(ns, step) AS ns FROM g GROUP BY 1)
SELECT industry, x[1] AS kind, substr(x, 2) AS key, pos FROM (SELECT industry, unnest(ns) AS x, unnest(range(0, len(ns))) AS pos FROM last)""")
def _g1(g):
    """Subgraphs of at most 50 nodes around each industry, from its 60 best connected needs and capabilities."""
    e = g.has_need.join(g.domain, "nationkey").join(g.industry, "regionkey").groupBy("industry", "domain", "need").agg(F.count("*").alias("n"))
    top = top_per_group(e, ["industry"], [F.desc("n"), F.col("domain"), F.col("need")], 120)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        nodes = {("d", x): 1 for x in pdf.domain} | {("n", x): 2 for x in pdf.need}
        nodes["d", pdf.domain.iloc[0]] = 0
        out = grow(nodes, [(("d", d), ("n", n)) for d, n in zip(pdf.domain, pdf.need, strict=True)])
        return pd.DataFrame({"industry": pdf.industry.iloc[0], "kind": [k for k, _ in out], "key": [x for _, x in out], "pos": range(len(out))})

    return top.groupBy("industry").applyInPandas(build, "industry string, kind string, key string, pos long")
