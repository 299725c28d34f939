"""Sharding by a k-d tree over document metadata, split at distributed weighted medians.

Dimensions are the text's size (log scale), its source and its language.  A node is cut along
the dimension in which its rows spread widest, at the weighted quantile that gives each side the
bytes of its share of the leaves.  Quantiles come from radix histograms that Spark sums: a job
returns one row for each open node, whatever the number of documents.

The tree is built over atoms: a group of equal texts is one atom, under the least source and language
of its rows; only a group larger than a leaf is dealt into atoms by a hash of the id.  So groups that
fit a leaf are never cut, on the path of whole documents (`assign`) as on that of the digest.

Rows of a shard are numbered in rounds: the first copy of each row, then the second, ... up to ROUNDS,
each round in the same hashed order, so that copies of a row lie far apart.

Defined cases: a null text has size 16 and the CRC of no bytes; null metadata is a value of its
own; a null doc_id hashes like any value; rows of equal id and text stay in one leaf; an empty table
gives no rows; extra columns are kept by `assign`, but for those named shard and slot.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from provena.llm.columns import neutral, restored
from provena.session import durable

SHARDS = 40
OVERHEAD = 16
DIM_BITS, TEXT_BITS, ROW_BITS = 20, 22, 20
TIE = TEXT_BITS + ROW_BITS
#: Bit positions at which the radix histograms of a coordinate stop, from the top; below ROW_BITS only
#: groups larger than a leaf are told apart.
STEPS = (48, 30, ROW_BITS, 8, 0)
#: A bin of at most this share of a leaf's bytes is not cut any finer.
FINE = 0.01
#: Groups whose metadata differ are broadcast up to this number, joined by shuffle beyond it.
BROADCAST_GROUPS = 200_000
#: A group of at least 1 / HOT of all rows is hot; there are at most HOT of them.
HOT = 10_000
#: Rows that one task numbers, about; and rounds of copies.
PART_ROWS, ROUNDS = 200_000, 8
#: Levels of the tree between two cuts of the lineage.
LEVELS = 2
DIMS = range(3)


@dataclass
class Node:
    leaves: int
    first: int  # number of its first leaf
    dim: int = 0
    cut: int = 0


def weight(target: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(target)), F.lit(0)).cast("long") + OVERHEAD


def crc(target: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(target), F.lit("")).cast("binary"))


def _code(c: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit("\u0000"))), F.lit(1 << DIM_BITS))


def coordinates(docs: DataFrame) -> list[Column]:
    """The row's weight, its group (equal texts), its place in each dimension, and its hash."""
    has = lambda c: F.col(c) if c in docs.columns else F.lit(None)
    size = (F.log2(weight()) * F.lit((1 << DIM_BITS) / 48)).cast("long")
    group = F.xxhash64(F.coalesce("text", F.lit("")))
    return [weight().alias("_w"), group.alias("_g"), size.alias("_q0"), _code(has("source")).alias("_q1"), _code(has("lang")).alias("_q2"), F.xxhash64(F.lit(11), F.col("doc_id"), group).alias("_row")]


def _cut(df: DataFrame) -> Column:
    """Coordinates of an atom in each dimension."""
    tie = F.pmod("_g", F.lit(1 << TEXT_BITS)) * (1 << ROW_BITS) + F.when(F.col("_big"), F.pmod("_row", F.lit(1 << ROW_BITS))).otherwise(F.lit(0))
    return F.array(*[F.col(f"_q{d}") * (1 << TIE) + tie for d in DIMS])


def _table(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A small local table, at most one row a node."""
    kind = {"done": pa.float64(), "goal": pa.float64()}
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], kind.get(n, pa.int64())) for i, n in enumerate(names.split())}))


def placed_in_space(rows: DataFrame, narrow: DataFrame, leaves: int) -> tuple[DataFrame, DataFrame, int]:
    """`rows` and `narrow` with the coordinates `_c` of their atoms, and the number of rows."""
    groups = narrow.groupBy("_g", "_w").agg(F.count("*").alias("n"), *[f(f"_q{d}").alias(f"_{k}{d}") for d in (1, 2) for k, f in (("least", F.min), ("most", F.max))])
    whole, total = narrow.agg(F.sum("_w"), F.count("*")).first()
    big = F.col("n") * F.col("_w") * leaves > (whole or 0)  # at most `leaves` groups
    odd = groups.where("_least1 <> _most1 OR _least2 <> _most2").withColumn("_big", big).unionByName(groups.where("_least1 = _most1 AND _least2 = _most2").withColumn("_big", big).where("_big"))
    odd = durable(odd.select("_g", "_w", "n", "_least1", "_least2", "_big"))
    few = odd.count() <= BROADCAST_GROUPS

    def moved(df: DataFrame) -> DataFrame:
        plain = [c for c in df.columns if c not in ("_q1", "_q2")]
        if few:
            x = df.join(F.broadcast(odd.drop("n")), ["_g", "_w"], "left")
        else:  # hot groups by broadcast; their rows carry a key of their own through the shuffle
            hot = odd.where(F.col("n") * HOT >= F.lit(total)).drop("n").toDF("_g", "_w", "_h1", "_h2", "_hbig")
            x = df.join(F.broadcast(hot), ["_g", "_w"], "left")
            x = x.withColumn("_key", F.when(F.col("_h1").isNull(), F.col("_g")).otherwise(F.col("_row"))).withColumn("_kw", F.when(F.col("_h1").isNull(), F.col("_w")).otherwise(F.lit(-1).cast("long")))
            x = x.join(odd.drop("n").withColumnsRenamed({"_g": "_key", "_w": "_kw"}), ["_key", "_kw"], "left")
            x = x.withColumns({"_least1": F.coalesce("_h1", "_least1"), "_least2": F.coalesce("_h2", "_least2"), "_big": F.coalesce("_hbig", "_big")})
        x = x.withColumns({"_q1": F.coalesce("_least1", "_q1"), "_q2": F.coalesce("_least2", "_q2"), "_big": F.coalesce("_big", F.lit(False))})
        return x.select(*plain, _cut(x).alias("_c"))

    small = moved(narrow)
    return (small if rows is narrow else moved(rows)), small, total


def _choose(at: DataFrame, level: list[Node]) -> None:
    """Cut every node of the level along its widest dimension."""
    spark, by = at.sparkSession, {n.first: n for n in level}
    top = STEPS[0]
    # the first histogram is taken in all dimensions, together with what chooses one of them
    bins = at.select("_node", "_w", F.posexplode("_c").alias("d", "c")).groupBy("_node", "d", F.shiftright("c", top).alias("_b")).agg(
        F.sum("_w").alias("w"), F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    over = Window.partitionBy("_node", "d")
    leaves = _table(spark, "_node leaves", [(n.first, n.leaves) for n in level])
    run = bins.withColumns({"upto": F.sum("w").over(over.orderBy("_b")), "all": F.sum("w").over(over)}).join(F.broadcast(leaves), "_node")
    goal_of = F.col("all") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    stats = run.groupBy("_node", "d").agg(F.max("all").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by(F.struct("_b", "w", "n", "upto"), F.when(F.col("upto") >= goal_of, F.col("_b"))).alias("x")).collect()
    lo, hi = ({d: f((getattr(r, k) >> TIE for r in stats if r.d == d), default=0) for d in DIMS} for f, k in ((min, "lo"), (max, "hi")))
    spread, first, goal, done, prefix = {}, {}, {}, {}, {}
    for r in stats:
        k, n = r._node, by[r._node]
        wide = (((r.hi >> TIE) - (r.lo >> TIE)) / max(1, hi[r.d] - lo[r.d]), -r.d)
        if k not in spread or wide > spread[k]:
            spread[k], first[k], n.dim = wide, r.x, r.d
            goal[k] = r.w * (n.leaves // 2) / n.leaves
    for n in level:  # nodes without rows send everything low
        n.cut = 1 << 62
    live = set(first)

    def settle(k: int, x, shift: int) -> None:
        """Take the bin in which node k's goal lies; stop where it need not be cut finer."""
        n = by[k]
        prefix[k], done[k] = x._b, x.upto - x.w
        n.cut = ((x._b + 1) << shift) - 1
        if shift == 0 or x.n == 1 or x.w <= FINE * goal[k] / max(1, n.leaves // 2):
            if goal[k] - done[k] < x.upto - goal[k]:  # nearer without the bin
                n.cut = (x._b << shift) - 1
            live.discard(k)

    for k in list(live):
        settle(k, first[k], top)
    for shift in STEPS[1:]:
        if not live:
            return
        open_ = _table(spark, "_node d p done goal", [(k, by[k].dim, prefix[k], float(done[k]), float(goal[k])) for k in live])
        x = at.join(F.broadcast(open_), "_node").withColumn("c", F.expr("_c[d]")).where(F.shiftright("c", top) == F.col("p"))
        bins = x.groupBy("_node", "done", "goal", F.shiftright("c", shift).alias("_b")).agg(F.sum("_w").alias("w"), F.count("*").alias("n"))
        run = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("_node").orderBy("_b")) + F.col("done"))
        for r in run.where("upto >= goal").groupBy("_node").agg(F.min_by(F.struct("_b", "w", "n", "upto"), "_b").alias("x")).collect():
            settle(r._node, r.x, shift)
        top = shift


def _descend(df: DataFrame, level: list[Node]) -> DataFrame:
    """Move `_node` of each row to the half of its node that holds it; a level has at most as many nodes as leaves."""
    cuts = _table(df.sparkSession, "_node d cut high", [(n.first, n.dim, n.cut, n.first + n.leaves // 2) for n in level])
    x = df.join(F.broadcast(cuts), "_node", "left")
    plain = [c for c in df.columns if c != "_node"]
    return x.select(*plain, F.expr("CASE WHEN _c[coalesce(d, 0)] > cut THEN high ELSE _node END AS _node"))


def build(atoms: DataFrame, leaves: int) -> list[list[Node]]:
    """The levels of the tree over atoms with `_c` and `_w` (bytes)."""
    at, level, tree = atoms.withColumn("_node", F.lit(0).cast("long")), [Node(leaves, 0)], []
    while level := [n for n in level if n.leaves > 1]:
        _choose(at, level)
        tree.append(level)
        at = _descend(at, level)
        level = [Node(k, f) for n in level for k, f in ((n.leaves // 2, n.first), (n.leaves - n.leaves // 2, n.first + n.leaves // 2))]
        if len(tree) % LEVELS == 0 and any(n.leaves > 1 for n in level):
            at = durable(at)
    return tree


def _shards(df: DataFrame, tree: list[list[Node]], sub: int) -> DataFrame:
    """`df` with `_shard` and the part of it in which a row is numbered."""
    x = df.withColumn("_node", F.lit(0).cast("long"))
    for level in tree:
        x = _descend(x, level)
    return x.withColumn("_shard", F.col("_node").cast("int")).withColumn("_sub", F.pmod(F.xxhash64(F.lit(5), "_row"), F.lit(sub)).cast("int")).drop("_node", "_c")


def leaves_for(docs: DataFrame, target_bytes: int) -> int:
    total = docs.agg(F.sum(weight())).first()[0] or 0
    return max(1, round(total / target_bytes))


def _numbered(rows: DataFrame, narrow: DataFrame, leaves: int) -> DataFrame:
    """`rows` with `_shard` and `_slot`; both have the columns of `coordinates`.

    A part of a shard is numbered on its own and starts where the one before it ends.
    """
    rows, narrow, total = placed_in_space(rows, narrow, leaves)
    tree = build(durable(narrow.groupBy("_c").agg(F.sum("_w").alias("_w"))), leaves)
    sub = max(1, -(-total // (leaves * PART_ROWS)))
    round_of = lambda c: F.least(c, F.lit(ROUNDS)).cast("int")
    copies = _shards(narrow, tree, sub).groupBy("_shard", "_sub", "_row").agg(F.count("*").alias("n"))
    # rounds below the last hold one copy each, the last all that are left
    rounds = copies.select("_shard", "_sub", "n", F.explode(F.sequence(F.lit(1), round_of(F.col("n")))).alias("_round"))
    count = rounds.groupBy("_shard", "_round", "_sub").agg(F.sum(F.when(F.col("_round") < ROUNDS, F.lit(1)).otherwise(F.col("n") - (ROUNDS - 1))).alias("n"))
    start = count.select("_shard", "_round", "_sub", (F.sum("n").over(Window.partitionBy("_shard").orderBy("_round", "_sub")) - F.col("n")).alias("_start"))
    # copies of a row are in one part, so copies and places need one shuffle by (shard, part)
    x = _shards(rows, tree, sub).repartition("_shard", "_sub")
    x = x.withColumn("_copy", F.row_number().over(Window.partitionBy("_shard", "_sub", "_row").orderBy("_g"))).withColumn("_round", round_of(F.col("_copy")))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("_shard", "_sub", "_round").orderBy(F.xxhash64(F.greatest("_copy", F.lit(ROUNDS)), "_row"), "_row")))
    # at most leaves * sub * ROUNDS starts: ROUNDS for every PART_ROWS rows, or for a leaf
    return x.join(F.broadcast(start), ["_shard", "_round", "_sub"]).withColumn("_slot", F.col("_start") + F.col("_n") - 1)


def assign(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """`docs` with `shard` and `slot` (gapless from 0 in each shard).

    Give a number of shards, or None and the bytes that a shard shall have.
    """
    plain = neutral(docs)
    narrow = durable(plain.select(*coordinates(plain)))
    out = _numbered(plain.select("*", *coordinates(plain)), narrow, shards or leaves_for(plain, target_bytes))
    out = out.select(*plain.columns, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
    return restored(out, docs, ("shard", "slot"))


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shards of all rows, from narrow rows without the texts."""
    rows = durable(docs.select("doc_id", crc().alias("text_crc32"), *coordinates(docs)))
    out = _numbered(rows, rows, shards)
    return out.select(
        "doc_id", F.col("_w").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

