"""Mixing sources to target weights by temperature.

Token shares p of the sources become weights p**a / sum(p**a).  The exponent a is bisected,
six bisection steps in each Spark job over the table of sources, until the weights have the target
entropy, or until no source is repeated more often than the limit allows.  Without a budget the
total is the least for which every source is read whole once, so no document is dropped.

A source's budget is realised by whole epochs and a part of one more.  Documents fall into blocks by
hash; a seeded hash of the block's number permutes blocks in each epoch, and the part takes blocks in
that order, then small parts of the block on the border, until the budget is reached.

A repetition limit that no exponent keeps (a budget of more tokens than all sources hold at that
many epochs) and an entropy above that of equal shares are refused with an error.

Defined cases: a null source is a source of its own; texts without tokens weigh nothing and are read
once; a null text has no tokens; repeated rows fall into the same block; an empty table gives no rows;
extra columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from provena.session import durable, stored

MAX_EPOCHS = 2.0
BLOCK_TOKENS = 1 << 20
MAX_BLOCKS = 4096
PARTS = 4096
SEED = 20240611
GRID = 64
JOBS = 4
#: A plan of at most this many sources is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def tokens(c: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(c), F.lit(r"\S+")), F.lit(0)).cast("long")


def _key() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("\u0000"))


def _measure(sources: DataFrame, total: int, exponents: list[float], budget: float | None) -> list[tuple[float, float, float]]:
    """(exponent, entropy, most epochs of any source) for each exponent, in one job."""
    p = F.col("tokens") / F.lit(float(total))
    x = sources.select("tokens", F.explode(F.array(*map(F.lit, exponents))).alias("a")).withColumn("u", F.pow(p, F.col("a")))
    rows = x.groupBy("a").agg(F.sum("u").alias("z"), F.sum(F.col("u") * F.log(p)).alias("l"), F.max(F.col("u") / F.col("tokens")).alias("fast"), F.min(F.col("u") / F.col("tokens")).alias("slow")).collect()
    return sorted((r.a, math.log(r.z) - r.a * r.l / r.z, r.fast / r.slow if budget is None else budget * r.fast / r.z) for r in rows)


def exponent(sources: DataFrame, total: int, max_epochs: float | None, entropy: float | None, budget: float | None = None) -> float:
    """The largest exponent in [0, 1] with at least the target entropy, or the least within the repetition limit.

    Entropy falls and, with the largest source read least often, repetition falls too as the exponent grows.
    """
    lo, hi = 0.0, 1.0
    for _ in range(JOBS):
        grid = [lo + (hi - lo) * i / (GRID - 1) for i in range(GRID)]
        got = _measure(sources, total, grid, budget)
        good = [a for a, h, e in got if (h >= entropy - 1e-9 if entropy is not None else e <= max_epochs + 1e-9)]
        if not good and entropy is not None:
            raise ValueError(f"no weights over these sources have an entropy of {entropy}; equal ones have {got[0][1]:.6f}")
        if not good:
            raise ValueError(f"some source is read {min(e for _, _, e in got):.2f} times at least, over the limit of {max_epochs} (budget: {budget})")
        if entropy is not None:
            lo, hi = max(good), min([a for a, _, _ in got if a > max(good)], default=max(good))
        else:
            lo, hi = max([a for a, _, _ in got if a < min(good)], default=min(good)), min(good)
        if hi - lo < 1e-9:
            break
    return lo if entropy is not None else hi


def plan(docs: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """One row a source: tokens, weight, whole epochs, and the borders of the part of one more."""
    if (max_epochs is None) == (entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    # texts are read once; every later pass reads these three numbers
    d = stored(docs.select(_key().alias("k"), tokens().alias("t"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h"))).where("t > 0")
    fine = durable(d.groupBy("k", F.pmod("h", F.lit(MAX_BLOCKS)).alias("b")).agg(F.sum("t").alias("tokens")))
    sources = durable(fine.groupBy("k").agg(F.sum("tokens").alias("tokens")))
    if sources.isEmpty():
        return sources.select("k", "tokens", F.lit(0.0).alias("weight"), F.lit(0).alias("whole"), F.lit(1).alias("blocks"), F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("part"))
    whole = sources.agg(F.sum("tokens")).first()[0]
    a = exponent(sources, whole, max_epochs, entropy, budget)
    u = F.pow(F.col("tokens") / F.lit(float(whole)), F.lit(a))
    z, slow = sources.agg(F.sum(u), F.min(u / F.col("tokens"))).first()
    total = budget if budget is not None else z / slow
    s = sources.select("k", "tokens", (u / z).alias("weight"))
    s = s.withColumn("want", F.round(F.col("weight") * total).cast("long")).withColumn("whole", F.floor(F.col("want") / F.col("tokens")).cast("int"))
    s = s.withColumn("rest", F.col("want") - F.col("whole") * F.col("tokens"))
    # a power of two, so that a block is a set of the fine blocks that are already summed
    s = s.withColumn("blocks", F.least(F.lit(MAX_BLOCKS), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("tokens") / BLOCK_TOKENS))))).cast("int"))
    s = durable(s)
    # a hot source isn't moved to one task: up to BROADCAST_SOURCES rows go to the documents, beyond that AQE splits the join
    near = F.broadcast if sources.count() <= BROADCAST_SOURCES else lambda df: df
    order = lambda n: F.xxhash64(F.lit(SEED), F.col("k"), F.col("whole"), n)
    sums = fine.withColumnRenamed("tokens", "t").join(near(s), "k").withColumn("o", order(F.pmod("b", F.col("blocks")))).groupBy("k", "o", "rest").agg(F.sum("t").alias("t"))
    run = sums.withColumn("before", F.sum("t").over(Window.partitionBy("k").orderBy("o")) - F.col("t"))
    edge = durable(run.where("before < rest").groupBy("k").agg(F.max_by(F.struct("o", "before"), "o").alias("e")).select("k", F.col("e.o").alias("cut"), F.col("e.before").alias("before")))
    inside = d.join(near(s.join(near(edge), "k")), "k").where(order(F.pmod(F.pmod("h", F.lit(MAX_BLOCKS)), F.col("blocks"))) == F.col("cut"))
    part = inside.groupBy("k", _part().alias("q"), "rest", "before").agg(F.sum("t").alias("t"))
    run = part.withColumn("upto", F.sum("t").over(Window.partitionBy("k").orderBy("q")) - F.col("t") + F.col("before"))
    last = run.where("upto < rest").groupBy("k").agg(F.max("q").alias("part"))
    return s.join(edge.drop("before"), "k", "left").join(last, "k", "left").select("k", "tokens", "weight", "whole", "blocks", "cut", "part")


def _part() -> Column:
    return F.pmod(F.shiftright("h", 20), F.lit(PARTS))


def mix(docs: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """A row for each time a document is read: `docs` with n_tokens, weight, epoch, block and order_key.

    Reading by (epoch, order_key) gives a source's blocks in their permuted order.
    """
    p = durable(plan(docs, max_epochs, entropy, budget))
    if p.count() <= BROADCAST_SOURCES:  # then texts stay where they are
        p = F.broadcast(p)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    x = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], _key().alias("k"), tokens().alias("t"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h")).join(p, "k", "left")
    block = F.pmod(F.pmod("h", F.lit(MAX_BLOCKS)), F.coalesce("blocks", F.lit(1)))
    order = lambda e: F.xxhash64(F.lit(SEED), F.col("k"), e, block)
    border = order(F.col("whole"))
    more = F.coalesce((border < F.col("cut")) | ((border == F.col("cut")) & (_part() <= F.col("part"))), F.lit(False))
    times = F.when(F.col("t") > 0, F.coalesce("whole", F.lit(1)) + more.cast("int")).otherwise(F.lit(1))
    x = x.withColumn("block", block.cast("int")).withColumn("times", times).where("times > 0")
    x = x.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return x.select(*[F.col(n).alias(c) for c, n in names.items() if c not in ("n_tokens", "weight", "epoch", "block", "order_key")], F.col("t").alias("n_tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "epoch", "block", order(F.col("epoch")).alias("order_key"))


def apply(docs: DataFrame) -> DataFrame:
    """Documents as often as the mixture reads them, with their own columns."""
    names = {c: f"c{i}" if c not in ("doc_id", "source", "text") else c for i, c in enumerate(docs.columns)}
    return mix(docs.toDF(*names.values())).select(*[F.col(n).alias(c) for c, n in names.items()])
