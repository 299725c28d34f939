"""Building blocks that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def names(c: str | Column) -> Column:
    """Distinct values in order, joined: the stable form of a collected set."""
    return F.array_join(F.sort_array(F.collect_set(c)), "|")


def ordered_list(order: str, value: str) -> Column:
    """Values collected in the order of another column."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each group; Spark keeps n candidates a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def capped(ids: Column, n: int) -> Column:
    """Ordered distinct of an array without nulls, cut to n."""
    return F.slice(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())), 1, n)


def expand(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Undirected one-hop edges around keys(label, key).

    Two equi joins in place of one with OR, which no hash or merge join could run.
    """
    out = edges.join(keys.select(F.col("label").alias("from_label"), F.col("key").alias("from_key")), ["from_label", "from_key"], "left_semi")
    back = edges.join(keys.select(F.col("label").alias("to_label"), F.col("key").alias("to_key")), ["to_label", "to_key"], "left_semi")
    cols = ["type", "from_label", "from_key", "to_label", "to_key"]
    return out.select(cols).unionByName(back.select(cols)).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(label, key, degree) over both ends."""
    ends = edges.select(F.col("from_label").alias("label"), F.col("from_key").alias("key")).unionAll(edges.select("to_label", "to_key"))
    return ends.groupBy("label", "key").agg(F.count("*").alias("degree"))


#: Rows up to which a table that is looked up is broadcast; beyond that both sides are dealt by their key.
LOOKUP = 50_000


def looked_up(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """`rows` with the matching rows of `table`, an inner or left join in which only a table that was counted to be small is broadcast.

    Left to itself, Spark goes by the sizes of files: rows that were made of them by the dozen look as small, and would go through the driver.
    """
    few = table.limit(LOOKUP + 1).count() <= LOOKUP
    return rows.join(F.broadcast(table) if few else table.hint("merge"), on, how)
