"""Names for extra columns that can't clash with those of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

OWN = ("doc_id", "text", "source", "lang")


def neutral(docs: DataFrame) -> DataFrame:
    """`docs` with its columns in place, those that no operator reads as c0, c1, ..."""
    return docs.toDF(*[c if c in OWN else f"c{i}" for i, c in enumerate(docs.columns)])


def restored(out: DataFrame, docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """`out`, which starts with the columns of `neutral(docs)`, under the names of `docs`; of those in `drop` the new column stays."""
    n = len(docs.columns)
    keep = [i for i, c in enumerate(docs.columns) if c not in drop]
    more = out.columns[n:]
    flat = out.toDF(*[f"x{i}" for i in range(len(out.columns))])
    return flat.select(*[f"x{i}" for i in keep], *[f"x{n + j}" for j in range(len(more))]).toDF(*[docs.columns[i] for i in keep], *more)
