"""Document fingerprints by I-Match over randomised lexicons.

A lexicon holds the terms whose share of documents lies within [LOW, HIGH], a band of inverse
document frequency.  Shares, not counts, bound it: as each document has few distinct terms, at
most (distinct terms a document) / LOW terms can reach the band, whatever the corpus' size.
Document frequencies are exact and cover all documents.

A fingerprint sorts a text's distinct terms of the lexicon and hashes SUBSETS random sub-lexicons at
each of LEVELS rates of 1, 1/4, 1/16, ...  Texts with many terms are told apart by the sparse
sub-lexicons, short ones by the dense.  The likeness of two fingerprints is the share of equal hashes
from the sparsest level on at which half the sub-lexicons are in use.

Defined cases: null and empty texts have a fingerprint of empty sets and are fully like each other;
a text without terms of the band is fingerprinted by all its terms; equal texts have equal
fingerprints; documents follow by descending doc_id, repeated ids by text; null ids come last, by the
CRC of the text, then the text, in ranges of their own; one document alone is its own next; a long text
is fingerprinted whole; extra columns are kept by `fingerprints`, but for one of that name, and ignored
by `edited`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provena.llm import vec
from provena.session import small_batches

LOW, HIGH = 0.0005, 0.1
SUBSETS, LEVELS = 16, 6
#: Bound of the broadcast lexicon, in terms; a corpus can exceed it only with over MAX_TERMS * LOW distinct terms a document.
MAX_TERMS = 4_000_000
_SEEDS = vec.mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def term_sets(column: pa.Array):
    """Sorted distinct term hashes of each text."""
    for _, _, data, off in vec.runs(column):
        w, at = vec.word_hashes(data, off, vec.ALNUM)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(w[a:b])


def _count(batches):
    """Document frequencies of a task's rows, in bounded flushes."""
    held, size = [], 0

    def flush():
        t, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    for batch in batches:
        for s in term_sets(batch.column(0)):
            held.append(s)
            size += len(s)
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    small_batches(docs.sparkSession)
    total = docs.count()
    df = docs.select("text").mapInArrow(_count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # two documents at least, or a term says nothing about likeness
    band = df.where((F.col("n") >= max(2.0, low * total)) & (F.col("n") <= max(2.0, high * total))).select("term")
    got = band.limit(MAX_TERMS + 1).toArrow().column(0).combine_chunks()
    if len(got) > MAX_TERMS:
        raise ValueError(f"over {MAX_TERMS} terms in the band; raise `low`")
    return np.sort(got.to_numpy().astype(np.int64).view(np.uint64)) if len(got) else np.zeros(0, np.uint64)


def fingerprint(terms: np.ndarray, lex: np.ndarray) -> bytes:
    """16 bits for each sub-lexicon, level by level; 0 where none of its terms occurs."""
    if len(lex) and len(terms):
        at = np.searchsorted(lex, terms)
        at[at == len(lex)] = 0
        inside = terms[lex[at] == terms]
        terms = inside if len(inside) else terms
    if not len(terms):
        return bytes(2 * SUBSETS * LEVELS)
    draw = vec.mix(terms[:, None] ^ _SEEDS[None, :])  # of each term in each family
    value = vec.mix(draw + np.uint64(1))
    # a term is in the sub-lexicon of level v when its draw ends in 2 * v zero bits; levels are nested
    out = np.zeros((LEVELS, SUBSETS), np.uint16)
    for v in range(LEVELS):
        on = (draw & np.uint64((1 << 2 * v) - 1)) == 0
        used = on.any(axis=0)
        if not used.any():
            break
        # terms are sorted and distinct, so a sum of mixed values is a hash of the set
        out[v] = np.where(used, (vec.mix(np.where(on, value, np.uint64(0)).sum(axis=0, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16) | np.uint16(1), 0)
    return out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    x, y = (np.frombuffer(z, np.uint16).reshape(LEVELS, SUBSETS) for z in (a, b))
    used = (x != 0) | (y != 0)
    good = np.flatnonzero(used.sum(axis=1) * 2 >= SUBSETS)
    v = good[-1] if len(good) else 0
    return float((x[v:] == y[v:])[used[v:]].sum() / max(1, used[v:].sum()))


def fingerprints(docs: DataFrame, lex: np.ndarray | None = None) -> DataFrame:
    """`docs` with the column `fingerprint` (hex)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs) if lex is None else lex)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            f = [fingerprint(s, shared.value).hex() for s in term_sets(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f, pa.string())], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, docs.withColumn("fingerprint", F.lit("")).schema)


#: Text bytes of one range of ids, and the most ranges.  A range is a sorted stream of rows, never held whole,
#: so beyond MAX_RANGES * RANGE_BYTES tasks grow longer, not larger.
RANGE_BYTES, MAX_RANGES = 4 << 20, 20_000


def in_ranges(docs: DataFrame) -> DataFrame:
    """(range, last, doc_id, text): documents dealt by ranges of descending doc_id, rows of a range in order.

    A row's next document is the row after it; each range ends with one row more (`last` = 1), the
    first text of the following range, and the last range with the first text of all.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")
    total, loose = d.agg(F.sum(size), F.sum(F.when(F.col("doc_id").isNull(), size))).first()
    n, m = (int(min(MAX_RANGES, (x or 0) // RANGE_BYTES + 1)) for x in (total, loose))
    cuts = d.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)] or [0.5], max(10_000, 10 * n))).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64)) if n > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        # ascending numbers follow descending ids
        return pd.Series((len(bounds) - np.searchsorted(bounds, ids.fillna(0).astype("int64"), "left")).astype(np.int32))

    # rows without an id are in order of their text's CRC, and dealt by it
    mark = F.when(F.col("doc_id").isNull(), F.crc32(F.col("text").cast("binary"))).otherwise(F.lit(0).cast("long"))
    at = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1) + F.shiftright(F.col("mark") * m, 32).cast("int")).otherwise(place("doc_id"))
    d = d.withColumn("mark", mark).select(at.alias("range"), "doc_id", "mark", "text")
    heads = sorted((r.range, r.head, r.mark) for r in d.groupBy("range").agg(F.max("doc_id").alias("head"), F.min("mark").alias("mark")).collect())
    follow = docs.sparkSession.createDataFrame([(a[0], *b[1:]) for a, b in zip(heads, heads[1:] + heads[:1], strict=True)], "to int, head long, first long")
    firsts = d.join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("mark") == F.col("first"))).groupBy("to").agg(F.min("text").alias("text"))
    rows = d.withColumn("last", F.lit(0)).unionByName(firsts.select(F.col("to").alias("range"), F.lit(1).alias("last"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("mark"), "text"))
    rows = rows.repartition("range").sortWithinPartitions("range", "last", F.col("doc_id").desc_nulls_last(), "mark", "text")
    return rows.select("range", "last", "doc_id", "text")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last third is the start of the next document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs))

    def run(batches):
        lex, held = shared.value, None
        for batch in batches:
            texts = batch.column(3).to_pylist()
            prints = [fingerprint(s, lex) for s in term_sets(batch.column(3))]
            done = []  # (doc_id, text, fingerprint, edited text, fingerprint of the next)
            for place, last, doc, text, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, prints, strict=True):
                if held is not None:
                    k = len(held[2]) // 3
                    done.append((held[1], held[2], held[3], held[2][: len(held[2]) - k] + text[:k], f))
                held = None if last else (place, doc, text, f)
            if not done:
                continue
            ids, olds, marks, news, nexts = zip(*done, strict=True)
            changed = [fingerprint(s, lex) for s in term_sets(pa.array(news, pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(map(len, olds), pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in news]),
                    pa.array([x.hex() for x in marks]), pa.array([x.hex() for x in changed]),
                    pa.array([likeness(a, b) for a, b in zip(marks, changed, strict=True)]), pa.array([likeness(a, b) for a, b in zip(marks, nexts, strict=True)]),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ranges(docs).mapInArrow(run, out)
