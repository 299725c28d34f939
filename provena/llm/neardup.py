"""Near-duplicate documents by MinHash: one-permutation hashing with optimal densification.

A document's set holds its distinct 5-word shingles.  One hash of each shingle fills `BINS` bins
with minima; an empty bin copies the first filled bin in a random order of its own (optimal
densification); bins are kept as 16 bits.  Bands of `band_rows` bins are bucket keys: a pair at the least likeness that links
shares no bucket with a chance of at most `MISS` (about 2e-7 with 48 bands at 0.85, 4e-9 with 64 at 0.8).

Equal sets are one node from the start, so copies cost nothing.  In each bucket candidate edges
form a star around the member that shares most bucket places with others, usually the original
that the others were edited from.  Edges are confirmed on full sets.  Buckets whose members are
then still in different components are compared across those components, first by signature and then
on full sets, so a pair of linked documents is not lost to the choice of a centre.

Defined cases: null, empty and white-space texts have an empty set and no links; fewer than five
words are one shingle; a null doc_id takes part and gets the least id of its component (null when
there is none); repeated rows are judged alike; long texts are compared whole; extra columns are kept by
`clean` and ignored by `groups`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from provena.llm import vec
from provena.llm.components import components
from provena.session import small_batches, stored

SHINGLE = 5
BINS = 384
#: Link when 100 * shared >= PERCENT * union, unless another threshold is given.
PERCENT = 85
#: Chance that a pair at the threshold shares no bucket, at most.
MISS = 3e-7
#: Members of one centre that a task verifies in one go.
STAR_ROWS = 512
#: Members of a bucket that a task compares with each other; larger buckets are dealt by pairs of blocks.
BLOCK = 2048

_RANK = np.argsort(np.random.default_rng(20240229).random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.uint16)


def band_rows(percent: int) -> int:
    """Bins of a band: as many as `MISS` allows."""
    return max(k for k in range(1, BINS + 1) if BINS % k == 0 and (1 - (percent / 100) ** k) ** (BINS // k) <= MISS)


def alike(percent: int) -> int:
    """Bins that two signatures must share before full sets are compared: five standard deviations below
    what the threshold gives, so a link is passed over with a chance of about 3e-7."""
    p = percent / 100
    return int(BINS * (p - 5 * (p * (1 - p) / BINS) ** 0.5))


def shingle_sets(column: pa.Array):
    """The sorted distinct shingle hashes of each text, in order."""
    for lo, hi, data, off in vec.runs(column):
        w, at = vec.word_hashes(data, off, vec.NOT_SPACE)
        full = vec.sequence_hash(w, SHINGLE)
        for a, b in zip(at[:-1], at[1:], strict=True):
            n = b - a
            yield np.unique(full[a : b - SHINGLE + 1]) if n >= SHINGLE else vec.sequence_hash(w[a:b], n) if n else np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """Densified one-permutation minima of a sorted, non-empty set."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    filled = bins[first].astype(np.int64)
    sig = np.zeros(BINS, np.uint64)
    sig[filled] = s[first]
    if len(filled) < BINS:
        empty = np.ones(BINS, bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        sig[empty] = sig[filled[_RANK[np.ix_(empty, filled)].argmin(axis=1)]]
    return sig


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sign(batches):
    for batch in batches:
        n, keys, sigs = [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            keys.append(set_key(s))
            sigs.append(signature(s).astype(np.uint16).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_key", "sig"])


def _alike(batches, percent: int):
    """Pairs of one bucket (or of two of its blocks) in different components, with like sizes and signatures."""
    size, least = band_rows(percent), alike(percent)

    def pairs(rows: list[tuple], crossed: bool, band: int):
        """A pair that shares several buckets is given in the first of them only."""
        sig = np.stack([np.frombuffer(r[3], np.uint16) for r in rows])
        n = np.array([r[1] for r in rows])
        label = np.unique([r[2] for r in rows], return_inverse=True)[1]
        block = np.array([r[4] for r in rows])
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows))
            ok = (label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))
            if crossed:
                ok &= block[j] != block[i]
            j = j[ok]
            same = sig[j] == sig[i]
            near = same.sum(axis=1) >= least
            first = same[near].reshape(-1, BINS // size, size).all(axis=2).argmax(axis=1)
            for k in j[near][first == band]:
                yield min(rows[i][0], rows[k][0]), max(rows[i][0], rows[k][0])

    def pack(found: set):
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    key, rows, found = None, [], set()
    for batch in batches:
        for bucket, low, high, band, *row in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
            if (bucket, low, high, band) != key:
                found.update(pairs(rows, key[1] != key[2], key[3]) if rows else ())
                if len(found) > 50_000:
                    yield pack(found)
                    found = set()
                key, rows = (bucket, low, high, band), []
            rows.append(tuple(row))
    found.update(pairs(rows, key[1] != key[2], key[3]) if rows else ())
    yield pack(found)


def _sets(batches):
    for batch in batches:
        keep, sets = [], []
        for i, (s, want) in enumerate(zip(shingle_sets(batch.column(1)), batch.column(0).to_pylist(), strict=True)):
            if set_key(s) == want:
                keep.append(i)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())], names=["node", "items"])


def _confirm(batches, percent: int):
    """Rows sorted by centre and part, the centre's own row first: the pairs that are links."""
    centre, here = None, None
    for batch in batches:
        a, b = [], []
        for c, p, m, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            s = np.frombuffer(items, np.uint64)
            if m is None:
                centre, here = (c, p), s
            elif (c, p) == centre:
                at = np.searchsorted(here, s)
                at[at == len(here)] = 0
                shared = int((here[at] == s).sum())
                if 100 * shared >= percent * (len(here) + len(s) - shared):
                    a.append(c)
                    b.append(m)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def confirm(edges: DataFrame, docs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The candidate edges (a: centre, b: member) whose full sets are like enough."""
    edges = stored(edges.select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("set_key")).union(edges.select("b")).distinct()
    wanted = reps.join(nodes, "set_key").select("set_key", "rep")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("set_key", "text")
    sets = stored(texts.mapInArrow(_sets, "node binary, items binary").dropDuplicates(["node"]))
    parts = edges.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    salted = edges.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("node"))
    members = salted.join(sets, "node").select("a", "part", F.col("node").alias("member"), "items")
    own = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("member"))
    own = own.join(sets.withColumnRenamed("node", "a"), "a").select("a", "part", "member", "items")
    rows = members.unionByName(own).repartition("a", "part").sortWithinPartitions("a", "part", F.col("member").asc_nulls_first())
    return rows.mapInArrow(lambda batches: _confirm(batches, percent), "a binary, b binary")


def _like(n: str, m: str, percent: int):
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent)


def _text_key():
    return F.unhex(F.md5("text"))


def link(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text_key, n_shingles, set_key) of every row, and (node, label) of nodes with links."""
    small_batches(docs.sparkSession)
    base = docs.select("doc_id", "text")
    signed = stored(base.withColumn("text_key", _text_key()).mapInArrow(_sign, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, text_key binary, n_shingles long, set_key binary, sig binary"))
    some = signed.where("set_key is not null")
    reps = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    nodes = some.dropDuplicates(["set_key"]).select(F.col("set_key").alias("node"), F.col("n_shingles").alias("n"), "sig")
    size = band_rows(percent)
    width = 2 * size
    hashes = F.transform(F.sequence(F.lit(0), F.lit(BINS // size - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * width + 1, F.lit(width))))
    bands = nodes.select("node", "n", F.explode(hashes).alias("bucket"))
    full = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    multi = stored(bands.join(full, "bucket"))
    if multi.isEmpty():
        return signed, None
    # a star in each bucket, around the member with most company
    company = multi.groupBy("node").agg(F.sum("members").alias("company"))
    ranked = stored(multi.join(company, "node"))
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("company", "node", "n")).alias("c")).select("bucket", F.col("c.node").alias("a"), F.col("c.n").alias("an"))
    star = ranked.join(centres, "bucket").where((F.col("a") != F.col("node")) & _like("an", "n", percent)).select("a", F.col("node").alias("b"))
    links = stored(confirm(star, base, reps, percent))
    label = components(links) if not links.isEmpty() else None
    # buckets that still span components: compare their members across components
    if label is None:
        spread = multi.withColumn("label", F.col("node"))
    else:
        spread = multi.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = spread.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("bucket")
    rest = stored(spread.join(apart, "bucket").select("bucket", "node", "n", "label"))
    if not rest.isEmpty():
        blocks = rest.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = rest.join(blocks, "bucket").join(nodes.select("node", "sig"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.array_position(hashes, F.col("bucket")) - 1).cast("int").alias("band"), "node", "n", "label", "sig", "block")
        dealt = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "band", "node")
        pairs = dealt.mapInArrow(lambda batches: _alike(batches, percent), "a binary, b binary").distinct()
        tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = stored(confirm(pairs.join(tried, ["a", "b"], "left_anti"), base, reps, percent))
        if not more.isEmpty():
            label = components(links.unionByName(more))
    return signed, label


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key and group, which is null for an empty set, of every row."""
    signed, label = link(docs, percent)
    s = signed.select("doc_id", "text_key", "n_shingles", "set_key")
    s = s.join(label.withColumnRenamed("node", "set_key"), "set_key", "left") if label is not None else s.withColumn("label", F.lit(None).cast("binary"))
    return s.withColumn("group", F.coalesce("label", "set_key"))


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each document."""
    s = _grouped(docs, percent)
    least = s.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = s.where("group is not null").join(least, "group").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(s.where("group is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def clean(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with the columns of `docs`: that of the least id (nulls last), set and text.

    Rows with an empty set all stay; of rows that repeat an id and its text, one stays.
    """
    s = _grouped(docs, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set_key", "text_key")).alias("f")
    keep = s.where("group is not null").groupBy("group").agg(first).select(F.col("f.doc_id").alias("_keep"), F.col("f.text_key").alias("_key"))
    keep = keep.unionByName(s.where("group is null").select(F.col("doc_id").alias("_keep"), F.col("text_key").alias("_key")))
    d = docs.withColumn("_text_key", _text_key())
    out = d.join(keep, d["doc_id"].eqNullSafe(F.col("_keep")) & d["_text_key"].eqNullSafe(F.col("_key")), "left_semi")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return out.drop("_text_key")
    w = Window.partitionBy("doc_id", "_text_key").orderBy("_text_key", *[F.col(f"`{c}`").asc_nulls_last() for c in docs.columns if c not in ("doc_id", "text")])
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_text_key")


def brute_force(rows: list[tuple], percent: int = PERCENT) -> dict:
    """What `groups` must give for (doc_id, text) rows, by comparing all pairs."""
    def of(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()

    sets = {i: of(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j > i}:
            shared = len(s & sets[j])
            if 100 * shared >= percent * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
