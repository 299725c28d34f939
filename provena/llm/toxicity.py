"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct lower-cased words, pairs of neighbouring words, and
pairs with one or two words between them, hashed into 2**BITS places.  Shards of a bounded
sample of labelled rows are fitted with per-coordinate learning rates and L1 in parallel,
and their weights averaged; the next round starts from the average.  L1 leaves few weights
that are not zero, so the model is a small array that is shipped with the scoring tasks.

Only `text` is read for a score.  Defined cases: null and empty texts get the score of the bias
alone; rows without a label, or with a null one, don't train; a document labelled twice trains
twice; without any training row every score is 0.5; a long text is scored whole; equal texts have
equal scores; an empty table gives no rows; extra columns of the documents are kept, but for those
named score and predicted, which `score` replaces and `clean` keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provena.llm import vec
from provena.session import small_batches, stored

BITS = 20
#: Bound of the training sample, in labelled rows: those of the lowest hash of id and text.
SAMPLE_ROWS = 24_000
#: Rows that one task fits in a round.
SHARD_ROWS = 6_000
ROUNDS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.1


@dataclass(frozen=True)
class Model:
    index: np.ndarray  # sorted feature places
    weight: np.ndarray
    bias: float


def features(column: pa.Array):
    """Feature places of runs of texts: (first row, row of each feature, feature place), with repeats."""
    for lo, hi, data, off in vec.runs(column):
        h, at = vec.word_hashes(data, off, vec.ALNUM)
        doc = np.repeat(np.arange(hi - lo), np.diff(at))
        rows, places = [doc], [h >> np.uint64(64 - BITS)]
        for gap in (1, 2, 3):
            if len(h) > gap:
                same = doc[gap:] == doc[:-gap]
                pair = vec.mix(h[:-gap] * np.uint64(0x9FB21C651E98DF25) + h[gap:] + np.uint64(1 if gap == 1 else 2))
                rows.append(doc[gap:][same])
                places.append(pair[same] >> np.uint64(64 - BITS))
        yield lo, hi, np.concatenate(rows), np.concatenate(places).astype(np.int64)


def distinct(column: pa.Array) -> list[np.ndarray]:
    """The distinct feature places of each text."""
    out = []
    for lo, hi, rows, places in features(column):
        key = np.unique((rows.astype(np.int64) << BITS) | places)
        cut = np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.int64) << BITS)
        place = (key & ((1 << BITS) - 1)).astype(np.int32)
        out += [place[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def ftrl(texts: list[np.ndarray], y: np.ndarray, start: tuple[np.ndarray, np.ndarray, float], order: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One epoch over the rows in `order`; the start's weights become the state's z at its n."""
    w0, n, bias = start
    n = n.copy()
    z = -w0 * ((BETA + np.sqrt(n)) / ALPHA + L2) - np.sign(w0) * L1
    zb, nb = -bias * (BETA / ALPHA), 0.0
    for i in order:
        f = texts[i]
        zi, ni = z[f], n[f]
        root = np.sqrt(ni)
        w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
        rate_b = (BETA + nb**0.5) / ALPHA
        b = -zb / rate_b
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - y[i]
        if abs(g) < 1e-4:
            continue
        after = ni + g * g
        z[f] = zi + g - (np.sqrt(after) - root) / ALPHA * w
        n[f] = after
        zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * b
        nb += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w, n, -zb / ((BETA + nb**0.5) / ALPHA)


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of at most `sample_rows` labelled rows outside the held-out fifth."""
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    lab = lab.select("doc_id", F.col("toxic").cast("int").alias("y"))
    # the bound is taken on the narrow table of labels, before any text moves
    lab = lab.withColumn("k", F.xxhash64("doc_id", "y")).orderBy("k", "doc_id", "y").limit(sample_rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(lab), "doc_id").select("text", "y", "k")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, rounds: int = ROUNDS) -> Model:
    """Fit on the bounded sample: a task for each `shard_rows` rows, weights averaged after each round."""
    spark = docs.sparkSession
    small_batches(spark)
    shards = max(1, -(-min(sample_rows, labels.count()) // shard_rows))

    def places(batches):
        for batch in batches:
            f = distinct(batch.column(0))
            at = np.cumsum([0, *map(len, f)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(at, np.concatenate(f) if f else np.zeros(0, np.int32))], names=["y", "k", "shard", "f"])

    rows = labelled(docs, labels, sample_rows).withColumn("shard", F.pmod("k", F.lit(shards)).cast("int"))
    # features are hashed once; a shard is the partition of its number
    rows = stored(rows.mapInArrow(places, "y int, k long, shard int, f array<int>")).repartitionById(shards, "shard").cache()
    index, weight, seen, bias = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0.0
    for r in range(rounds):
        state = spark.sparkContext.broadcast((index, weight, seen, bias))

        def fit(batches, state=state, r=r):
            groups: dict[int, list] = {}
            for batch in batches:
                lists = batch.column(3)
                at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                for s, k, y, lo, hi in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                    groups.setdefault(s, []).append((k, y, flat[lo:hi].copy()))
            for s, g in sorted(groups.items()):
                g.sort(key=lambda x: (x[0], x[1], len(x[2])))
                at, w, seen, b = state.value
                w0, n0 = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
                w0[at], n0[at] = w, seen
                order = np.random.default_rng(1000 * r + s).permutation(len(g))
                w1, n1, b1 = ftrl([x[2] for x in g], np.array([x[1] for x in g], float), (w0, n0, b), order)
                on = np.flatnonzero(w1)
                yield pa.RecordBatch.from_pydict({"rows": [len(g)], "place": [on.tolist()], "weight": [w1[on].tolist()], "seen": [n1[on].tolist()], "bias": [float(b1)]})

        got = rows.mapInArrow(fit, "rows long, place array<long>, weight array<double>, seen array<double>, bias double").collect()
        total = sum(g.rows for g in got)
        if not total:
            break
        w, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for g in got:
            p = np.array(g.place, np.int64)
            w[p] += np.array(g.weight) * g.rows / total
            n[p] += np.array(g.seen) * g.rows / total
        index = np.flatnonzero(w)
        weight, seen, bias = w[index], n[index], sum(g.bias * g.rows for g in got) / total
    rows.unpersist()
    return Model(index, weight, float(bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score` (0 to 1, of whole texts) and `predicted`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select([F.col(f"`{c}`") for c in keep])
    out = docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    at = keep.index("text")

    def run(batches):
        index, weight, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[index] = weight
        for batch in batches:
            s = np.empty(batch.num_rows)
            for lo, hi, rows, places in features(batch.column(at)):
                on = dense[places] != 0
                key = np.unique((rows[on].astype(np.int64) << BITS) | places[on])
                s[lo:hi] = np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], hi - lo)
            s = 1 / (1 + np.exp(-np.clip(s + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, out)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with their own columns."""
    names = {c: f"c{i}" if c != "text" else c for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())  # so that columns named score or predicted survive
    return score(plain, train(docs, labels)).where("predicted = 0").drop("score", "predicted").toDF(*names)
