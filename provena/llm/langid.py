"""Language identification by interpolated Kneser-Ney models over characters, one for each language.

A text is read as lower-cased letters with one boundary for each run of anything else.  A character is
hashed to 12 bits (code points below 4096 keep apart), so the last five make a key of 60 bits with the
newest on top; a lower order's key is a shift of it.  Every training text is counted: tasks sum the keys
of their texts and Spark adds the sums.  From the counts of five characters Spark derives the lower orders (how many
different characters stand before), context totals, counts of counts and discounts; interpolation then
runs over the kept keys only.  A language's model is, for each order, a sorted array of hashes with log
probabilities and one of context hashes with back-off weights, searched by bisection.

A language's keys are kept when their share of an order's counts reaches 5 * languages / MAX_KEYS, so
all models together have at most MAX_KEYS keys, however large the corpus; what is not kept is left to the
lower order by the back-off weight, so probabilities still sum to one.

The language of least cross-entropy a character wins.  `score` is its probability in a softmax of the
entropies times the root of the length, with a temperature fitted on a bounded part of the training texts that isn't
counted.  The same part gives, by length, the entropy that 99 in 100 right texts stay under; `accepted` is false above
it, for a text in none of the languages.

Defined cases: null texts and texts without letters are `und` with score 0 and not accepted; rows whose lang is null
don't train; without any training row every text is `und`; equal texts have equal results, and are on one side of
the split for calibration; of equal entropies the language first in order wins; long texts are read whole, in slices; an empty table gives no rows;
extra columns are kept, but those named as new columns (lang_pred, score, accepted, entropy) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from provena.session import small_batches, stored

ORDER, BITS = 5, 12
#: Bound of the keys of all models together; a key takes 12 bytes, and a context as much.
MAX_KEYS = 4_000_000
#: Bound of the texts that calibrate, expected; at most a tenth of the training texts.
CALIBRATION_ROWS = 4_000
#: Lengths of the excerpts that calibrate besides whole texts.
EXCERPTS = (12, 24, 48, 96, 192)
#: Share of right texts that stay accepted.
ACCEPT = 0.99
#: Characters read at once.
SLICE = 1 << 20
#: Distinct keys that a task sums before it hands them over.
PENDING = 1 << 21
MASK = (1 << BITS) - 1
UND = "und"


@cache
def _codes() -> np.ndarray:
    """The 12-bit hash of each code point; 0 for what is no letter."""
    points = np.arange(0x110000, dtype=np.int64)
    letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    return np.where(letter, points % MASK + 1, 0).astype(np.uint16)


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Character hashes of all texts of a column, runs of boundaries as one and none at a start, and where each text starts."""
    texts = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data, off = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = data.to_pybytes()[off[0] : off[-1]] if data is not None else b""
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    code = _codes()[np.minimum(points, 0x10FFFF)]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    before = np.zeros(len(code), bool)  # a letter right before, in the same text
    before[1:] = code[:-1] != 0
    at = starts[:-1][starts[:-1] < len(code)]
    before[at] = False
    keep = (code != 0) | before
    return code[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def slices(code: np.ndarray, starts: np.ndarray):
    """(text of each position, key of each position) of slices of all positions."""
    for lo in range(0, len(code), SLICE):
        hi = min(lo + SLICE, len(code))
        where = np.arange(lo, hi)
        doc = np.searchsorted(starts, where, "right") - 1
        place = where - starts[doc]
        key = code[lo:hi].astype(np.int64) << (BITS * (ORDER - 1))
        for back in range(1, ORDER):
            old = code[np.maximum(where - back, 0)].astype(np.int64)
            old[place < back] = 0
            key |= old << (BITS * (ORDER - 1 - back))
        yield doc, key


def _training(docs: DataFrame) -> DataFrame:
    """(lang, text, u) of rows outside the held-out fifth; u, uniform in [0, 1), depends on the text alone."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    return rows.select("lang", "text", (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / (1 << 20)).alias("u"))


def counted(rows: DataFrame) -> DataFrame:
    """(lang, g, c) over all rows (lang, text)."""

    def run(batches):
        sums: dict[str, list] = {}
        pending = 0

        def flush():
            for lang, parts in sums.items():
                key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                c = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                for lo in range(0, len(key), 1 << 16):
                    k = key[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(k), np.int32))), pa.array(k), pa.array(c[lo : lo + (1 << 16)])], names=["lang", "g", "c"])
            sums.clear()

        for batch in batches:
            langs = batch.column(0)
            for lang in pc.unique(langs).to_pylist():
                code, starts = sequences(batch.column(1).filter(pc.equal(langs, lang)))
                for _, key in slices(code, starts):
                    part = np.unique(key, return_counts=True)
                    mine = sums.setdefault(lang, [])
                    mine.append(part)
                    pending += len(part[0])
                    # runs of like size are merged, as in a merge sort, so a key is handled a few times only
                    while len(mine) > 1 and len(mine[-2][0]) < 2 * len(mine[-1][0]):
                        (k1, c1), (k2, c2) = mine.pop(), mine.pop()
                        k, at = np.unique(np.concatenate([k1, k2]), return_inverse=True)
                        mine.append((k, np.bincount(at, np.concatenate([c1, c2])).astype(np.int64)))
                        pending -= len(k1) + len(k2) - len(k)
            if pending > PENDING:
                yield from flush()
                pending = 0
        yield from flush()

    part = rows.select("lang", "text").mapInArrow(run, "lang string, g long, c long")
    return part.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def orders(grams: DataFrame) -> DataFrame:
    """(lang, k, g, c) of all orders: counts of the highest one, and below how many characters stand before."""
    out, last = grams.select("lang", F.lit(ORDER).alias("k"), "g", "c"), grams
    for k in range(ORDER - 1, 0, -1):
        last = last.groupBy("lang", F.shiftright("g", BITS).alias("g")).agg(F.count("*").alias("c"))
        out = out.unionAll(last.select("lang", F.lit(k).alias("k"), "g", "c"))
    return out


def kept(all_orders: DataFrame, max_keys: int = MAX_KEYS) -> tuple[DataFrame, DataFrame]:
    """Keys (lang, k, g, c, total of their context) within the bound, and (lang, k, total, n1, n2) of each order."""
    sums = all_orders.groupBy("lang", "k").agg(F.sum("c").alias("total"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("c") == 2, 1).otherwise(0)).alias("n2"))
    sums = stored(sums)
    languages = sums.select("lang").distinct().count()
    share = ORDER * languages / max_keys
    # the context: all but the newest character, which is on top
    context = F.expr(f"g & (shiftleft(1L, {BITS} * (k - 1)) - 1)")
    with_total = all_orders.withColumn("total_h", F.sum("c").over(Window.partitionBy("lang", "k", context)))
    out = with_total.join(F.broadcast(sums.select("lang", "k", "total")), ["lang", "k"]).where(F.col("c") >= share * F.col("total"))
    return out.select("lang", "k", "g", "c", F.col("total_h")), sums


@dataclass(frozen=True)
class Language:
    """For each order: sorted hashes with log2 probabilities, and sorted context hashes with log2 back-off weights."""

    keys: tuple[np.ndarray, ...]
    logs: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    backs: tuple[np.ndarray, ...]
    floor: float


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    models: tuple[Language, ...]
    temperature: float = 1.0
    limits: tuple[tuple[float, float], ...] = ()  # (characters from, most entropy)


def _found(sorted_keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    at = np.searchsorted(sorted_keys, q)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == q


def logs2(m: Language, g: np.ndarray, top: int = ORDER) -> np.ndarray:
    """Log2 probabilities of keys of the order `top`: the longest kept key, and the back-off weights of the contexts above it."""
    out, left = np.zeros(len(g)), np.arange(len(g))
    for k in range(top, 0, -1):
        q = g[left] >> (BITS * (top - k))
        at, hit = _found(m.keys[k - 1], q)
        out[left[hit]] += m.logs[k - 1][at[hit]] if len(m.logs[k - 1]) else 0
        left, q = left[~hit], q[~hit]
        at, hit = _found(m.contexts[k - 1], q & ((1 << (BITS * (k - 1))) - 1))
        out[left[hit]] += m.backs[k - 1][at[hit]] if len(m.backs[k - 1]) else 0
    out[left] += m.floor
    return out


def _language(rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], discount: dict[int, float], alphabet: int) -> Language:
    """Interpolated probabilities of the kept keys, from the lowest order up."""
    none = np.zeros(0, np.int64)
    m = Language((none,) * ORDER, (np.zeros(0, np.float32),) * ORDER, (none,) * ORDER, (np.zeros(0, np.float32),) * ORDER, -np.log2(alphabet))
    for k in range(1, ORDER + 1):
        g, c, total = rows.get(k, (none, none, none))
        by = np.argsort(g)
        g, share = g[by], (c[by] - discount.get(k, 0.5)) / total[by]
        context, at = np.unique(g & ((1 << (BITS * (k - 1))) - 1), return_inverse=True)
        back = np.maximum(1 - np.bincount(at, share, len(context)), 1e-9)
        below = logs2(m, g >> BITS, k - 1) if k > 1 else np.full(len(g), m.floor)
        p = share + back[at] * np.exp2(below)
        put = lambda old, new, k=k: (*old[: k - 1], new, *old[k:])
        m = Language(put(m.keys, g), put(m.logs, np.log2(p).astype(np.float32)), put(m.contexts, context), put(m.backs, np.log2(back).astype(np.float32)), m.floor)
    return m


def entropies(column: pa.Array, models: tuple[Language, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bits a character of each text under each model, and the number of characters."""
    code, starts = sequences(column)
    bits = np.zeros((len(column), len(models)))
    for doc, key in slices(code, starts):
        g, at = np.unique(key, return_inverse=True)
        for j, m in enumerate(models):
            bits[:, j] -= np.bincount(doc, logs2(m, g)[at], len(column))
    n = np.diff(starts)
    return bits / np.maximum(n, 1)[:, None], n


def softmax(h: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    x = -(h - h.min(1, keepdims=True)) * np.sqrt(n)[:, None] * temperature
    p = np.exp(x)
    return p / p.sum(1, keepdims=True)


def calibrated(h: np.ndarray, n: np.ndarray, y: np.ndarray, accept: float = ACCEPT) -> tuple[float, tuple[tuple[float, float], ...]]:
    """The temperature of least log loss, and the entropy by length under which the share `accept` of right texts stays."""
    if not len(y):
        return 1.0, ()
    grid = np.exp2(np.arange(-4, 7.01, 0.25))
    right = h.argmin(1) == y
    # the target of a right answer is short of 1 by a pseudo-count, else separable texts ask for an endless temperature
    hit = (right.sum() + 1) / (right.sum() + 2)
    own = [np.clip(softmax(h, n, t)[np.arange(len(y)), y], 1e-12, 1 - 1e-12) for t in grid]
    loss = [-(hit * np.log(p) + (1 - hit) * np.log(1 - p)).mean() for p in own]
    limits, best = [], h.min(1)
    for lo, hi in ((0, 16), (16, 32), (32, 64), (64, 128), (128, 256), (256, 1 << 62)):
        mine = best[right & (n >= lo) & (n < hi)]
        # a class of few texts tells no quantile: it takes that of all shorter or equally long ones
        if len(mine) < 50:
            mine = best[right & (n < hi)]
        limits.append((float(lo), float(np.quantile(mine, accept, method="higher")) if len(mine) >= 50 else float("inf")))
    return float(grid[int(np.argmin(loss))]), tuple(limits)


def train(docs: DataFrame, max_keys: int = MAX_KEYS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Models of all languages of the training rows, with their calibration."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _training(docs)
    part = min(0.1, calibration_rows / max(1, rows.count()))
    grams = stored(counted(rows.where(F.col("u") >= part)))
    keys, sums = kept(stored(orders(grams)), max_keys)
    info = {(r.lang, r.k): r for r in sums.collect()}
    languages = tuple(sorted({lang for lang, _ in info}))
    if not languages:
        return Model((), ())
    table = keys.toArrow()
    alphabet = 1 + max(r.n for r in [grams.select(F.shiftright("g", BITS * (ORDER - 1)).alias("w")).agg(F.count_distinct("w").alias("n")).first()])
    lang, k = table.column("lang").to_numpy(zero_copy_only=False), table.column("k").to_numpy()
    cols = [table.column(c).to_numpy() for c in ("g", "c", "total_h")]
    models = []
    for name in languages:
        mine = {i: tuple(c[(lang == name) & (k == i)] for c in cols) for i in range(1, ORDER + 1)}
        discount = {i: float(np.clip(r.n1 / (r.n1 + 2 * r.n2), 0.1, 0.9)) if (r := info.get((name, i))) and r.n1 else 0.5 for i in range(1, ORDER + 1)}
        models.append(_language(mine, discount, alphabet))
    model = Model(languages, tuple(models))
    names = {x: i for i, x in enumerate(languages)}
    known = entropy_rows(excerpts(rows.where(F.col("u") < part)), model).where(F.col("n") > 0).toArrow()
    if known.num_rows:
        y = np.array([names.get(x, -1) for x in known.column("lang").to_pylist()])
        h = np.array(known.column("h").to_pylist()).reshape(len(y), -1)
        n = known.column("n").to_numpy()
        by = y >= 0
        model = Model(languages, tuple(models), *calibrated(h[by], n[by], y[by]))
    return model


def excerpts(rows: DataFrame) -> DataFrame:
    """The texts, and of each one excerpt of each length, so that short texts are calibrated too."""
    start = F.lit(1) + F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - F.col("size"), F.lit(1))).cast("int")
    sized = rows.select("lang", "text", F.explode(F.array(*map(F.lit, (0, *EXCERPTS)))).alias("size"))
    return sized.select("lang", F.when(F.col("size") == 0, F.col("text")).otherwise(F.substr("text", start, F.col("size"))).alias("text"))


def entropy_rows(rows: DataFrame, model: Model) -> DataFrame:
    """(lang, n, h) of rows (lang, text): what calibration reads."""
    shared = rows.sparkSession.sparkContext.broadcast(model.models)

    def run(batches):
        for batch in batches:
            h, n = entropies(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(list(h), pa.list_(pa.float64()))], names=["lang", "n", "h"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, n long, h array<double>")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with the language, its score, whether it is accepted, and the least entropy."""
    small_batches(docs.sparkSession)
    new = ("lang_pred", "score", "accepted", "entropy")
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in new])
    kept, at = docs.columns, docs.columns.index("text")
    docs = docs.toDF(*[f"c{i}" for i in range(len(kept))])  # names with dots can't be sent as they are
    schema = docs.selectExpr("*", "'' AS lang_pred", "0D AS score", "true AS accepted", "cast(null AS double) AS entropy").schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UND], object)
        lows, most = np.array([x for x, _ in m.limits]), np.array([x for _, x in m.limits])
        for batch in batches:
            rows = batch.num_rows
            best, score, least, ok = np.full(rows, len(m.languages)), np.zeros(rows), np.full(rows, np.nan), np.zeros(rows, bool)
            if m.languages and rows:
                h, n = entropies(batch.column(at), m.models)
                has = n > 0
                if has.any():
                    best[has], least[has] = h[has].argmin(1), h[has].min(1)
                    score[has] = softmax(h[has], n[has], m.temperature).max(1)
                    ok[has] = least[has] <= most[np.searchsorted(lows, n[has], "right") - 1] if len(lows) else True
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(ok), pa.array(least, mask=np.isnan(least))], names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, schema).toDF(*kept, *new)


def identified(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
