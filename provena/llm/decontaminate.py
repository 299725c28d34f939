"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of `WINDOW` consecutive words of a benchmark item (an item with
fewer words, but not none, is one window).  For each distinct pattern length the search
keeps a shift table over hashes of blocks of two words, that says how far the scan may jump,
and buckets by the hash of the suffix block, in which the hash of the words before it finds the
windows to compare; the comparison of the words themselves confirms an occurrence.

The tables are flat arrays of numbers over the items' bytes, some eight times the size of the texts.
The benchmark is read in blocks of bounded bytes (no less than one item); every block is one pass over
the rows, stored before the next one starts, so neither the driver nor a task holds more than one
block of patterns.  A scan moves one cursor for every SEGMENT words of a batch, all at once.

Defined cases: null or empty texts have no words, no hits, and are not contaminated; null or
empty items have no windows; items with a null id count under the id "null"; equal items of
different ids both count; repeated documents are judged each; an empty table gives no rows; extra
columns are kept, but for those of the names that `judge` adds.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from provena.llm import vec
from provena.llm.columns import neutral, restored
from provena.session import small_batches, stored

WINDOW = 13
BLOCK = 2
#: A document is contaminated from this share of hit words on: SHARE * n_hit >= n_words.
SHARE = 20
#: Benchmark text of one pass.
PASS_BYTES = 16 << 20
#: Words between two cursors of a scan.
SEGMENT = 256
_FIRST = np.uint64(0x9FB21C651E98DF25)


def words_of(column: pa.Array):
    """Runs of texts as (first row, end row, lower-cased bytes, starts and ends of words, their hashes, first word of each text)."""
    for lo, hi, data, off in vec.runs(column):
        low = vec.LOWER[data]
        starts, ends, at = vec.words(low, off, vec.ALNUM)
        yield lo, hi, low, starts, ends, vec.span_hash(vec.prefix_hash(low), starts, ends), at


class WuManber:
    """Search tables of the windows of one length m, over the words of all items of a block."""

    def __init__(self, m: int, first: np.ndarray, owner: np.ndarray, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """`first`: place of each window's first word; `owner`: number of its item; the rest describes the words."""
        self.m, self.b = m, min(BLOCK, m)
        self.default = max(1, m - self.b + 1)
        self.data, self.starts, self.ends = data, starts, ends
        bits = int(min(26, max(8, 3 + int(len(first)).bit_length())))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.default, np.uint8 if self.default < 256 else np.int32)
        place = (self._block(h, np.arange(self.b, len(h) + 1)) >> self.down).astype(np.int32)
        for end in range(self.b, m + 1):
            at = place[first + (end - self.b)]
            self.shift[at] = np.minimum(self.shift[at], m - end)
        key = self._key(h, first + m)
        order = np.argsort(key, kind="stable")
        self.key, self.first, self.owner = key[order], first[order], owner[order]

    def _block(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the block of words that ends before `end`."""
        return vec.mix(h[end - 2] * _FIRST + h[end - 1]) if self.b == 2 else vec.mix(h[end - 1])

    def _key(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The bucket of the suffix block in the high half, the hash of the words before it in the low half."""
        rest = np.zeros(len(end), np.uint64)
        for i in range(self.m - self.b):
            rest = vec.mix(rest * _FIRST + h[end - self.m + i] + np.uint64(1))
        return (self._block(h, end) >> np.uint64(32) << np.uint64(32)) | (rest >> np.uint64(32))

    def candidates(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ends of the runs of m words within a text at which the shift table finds no reason to jump."""
        m, n = self.m, np.diff(at)
        pieces = np.where(n >= m, -(-(n - m + 1) // SEGMENT), 0)
        text = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        pos = at[text] + m + nth * SEGMENT
        stop = np.minimum(pos + SEGMENT, at[text + 1] + 1)
        out = []
        while len(pos):
            jump = self.shift[self._block(h, pos) >> self.down].astype(np.int64)
            out.append(pos[jump == 0])
            pos = pos + np.maximum(jump, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def scan(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, at: np.ndarray):
        """(end of the occurrence, numbers of the items) of every window that occurs."""
        end = self.candidates(h, at)
        key = self._key(h, end)
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        for e, a, b in zip(*(x[lo < hi].tolist() for x in (end, lo, hi)), strict=True):
            said = [low[starts[i] : ends[i]].tobytes() for i in range(e - self.m, e)]
            same = [k for k in range(a, b) if self._words(k) == said]
            if same:
                yield e, self.owner[same]

    def _words(self, k: int) -> list[bytes]:
        f = self.first[k]
        return [self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(f, f + self.m)]


def tables(items: pa.Array, window: int = WINDOW) -> list[WuManber]:
    """The search tables of items' texts; an item is known by its number."""
    out: list[WuManber] = []
    # words are hashed run by run, so that the whole block is never held in wide numbers
    parts = list(words_of(items))
    base = np.cumsum([0, *(len(p[2]) for p in parts)])
    low = np.concatenate([p[2] for p in parts] or [np.zeros(0, np.uint8)])
    starts, ends = (np.concatenate([p[i] + b for p, b in zip(parts, base, strict=False)] or [np.zeros(0, np.int64)]).astype(np.int32) for i in (3, 4))
    h = np.concatenate([p[5] for p in parts] or [np.zeros(0, np.uint64)])
    at = np.cumsum(np.concatenate([[0], *(np.diff(p[6]) for p in parts)])).astype(np.int64)
    del parts
    n = np.diff(at)
    for m in np.unique(np.minimum(n[n > 0], window)).tolist():
        mine = np.flatnonzero(np.minimum(n, window) == m)
        windows = n[mine] - m + 1
        first = (np.repeat(at[mine], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
        out.append(WuManber(m, first, np.repeat(mine, windows).astype(np.int32), h, low, starts, ends))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _blocks(benchmark: DataFrame, limit: int):
    """The benchmark's items (id, text) in Arrow tables of about `limit` bytes, one on the driver at a time."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("binary").alias("t"))
    size = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // limit) or 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield part.toArrow().combine_chunks(), n


#: Search tables of the block that this Python worker used last.
_LAST: dict = {}


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """`docs` with a struct column `found`: n_words, n_hit, spans (word ranges, apart from each other) and item ids that occur."""
    spark = docs.sparkSession
    small_batches(spark)
    found = T.StructType([
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])
    out = docs.withColumn("found", F.lit(None).cast(found))
    schema = out.schema
    at = docs.columns.index("text")
    for k, (block, n) in enumerate(_blocks(benchmark, pass_bytes)):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared, name=uuid.uuid4().hex):
            ids = shared.value.column("i")
            if name not in _LAST:
                _LAST.clear()
                _LAST[name] = tables(shared.value.column("t"), window)
            engines = _LAST[name]
            for batch in batches:
                column = batch.columns[at]
                old = batch.column(len(batch.columns) - 1).to_pylist()
                rows = [None] * batch.num_rows
                for lo, hi, low, starts, ends, h, first in words_of(column):
                    spans, items = {}, {}
                    for engine in engines:
                        for e, owners in engine.scan(low, starts, ends, h, first):
                            i = int(np.searchsorted(first, e, "left")) - 1
                            spans.setdefault(i, []).append((e - engine.m - int(first[i]), e - int(first[i])))
                            items.setdefault(i, []).append(owners)
                    for i in range(hi - lo):
                        before = old[lo + i] or {"spans": [], "items": []}
                        s, x = before["spans"], before["items"]
                        if i in spans:
                            s = merged([*map(tuple, s), *spans[i]])
                            x = sorted({*x, *(ids[j].as_py() for j in np.unique(np.concatenate(items[i])).tolist())})
                        rows[lo + i] = {"n_words": int(first[i + 1] - first[i]), "n_hit": sum(b - a for a, b in s), "spans": s, "items": x}
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, batch.schema.field(len(batch.columns) - 1).type)], schema=batch.schema)

        out = out.mapInArrow(scan, schema)
        if k + 1 < n:  # a pass of its own, so that no task holds two blocks
            out = stored(out)
    return out


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """`docs` with n_words, n_hit, items (sorted ids) and contaminated; every row and column stays."""
    s = search(neutral(docs), benchmark, window, pass_bytes)
    s = s.select(*s.columns[:-1], "found.n_words", "found.n_hit", "found.items", ((F.col("found.n_hit") > 0) & (share * F.col("found.n_hit") >= F.col("found.n_words"))).alias("contaminated"))
    return restored(s, docs, ("n_words", "n_hit", "items", "contaminated"))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their own columns."""
    s = search(neutral(docs), benchmark)
    return restored(s.where(~((F.col("found.n_hit") > 0) & (SHARE * F.col("found.n_hit") >= F.col("found.n_words")))).drop("found"), docs)


def brute_force(text: str | None, items: list[tuple[str, str | None]]) -> tuple[int, int, int, str, bool]:
    """What `digest` must give for one text, by comparing every position with every window."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        p = split(t)
        k = min(WINDOW, len(p))
        for i in range(len(p) - k + 1 if p else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == p[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and SHARE * len(hit) >= len(w)
