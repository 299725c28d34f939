"""Exact removal of repeated byte strings by suffix sorting (deep-shallow).

Every byte covered by a LENGTH-byte string that also starts anywhere else is removed.  Sorting all
suffixes of a corpus would move each byte hundreds of times, so suffixes are sampled: of each
LENGTH-byte window the least hash of its GRAM-byte strings marks an anchor (leftmost of equals).
The choice depends on the window's bytes alone, so equal windows have equal anchors in the same
place, and only windows with the same anchor need comparing.  Anchors whose gram occurs once are
dropped; the suffixes of the others meet by gram.

Within a group, suffixes that start at the anchors are sorted by multikey quicksort down to a
shallow depth; groups with longer common prefixes are ordered by blind tries.  Bytes before the
anchor decide how far a shared window may start to the left: walking the common-prefix intervals
from deep to shallow and keeping members in order of their reversed left sides, each member's best
partner is a neighbour, so a group of m costs m log m comparisons, not m * m.

Groups of over HOT suffixes don't go to one task: their windows are counted one by one, by digest,
with partial sums.

Defined cases: null and empty texts have no bytes and hash as nothing; texts under LENGTH bytes are kept
whole; equal texts of LENGTH bytes or more are removed whole; repeated rows count as other places;
a null doc_id is kept as it is; long texts are judged whole; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from provena.llm import vec
from provena.session import small_batches, stored

LENGTH = 400
GRAM = 64
#: Depth of the multikey quicksort, in bytes; its words are 8 bytes.
SHALLOW = 96
#: Suffixes of one gram that a task sorts.
HOT = 50_000


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Arrays of text number, gram hash, anchor, first and last window start (within the text)."""
    none = np.zeros(0, np.int64)
    wide = length - gram + 1
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none, none, none
    h = vec.prefix_hash(data)
    _, inv = vec.powers(len(h))
    key = vec.mix((h[gram:] - h[:-gram]) * inv[: len(h) - gram])
    low = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
    size = 1
    while size * 2 <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    at = (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int8)
    long = np.flatnonzero(np.diff(off) >= length)
    valid[off[long]] = 1
    valid[off[long + 1] - length + 1] -= 1
    p = np.flatnonzero(np.cumsum(valid)[:n])
    if not len(p):
        return none, none, none, none, none
    q = at[p]
    first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)])
    last = np.r_[first[1:], len(p)] - 1
    q = q[first]
    doc = np.searchsorted(off, q, "right") - 1
    return doc, key[q].view(np.int64), q - off[doc], p[first] - off[doc], p[last] - off[doc]


def _find(length: int, gram: int):
    def run(batches):
        seen = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, _, data, off in vec.runs(batch.column(1)):
                doc, key, pos, first, last = anchors(data, off, length, gram)
                new = []
                for i in np.unique(doc):
                    if keys[lo + i] not in seen:
                        seen.add(keys[lo + i])
                        new.append(i)
                on = np.isin(doc, new)
                if on.any():
                    name = pa.array([keys[lo + i] for i in doc[on]], pa.binary())
                    yield pa.RecordBatch.from_arrays([name, *(pa.array(x[on], t) for x, t in ((key, pa.int64()), (pos, pa.int32()), (first, pa.int32()), (last, pa.int32())))], names=["sha", "key", "pos", "lo", "hi"])

    return run


def _cut(length: int):
    """Texts with candidate anchors to suffix records; a record that repeats within its text is a span at once."""

    def run(batches):
        seen = set()
        for batch in batches:
            rows = []
            for sha, text, cand in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if sha in seen:
                    continue
                seen.add(sha)
                first: dict = {}
                for c in cand:
                    a, lo, hi = c["pos"], c["lo"], c["hi"]
                    chunk = text[lo : hi + length]
                    k = (a - lo, chunk)
                    if k in first:
                        rows.append((sha, None, None, lo, hi, None))
                        if first[k] is not None:
                            rows.append((sha, None, None, *first[k], None))
                            first[k] = None
                    else:
                        first[k] = (lo, hi)
                        rows.append((sha, c["key"], a, lo, hi, chunk))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["sha", "key", "pos", "lo", "hi", "chunk"])

    return run


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings that share `depth` bytes; inner nodes hold a depth and branch on one byte."""

    def __init__(self):
        self.root = None

    def add(self, s: bytes, i: int) -> None:
        if self.root is None:
            self.root = (s, [i])
            return
        node = self.root
        while isinstance(node, list):  # blind descent: unseen bytes are not compared
            d, kids = node
            c = s[d] if len(s) > d else -1
            node = kids[c] if c in kids else next(iter(kids.values()))
        other = node[0]
        k = common(s, other)
        if k == len(s) == len(other):
            node[1].append(i)
            return
        c, o = (s[k] if len(s) > k else -1), (other[k] if len(other) > k else -1)
        up, branch, node = None, None, self.root
        while isinstance(node, list) and node[0] < k:
            up, branch = node, (s[node[0]] if len(s) > node[0] else -1)
            node = node[1][branch]
        if isinstance(node, list) and node[0] == k:
            node[1][c] = (s, [i])
            return
        new = [k, {o: node, c: (s, [i])}]
        if up is None:
            self.root = new
        else:
            up[1][branch] = new

    def walk(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node[1]
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of the strings: multikey quicksort to `shallow`, blind tries below."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, d = stack.pop()
        if len(group) == 1:
            out += group
        elif d >= shallow:
            trie = BlindTrie()
            for i in group:
                trie.add(strings[i], i)
            out += trie.walk()
        else:
            words = [strings[i][d : d + 8] for i in group]
            pivot = sorted(words[:: max(1, len(words) // 3)][:3])[1 if len(words) > 2 else 0]
            less = [i for i, w in zip(group, words, strict=True) if w < pivot]
            more = [i for i, w in zip(group, words, strict=True) if w > pivot]
            same = [i for i, w in zip(group, words, strict=True) if w == pivot]
            if more:
                stack.append((more, d))
            stack.append((same, d + 8 if len(pivot) == 8 else shallow))
            if less:
                stack.append((less, d))
    return out


def shared(left: list[bytes], right: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For distinct suffixes `right` with reversed left sides `left`: ranges of window offsets before the anchor that another one shares."""
    m = len(left)
    found: list[list] = [[] for _ in range(m)]

    def meet(i: int, j: int, r: int) -> None:
        k = common(left[i], left[j])
        if k >= length - r:
            found[i].append((max(0, length - r), k))
            found[j].append((max(0, length - r), k))

    if m == 2:
        meet(0, 1, common(right[0], right[1]))
        return found
    order = deep_shallow(right)
    lcp = [common(right[a], right[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
    rank = [0] * m
    for r, i in enumerate(sorted(range(m), key=left.__getitem__)):
        rank[i] = r
    back = [0] * m
    for i, r in enumerate(rank):
        back[r] = i
    segment = list(range(m))  # of places in the order, to the list of ranks that holds it
    lists: dict[int, list[int]] = {k: [rank[i]] for k, i in enumerate(order)}

    def find(k: int) -> int:
        while segment[k] != k:
            segment[k] = segment[segment[k]]
            k = segment[k]
        return k

    for k in sorted(range(m - 1), key=lambda k: -lcp[k]):
        r = lcp[k]
        a, b = find(k), find(k + 1)
        if len(lists[a]) < len(lists[b]):
            a, b = b, a
        big = lists[a]
        for x in lists.pop(b):
            p = bisect_left(big, x)
            if p:
                meet(back[x], back[big[p - 1]], r)
            if p < len(big):
                meet(back[x], back[big[p]], r)
            insort(big, x)
        segment[b] = a
    return found


def group_spans(group: list[tuple], length: int = LENGTH) -> list[tuple]:
    """(text, first, last window start) that repeat, from the records (text, anchor, first, last, chunk) of one gram."""
    classes: dict[tuple, list] = defaultdict(list)
    for sha, a, lo, hi, chunk in {(g[0], g[1]): g for g in group}.values():
        classes[a - lo, chunk].append((sha, a, lo, hi))
    out = []
    keys = list(classes)
    ranges = shared([c[:k][::-1] for k, c in keys], [c[k:] for k, c in keys], length) if len(keys) > 1 else [[]]
    for k, found in zip(keys, ranges, strict=True):
        members = classes[k]
        if len(members) > 1:
            out += [(sha, lo, hi) for sha, _, lo, hi in members]
        elif found:
            sha, a, lo, hi = members[0]
            spans = sorted((max(lo, a - o), min(hi, a - u)) for u, o in found)
            s, e = spans[0]
            for x, y in spans[1:]:
                if x <= e + 1:
                    e = max(e, y)
                else:
                    out.append((sha, s, e))
                    s, e = x, y
            out.append((sha, s, e))
    return [x for x in out if x[1] <= x[2]]


def _sort(length: int):
    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] + length for r in rows], pa.int32())], names=["sha", "s", "e"])

    def run(batches):
        key, group, out = None, [], []
        for batch in batches:
            for sha, k, a, lo, hi, chunk in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if chunk is None:
                    out.append((sha, lo, hi))
                    continue
                if k != key:
                    if len(group) > 1:
                        out += group_spans(group, length)
                    key, group = k, []
                group.append((sha, a, lo, hi, chunk))
            if len(out) > 20000:
                yield pack(out)
                out = []
        if len(group) > 1:
            out += group_spans(group, length)
        if out:
            yield pack(out)

    return run


def _windows(length: int):
    """Every window of the records of hot grams, by digest."""

    def run(batches):
        for batch in batches:
            d, sha, p = [], [], []
            for name, _, _, lo, hi, chunk in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                for i in range(hi - lo + 1):
                    d.append(hashlib.blake2b(chunk[i : i + length], digest_size=16).digest())
                    sha.append(name)
                    p.append(lo + i)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(sha, pa.binary()), pa.array(p, pa.int32())], names=["d", "sha", "s"])

    return run


def _keep(batches):
    for batch in batches:
        out = []
        for sha, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            kept, reach, removed, n = hashlib.sha256(), 0, 0, 0
            for s, e in sorted((x["s"], x["e"]) for x in spans):
                if s > reach or not n:
                    kept.update(text[reach:s])
                    n += 1
                    removed += e - s
                    reach = e
                elif e > reach:
                    removed += e - reach
                    reach = e
            kept.update(text[reach:])
            out.append((sha, removed, n, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["sha", "n_removed", "n_spans", "kept_sha256"])


_RECORD = "sha binary, key long, pos int, lo int, hi int, chunk binary"


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Of rows (sha, text as binary): texts with spans (sha, text, spans as byte ranges), and the spans' table."""
    small_batches(texts.sparkSession)
    long = texts.where(F.octet_length("text") >= length)
    found = stored(long.mapInArrow(_find(length, gram), "sha binary, key long, pos int, lo int, hi int"))
    # sums combine before the shuffle and the join splits skewed keys: a line of a third of all texts is one gram
    place = F.xxhash64("sha", "pos")
    # stored, so that both sides of the join come straight from a shuffle, which is when skewed keys are split
    twice = stored(found.groupBy("key").agg(F.min(place).alias("l"), F.max(place).alias("h"), F.count("*").alias("n")).where("l <> h").select("key", "n"))
    cand = found.join(twice, "key")
    cand = cand.groupBy("sha").agg(F.collect_set(F.struct("key", "pos", "lo", "hi", (F.col("n") > hot).alias("hot"))).alias("cand"))
    some = stored(long.join(cand, "sha").select("sha", "text", "cand"))
    pick = lambda on: F.filter("cand", lambda c: c.hot if on else ~c.hot)
    cool = some.select("sha", "text", pick(False).alias("cand")).where(F.size("cand") > 0).mapInArrow(_cut(length), _RECORD)
    # spans that are known already have no key and go anywhere
    by = F.coalesce("key", F.xxhash64("sha", "lo"))
    spans = cool.repartition(by).sortWithinPartitions(F.col("key")).mapInArrow(_sort(length), "sha binary, s int, e int")
    heated = some.select("sha", "text", pick(True).alias("cand")).where(F.size("cand") > 0)
    if not heated.isEmpty():
        rec = stored(heated.mapInArrow(_cut(length), _RECORD))
        win = stored(rec.where("chunk is not null").mapInArrow(_windows(length), "d binary, sha binary, s int"))
        here = F.xxhash64("sha", "s")
        many = win.groupBy("d").agg(F.min(here).alias("l"), F.max(here).alias("h")).where("l <> h").select("d")
        spans = spans.unionByName(win.join(many, "d").select("sha", "s", (F.col("s") + length).alias("e")))
        spans = spans.unionByName(rec.where("chunk is null").select("sha", F.col("lo").alias("s"), (F.col("hi") + length).alias("e")))
    spans = spans.groupBy("sha").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return some, spans


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    hexed = docs.select("doc_id", text.alias("text")).withColumn("hex", F.sha2("text", 256))
    named = hexed.withColumn("sha", F.substring(F.unhex("hex"), 1, 16))
    some, spans = repeats(named.select("sha", "text"), length, gram, hot)
    done = some.select("sha", "text").join(spans, "sha").mapInArrow(_keep, "sha binary, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["sha"])
    rows = named.select("doc_id", "sha", "hex", F.octet_length("text").cast("long").alias("n_bytes"))
    copies = rows.groupBy("sha").agg(F.count("*").alias("copies"))
    known = copies.join(done, "sha", "left").where("copies > 1 or n_removed is not null")
    out = rows.join(known, "sha", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "hex")).alias("kept_sha256"),
    )


def brute_force(rows: list[tuple], length: int = LENGTH) -> dict:
    """What `digest` must give for (doc_id, text) rows with distinct ids, from a table of all windows."""
    count: dict[bytes, int] = defaultdict(int)
    raw = {i: (t or "").encode() for i, t in rows}
    for b in raw.values():
        for p in range(len(b) - length + 1):
            count[hashlib.md5(b[p : p + length]).digest()] += 1
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - length + 1):
            if count[hashlib.md5(b[p : p + length]).digest()] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        n = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(b), int(gone.sum()), n, hashlib.sha256(kept).hexdigest())
    return out
