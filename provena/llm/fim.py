"""Fill-in-middle transformation by bit-parallel integers.

A text is one big integer for each class of bytes: `bytes.translate` maps the bytes of the class to
ones, and the digits, last byte first, are read as a binary number, so that bit i is byte i.  Shifted
boolean operations turn class masks into a mask of the places where units start, `bit_count` gives the
number of units, and the place of the k-th start is found by halving the mask: the half that holds the
k-th bit stays, until a machine word is left.  All of it is linear in the text, with a bit a byte.

Two cuts, drawn by a hash of seed and document id, divide the units into prefix, middle and suffix;
further hashed draws choose between the plain text and the orders prefix-suffix-middle (psm) and
suffix-prefix-middle (spm).  A retry or another partitioning draws the same.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, is plain; a null id
draws like an empty one; rows of one id and one text have one result; long texts are cut whole, a bit a
byte; an empty table gives no rows; extra columns are kept, but those named as new columns (n, form,
prefix_chars, middle_chars, output) are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from provena.session import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEW = "n long, form string, prefix_chars long, middle_chars long, output string"
#: Masks of at most so many bits are searched bit by bit.
WORD = 64


def _class(members) -> bytes:
    return bytes(49 if b in members else 48 for b in range(256))


NEWLINE = _class({10})
SPACE = _class({9, 10, 11, 12, 13, 32})
#: Bytes of UTF-8 that continue a character.
CONTINUES = _class(range(128, 192))


def mask(data: bytes, members: bytes) -> int:
    """Bit i is set where byte i is in the class."""
    return int(data[::-1].translate(members), 2) if data else 0


def line_starts(data: bytes) -> int:
    """The first byte, and every byte after a line feed."""
    full = (1 << len(data)) - 1
    return (mask(data, NEWLINE) << 1 | 1) & full


def word_starts(data: bytes) -> int:
    """The first byte, and every byte outside white space that follows white space; a word takes the white space after it along."""
    full = (1 << len(data)) - 1
    space = mask(data, SPACE)
    return (space << 1 & ~space | 1) & full


def char_starts(data: bytes) -> int:
    return ((1 << len(data)) - 1) ^ mask(data, CONTINUES)


UNITS = {"line": line_starts, "word": word_starts, "char": char_starts}


def select(bits: int, k: int, width: int) -> int:
    """The place of the k-th set bit, from 0; `width` where there are no more than k.

    Each step counts half of what is left, so the whole search reads the mask about twice.
    """
    at, left = 0, width
    if bits.bit_count() <= k:
        return width
    while left > WORD:
        half = left >> 1
        low = bits & ((1 << half) - 1)
        here = low.bit_count()
        if k < here:
            bits, left = low, half
        else:
            bits, k, at, left = bits >> half, k - here, at + half, left - half
    for _ in range(k):
        bits &= bits - 1
    return at + (bits & -bits).bit_length() - 1


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of seed and document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


@dataclass(frozen=True)
class Settings:
    """`rate`: texts in a hundred that are transformed; `spm`: of those, in a hundred, in the order suffix-prefix-middle."""

    unit: str = "line"
    seed: int = 7
    rate: int = 100
    spm: int = 50


def cut(data: bytes, doc_id: int | None, s: Settings) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    h1, h2, h3, h4 = draws(s.seed, doc_id)
    starts = UNITS[s.unit](data) if data else 0
    n = starts.bit_count()
    if not data or any(x.encode() in data for x in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= s.rate:
        return n, "plain", None, None, data
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p = select(starts, a, len(data))
    m = p if b == a else select(starts, b, len(data))
    chars = char_starts(data)
    before, up_to = (chars & ((1 << p) - 1)).bit_count(), (chars & ((1 << m) - 1)).bit_count()
    head, mid, tail = data[:p], data[p:m], data[m:]
    P, S, M = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    spm = h4 % 100 < s.spm
    out = b"".join((S, tail, P, head, M, mid) if spm else (P, head, S, tail, M, mid))
    return n, "spm" if spm else "psm", before, up_to - before, out


def transform(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`docs` with the number of units, the form, characters of prefix and middle, and the output."""
    small_batches(docs.sparkSession)
    new = [x.split()[0] for x in NEW.split(", ")]
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in new])
    names, at, key = docs.columns, docs.columns.index("text"), docs.columns.index("doc_id")
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots can't be sent as they are
    schema = docs.selectExpr("*", *[f"cast(null AS {x.split()[1]}) AS {x.split()[0]}" for x in NEW.split(", ")]).schema

    def run(batches):
        for batch in batches:
            texts, ids = batch.column(at).cast(pa.binary()), batch.column(key)
            rows = [cut(t.as_py() or b"", i.as_py(), settings) for t, i in zip(texts, ids, strict=True)]
            n, form, pre, mid, out = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, schema).toDF(*names, *new)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output of a form was made from; no text that is transformed holds a sentinel, so the first one of a kind is the right one."""
    o, f = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    size = len(PREFIX)

    def between(first: str, second: str) -> Column:
        inner, middle = F.instr(o, second), F.instr(o, MIDDLE)
        one = F.substr(o, F.lit(size + 1), inner - size - 1)
        two = F.substr(o, inner + size, middle - inner - size)
        mid = F.substr(o, middle + size)
        return F.concat(one, mid, two) if first == PREFIX else F.concat(two, mid, one)

    return F.when(f == "psm", between(PREFIX, SUFFIX)).when(f == "spm", between(SUFFIX, PREFIX)).otherwise(o)


def digest(out: DataFrame) -> DataFrame:
    """Hashes of the outputs and of what is rebuilt from them."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))
