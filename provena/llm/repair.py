"""Repair of a conversation's structure by dynamic programming over a trie of signatures.

Each row of a conversation is one letter of its signature: the kind of its role with its first fault
(blank, duplicate of an earlier row, truncated).  Everything that is asked about the structure, from the
counts of faults to the cheapest edits, is a function of the signature, and signatures are far fewer than
conversations.  The distinct ones are dealt out in sorted ranges; a task walks its part as a prefix
trie, whose path is a stack: a layer of costs is computed once for each shared prefix, and at a
signature's end the cheapest edits are read from the layers.

A layer holds the least cost to have consumed the rows so far and to have written no turn, a system
turn, a user turn or an assistant turn last.  Keep costs 0, giving a row another role 2, deleting it 3,
inserting an empty turn 2, and a truncated row that stays 1 more; blank rows and duplicates have to go.  The roles
must read `(s?(ua)+)?`.  Of equally cheap edits the least in ASCII order of the letters D, I, K, R wins.

Rows are put in order by a range sort on (conv_id, turn, role, text), so that a conversation of any number
of rows is spread over tasks; a row's number there, `at`, is unique, and later joins are on it.  A conversation's signature
and its edits are one value each, a letter or so a row; the digest also gathers a conversation's repaired text in one value.

Defined cases: rows of a conversation are in order of turn, nulls first, then of role, the text's first 32
characters and its hash; a null conversation id is one conversation; a role without an initial can't be kept; long texts are
one row like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from provena.session import small_batches, stored

SPACE = r"\x20\x09-\x0D"
KEEP, ROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
FAULTS = ("ok", "blank", "duplicate", "truncated")
KINDS = "suax"  # system, user, assistant, any other
#: A signature's letters: kind and fault, A to P.
LETTERS = {chr(65 + 4 * k + f): (kind, fault) for k, kind in enumerate(KINDS) for f, fault in enumerate(FAULTS)}
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 30
LEGAL = ("su", "ua", "au")
#: Answers in one Arrow batch.
BLOCK = 1000


def _moves(letter: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, step) of one row; a step is K, D, or the capital of a new role."""
    kind, fault = LETTERS[letter]
    out = [(s, s, DELETE, "D") for s in range(4)]
    if fault in ("ok", "truncated"):
        more = CUT_OFF if fault == "truncated" else 0
        for was, now in ((BEGIN, SYSTEM), (BEGIN, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
            name = "-sua"[now]
            if name == kind:
                out.append((was, now, KEEP + more, "K"))
            elif now != SYSTEM:
                out.append((was, now, ROLE + more, name.upper()))
    return out


MOVES = {x: _moves(x) for x in LETTERS}
#: Inserted turns lead from one state to another within a layer.
INSERTS = [(BEGIN, USER, "u"), (SYSTEM, USER, "u"), (ASSISTANT, USER, "u"), (USER, ASSISTANT, "a")]
#: What a step is called in an audit, for the order of ties.
AUDIT = str.maketrans("uaUA", "IIRR")


def _closed(layer: list[int]) -> list[int]:
    """The layer with inserted turns; two rounds, since no cheapest path inserts three in a row."""
    for _ in range(2):
        for was, now, _step in INSERTS:
            layer[now] = min(layer[now], layer[was] + INSERT)
    return layer


class Trie:
    """The path of a walk over sorted signatures: letters, and four costs for each depth."""

    def __init__(self) -> None:
        self.path = ""
        self.costs = array("q", _closed([0, FAR, FAR, FAR]))
        self.layers = 1  # computed so far

    def go(self, signature: str) -> None:
        """Leave what the last signature doesn't share, and compute the layers of the rest."""
        shared, most = 0, min(len(self.path), len(signature))
        while shared < most and self.path[shared] == signature[shared]:
            shared += 1
        del self.costs[4 * (shared + 1) :]
        for letter in signature[shared:]:
            before, now = self.costs[-4:], [FAR] * 4
            for was, to, cost, _step in MOVES[letter]:
                now[to] = min(now[to], before[was] + cost)
            self.costs.extend(_closed(now))
            self.layers += 1
        self.path = signature

    def answer(self) -> tuple[int, str]:
        """(cost, steps) at the end of the path: for each row its inserted roles, in small letters, and its step."""
        n, costs = len(self.path), self.costs
        end = min((BEGIN, ASSISTANT), key=lambda s: costs[4 * n + s])
        best = costs[4 * n + end]
        # which states lie on a cheapest way, from the end back: one bit a state
        good = bytearray(n + 1)
        good[n] = sum(1 << s for s in (BEGIN, ASSISTANT) if costs[4 * n + s] == best)
        for i in range(n, -1, -1):
            at = costs[4 * i : 4 * i + 4]
            for _ in range(2):
                for was, now, _step in INSERTS:
                    if good[i] >> now & 1 and at[was] + INSERT == at[now]:
                        good[i] |= 1 << was
            if i:
                before = costs[4 * i - 4 : 4 * i]
                for was, to, cost, _step in MOVES[self.path[i - 1]]:
                    if good[i] >> to & 1 and before[was] + cost == at[to]:
                        good[i - 1] |= 1 << was
        # forwards along those states, the least letter first; a letter leads from a state to one other
        i, state, steps = 0, BEGIN, []
        while i < n or not (state in (BEGIN, ASSISTANT) and costs[4 * n + state] == best):
            here, options = costs[4 * i + state], []
            for was, now, step in INSERTS:
                if was == state and good[i] >> now & 1 and here + INSERT == costs[4 * i + now]:
                    options.append((step.translate(AUDIT), i, now, step))
            if i < n:
                for was, to, cost, step in MOVES[self.path[i]]:
                    if was == state and good[i + 1] >> to & 1 and here + cost == costs[4 * i + 4 + to]:
                        options.append((step.translate(AUDIT), i + 1, to, step))
            _, i, state, step = min(options)
            steps.append(step)
        return best, "".join(steps)


def answers(signatures: Iterator[str]) -> Iterator[tuple[str, int, int, int, int, int, str]]:
    """(signature, blank, duplicate, truncated, illegal, cost, steps) of sorted signatures."""
    trie = Trie()
    for s in signatures:
        trie.go(s)
        pairs = re.sub("[A-P]", lambda m: LETTERS[m[0]][0], s)
        counts = [sum(s.count(x) for x, (_, f) in LETTERS.items() if f == fault) for fault in FAULTS[1:]]
        illegal = sum(pairs[i : i + 2] not in LEGAL for i in range(len(pairs) - 1))
        yield s, *counts, illegal, *trie.answer()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by a checksum of conversation and turn, and nulls as one space.

    Of twenty values, 0 drops the row, 1 empties its text, 2 takes its ends of sentences away, 3 repeats it and 4 makes its role user.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), d.alias("d")).where("d != 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _kind(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def ordered(rows: DataFrame) -> DataFrame:
    """Stored rows with their number `at`, which grows by one from row to row of a conversation within a part.

    `blank` and `open` are the faults that a row shows by itself.
    """
    r = rows.select("conv_id", "turn", "role", "text").withColumn("head", F.substring("text", 1, 32)).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    r = r.withColumn("tie", F.monotonically_increasing_id())  # spreads equal rows, whose order doesn't matter
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "digest", "tie"]
    r = r.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut_off = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    return stored(r.select("conv_id", "turn", "role", "text", "digest", "at", blank.alias("blank"), cut_off.alias("open")))


def _part() -> Column:
    return F.shiftright("at", 33).alias("part")


def signed(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, pieces) of ordered rows; a piece is (first number, rows) of one part.

    The first of equal rows is found by a least number for each (conversation, role, hash), which combines before the shuffle,
    and marked by a join on the number itself, so no key is hot.
    """
    first = rows.where(~F.col("blank")).groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    r = rows.select("conv_id", "at", _kind(F.col("role")).alias("kind"), "blank", "open").join(first, "at", "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("open"), 3).otherwise(0)
    letter = F.char(65 + 4 * (F.instr(F.lit(KINDS), F.col("kind")) - 1) + fault)
    pieces = r.groupBy("conv_id", _part()).agg(F.sort_array(F.collect_list(F.struct("at", letter.alias("letter")))).alias("letters"))
    piece = F.struct(F.col("letters")[0]["at"].alias("at"), F.size("letters").alias("rows"), F.array_join(F.transform("letters", lambda x: x.letter), "").alias("letters"))
    whole = pieces.select("conv_id", piece.alias("piece")).groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("ps"))
    return whole.select("conv_id", F.array_join(F.transform("ps", lambda p: p.letters), "").alias("signature"), F.transform("ps", lambda p: F.struct(p["at"].alias("at"), p["rows"].alias("rows"))).alias("pieces"))


def solved(signatures: DataFrame) -> DataFrame:
    """Answers for the distinct values of the column `signature`, each task over a sorted range of them."""
    small_batches(signatures.sparkSession)
    names = ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "steps"]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]

    def run(batches):
        walk = answers(s for batch in batches for s in batch.column(0).to_pylist())
        while block := list(islice(walk, BLOCK)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block, strict=True), kinds, strict=True)], names=names)

    distinct = signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return distinct.mapInArrow(run, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, steps string")


def reports(rows: DataFrame) -> DataFrame:
    """Of ordered rows, for each conversation: gaps, counts of faults, cost, audit, steps and pieces."""
    signs = stored(signed(rows))
    out = signs.join(stored(solved(signs)), "signature")
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") - (F.count("turn") - 1)).alias("gaps"))
    out = out.withColumn("audit", F.translate("steps", "uaUA", "IIRR"))
    return out.join(turns, out.conv_id.eqNullSafe(turns.conv_id), "left").select(out.conv_id, F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "steps", "pieces")


def _turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, at, k, role, text): turns of a row's number are numbered by k, inserted ones before the row's own."""
    ats = F.flatten(F.transform("pieces", lambda p: F.sequence(p["at"], p["at"] + p["rows"] - 1)))
    step = F.regexp_extract_all("steps", F.lit("[ua]*[KDUA](?:[ua]+$)?"), F.lit(0))
    per = found.select(F.explode(F.arrays_zip(ats.alias("at"), step.alias("step"))).alias("x")).select("x.at", "x.step")
    r = rows.select("conv_id", "at", "role", "text").join(per.where("step != 'D'"), "at")
    new = F.transform(F.split("step", ""), lambda c, k: F.struct(
        k.alias("k"),
        F.when(c.isin("u", "U"), "user").when(c.isin("a", "A"), "assistant").otherwise(F.col("role")).alias("role"),
        F.when(c.isin("u", "a"), "").otherwise(F.col("text")).alias("text"), c.alias("c")))
    return r.select("conv_id", "at", F.explode(new).alias("t")).where("t.c NOT IN ('D', '')").select("conv_id", "at", "t.k", "t.role", "t.text")


def repaired(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) of the repaired conversations, turns from 0 on."""
    from pyspark.sql import Window

    rows = ordered(_plain(conversations))
    t = stored(_turns(rows, reports(rows)))
    # a turn's number: turns of earlier parts, and its place in its own part
    parts = t.groupBy("conv_id", _part()).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("conv_id").alias("pc"), F.col("part").alias("pp"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at", "k")) - 1
    t = t.withColumn("part", _part()).withColumn("place", place)
    return t.join(parts, t.conv_id.eqNullSafe(parts.pc) & (t.part == parts.pp)).select("conv_id", (F.col("before") + F.col("place")).alias("turn"), "role", "text")


def _plain(conversations: DataFrame) -> DataFrame:
    """Rows with nulls as one space."""
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def digest(conversations: DataFrame) -> DataFrame:
    """The report of each original conversation after damage, with a hash of its repaired text."""
    rows = ordered(damaged(conversations))
    found = stored(reports(rows))
    lines = _turns(rows, found).select("conv_id", _part(), "at", "k", F.concat("role", F.lit(":"), "text").alias("line"))
    pieces = lines.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "k", "line"))).alias("ls"))
    pieces = pieces.select("conv_id", F.struct("part", F.array_join(F.transform("ls", lambda x: x.line), "\n").alias("text")).alias("p"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p.text), "\n")
    texts = pieces.groupBy("conv_id").agg(F.sha2(text.cast("binary"), 256).alias("repaired_sha256")).withColumnRenamed("conv_id", "tc")
    found = found.drop("steps", "pieces").withColumnRenamed("conv_id", "fc")
    every = conversations.select("conv_id").distinct()
    out = every.join(found, every.conv_id.eqNullSafe(found.fc), "left").join(texts, every.conv_id.eqNullSafe(texts.tc), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
