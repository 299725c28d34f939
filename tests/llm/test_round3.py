"""Fill-in-middle, conversation repair and language identification against brute force, and on odd and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from provena.llm import fim, langid, registry, repair
from tests.llm.conftest import odd_rows

# fill-in-middle

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", "char": r"(?s)."}


def fim_brute(text, doc_id, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    assert "".join(units) == text
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\r\té가😀<P>SM", max_size=60), st.integers(-5, 10**12), st.sampled_from(sorted(PATTERNS)))
def test_fim_cuts_as_units_do(text, doc_id, unit):
    n, form, pre, mid, out = fim.cut(text.encode(), doc_id, fim.Settings(unit=unit))
    assert (n, form, pre, mid, out.decode()) == fim_brute(text, doc_id, unit)


@pytest.mark.parametrize("width", [1, 63, 64, 65, 1000, 5003])
def test_select_finds_every_ranked_bit(width):
    rng = random.Random(width)
    bits = rng.getrandbits(width) | 1
    places = [i for i in range(width) if bits >> i & 1]
    assert [fim.select(bits, k, width) for k in range(len(places))] == places
    assert fim.select(bits, len(places), width) == width and fim.select(0, 0, width) == width


@pytest.mark.parametrize("given_settings", [fim.Settings(), fim.Settings("word", 3, 70, 20), fim.Settings("char", 9, 100, 100)])
def test_fim_brute_force_and_round_trip(spark, odd, docs, given_settings):
    s = given_settings
    for df in (odd, docs):
        out = fim.transform(df, s)
        assert out.columns == [*df.columns, "n", "form", "prefix_chars", "middle_chars", "output"] if "n" not in df.columns else True
        got = out.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored().alias("back")).collect()
        assert Counter(tuple(r)[:7] for r in got) == Counter((r.doc_id, r.text, *fim_brute(r.text, r.doc_id, s.unit, s.seed, s.rate, s.spm)) for r in df.select("doc_id", "text").collect())
        assert all(r.back == (r.text or "") for r in got)


def test_fim_long_sentinels_and_empty(spark, none):
    assert fim.transform(none).count() == 0
    long = ("line of é text\n" * 150_000)[:-1]  # two megabytes
    rows = [(1, long), (2, "a<M>b\n"), (3, None), (None, "x\ny\n"), (5, "<"), (6, "\n\n\n")]
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", fim.restored()).collect()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim_brute(r.text, r.doc_id) and r.back == (r.text or "")
    assert {r.doc_id: r.form for r in got}[2] == "plain" and {r.doc_id: r.n for r in got}[6] == 3


def test_fim_replaces_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "a\nb", "old", "x")], "doc_id long, text string, form string, `a.b` string")
    r = fim.transform(df).first()
    assert r.form in ("psm", "spm") and r["a.b"] == "x"


# repair of conversations


def cheapest(letters):
    """(cost, audit) by Dijkstra over (row, state, audit): every order of edits is tried, ties by the audit."""
    import heapq

    todo, done = [(0, "", 0, "")], set()
    while todo:
        cost, audit, i, said = heapq.heappop(todo)
        if i == len(letters) and said in ("", "a"):
            return cost, audit
        if (i, said, audit) in done or cost > 40:
            continue
        done.add((i, said, audit))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[said]
        for role in follows:
            if role != "s":
                heapq.heappush(todo, (cost + 2, audit + "I", i, role))
        if i < len(letters):
            kind, fault = letters[i]
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, said))
            if fault in ("ok", "truncated"):
                for role in follows:
                    if role == kind:
                        heapq.heappush(todo, (cost + (fault == "truncated"), audit + "K", i + 1, role))
                    elif role != "s":
                        heapq.heappush(todo, (cost + 2 + (fault == "truncated"), audit + "R", i + 1, role))
    raise AssertionError


def test_trie_finds_cheapest_edits_of_all_short_signatures():
    of = {v: k for k, v in repair.LETTERS.items()}
    every = [(k, f) for k in repair.KINDS for f in ("ok", "blank", "truncated")]
    signatures = [s for n in range(4) for s in itertools.product(every, repeat=n)]
    rng = random.Random(5)
    signatures += [tuple(rng.choice(every) for _ in range(rng.randrange(4, 7))) for _ in range(150)]
    by = {"".join(of[x] for x in s): s for s in signatures}
    for sign, blank, dup, cut, illegal, cost, steps in repair.answers(iter(sorted(by))):
        s = by[sign]
        assert (cost, steps.translate(repair.AUDIT)) == cheapest(s), s
        assert (blank, dup, cut) == tuple(sum(f == x for _, f in s) for x in ("blank", "duplicate", "truncated"))
        assert illegal == sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(s))


def test_trie_computes_shared_prefixes_once():
    trie = repair.Trie()
    for s in ("AEI", "AEIE", "AEIF", "AF"):
        trie.go(s)
    assert trie.layers == 1 + 3 + 1 + 1 + 1


def conversations_brute(rows):
    """The contract's columns of each conversation, row by row in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        damaged = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if d == 0:
                continue
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            damaged += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in damaged:
            solid = re.findall("[^\\x20\\x09-\\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "ok")
            seen.add((role, text))
        kinds = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "x" for r in damaged]
        turns = [r[0] for r in damaged if r[0] is not None]
        cost, audit = cheapest([(k, "blank" if f == "duplicate" else f) for k, f in zip(kinds, faults)])
        lines, i, last = [], 0, ""
        for e in audit:
            nxt = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            if e == "I":
                lines.append(nxt + ":")
                last = nxt[0]
                continue
            _, role, text = damaged[i]
            i += 1
            if e != "D":
                role = role if e == "K" else nxt
                lines.append(f"{role}:{text}")
                last = role[0]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_conversations():
    rng = random.Random(3)
    says = ["Hi.", "Hi", "", " \t\n", None, "What? now", "Long. " * 40, "é!", "a\r\n."]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(says)) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(None, 1, "user", "Q?"), (None, None, None, None), (70, None, "user", "a."), (70, None, "user", "a."), (70, 3, "assistant", "b."), (71, 5, "assistant", "x" * 300_000)]
    return rows + rows[:5] * 2


def test_repair_brute_force(spark, none):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, `at` string, kind int").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair.digest(df).collect()}
    assert got == conversations_brute(rows)
    assert repair.digest(df.limit(0)).count() == 0


def test_every_signature_of_a_large_part_is_answered(spark):
    """A part has more signatures than a batch: none may be lost between two batches."""
    signatures = ["".join(s) for s in itertools.product("AEFIK", repeat=5)]
    df = spark.createDataFrame([(s,) for s in signatures], "signature string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = sorted(r.signature for r in repair.solved(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(signatures) > 3000 and got == signatures


def test_repair_gaps_of_turns_far_apart(spark):
    """The span of turns alone may exceed a long where gaps don't."""
    for first in (0, -1):  # whichever turns the damage leaves
        rows = [(c, t, "user", "Hi.") for c in range(5) for t in (first, 2**63 - 2 + first + 1)]
        got = {r.conv_id: tuple(r)[1:] for r in repair.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
        assert got == conversations_brute(rows)


def test_repair_of_one_conversation_over_many_parts(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"Said {t % 50}." if t % 7 else "cut") for t in range(3000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = repair.ordered(repair._plain(df))
        assert ordered.where("conv_id = 1").select(F.shiftright("at", 33)).distinct().count() > 1
        found = repair.reports(ordered).where("conv_id = 1").first()
        out = [tuple(r) for r in repair.repaired(df).where("conv_id = 1").orderBy("turn").select("turn", "role").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [t for t, _ in out] == list(range(len(out))) and [r for _, r in out] == ["user", "assistant"] * (len(out) // 2)
    assert len(found.audit) - found.audit.count("I") == 3000 and found.audit.count("D") >= found.duplicate > 2000


# language identification


def kneser_ney(text, texts):
    """Bits a character of `text` under an interpolated model of `texts`, straight from the formulas."""
    n = langid.ORDER
    def chars(t):
        return re.sub(" +", " ", "".join(ch if ch.isalpha() else " " for ch in t.lower())).lstrip(" ")

    full = Counter()
    for t in texts:
        s = " " * (n - 1) + chars(t)
        full.update(s[i - n + 1 : i + 1] for i in range(n - 1, len(s)))
    counts = {n: full}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    totals, parts, discount = {}, {}, {}
    for k, c in counts.items():
        totals[k], parts[k] = Counter(), Counter()
        for g, x in c.items():
            totals[k][g[:-1]] += x
            parts[k][g[:-1]] += 1
        n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        discount[k] = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    return counts, totals, parts, discount, chars


def kn_entropy(text, model, alphabet):
    counts, totals, parts, discount, chars = model
    n = langid.ORDER

    def p(g):
        k = len(g)
        if not k:
            return 1 / alphabet
        h, d = g[:-1], discount[k]
        if not totals[k][h]:
            return p(g[1:])
        return max(counts[k][g] - d, 0) / totals[k][h] + d * parts[k][h] / totals[k][h] * p(g[1:])

    # a count of one below the discount can't be
    s = " " * (n - 1) + chars(text)
    places = range(n - 1, len(s))
    return -sum(math.log2(p(s[i - n + 1 : i + 1])) for i in places) / len(places)


def test_langid_is_kneser_ney(spark):
    rng = random.Random(1)
    words = {"aa": "banana ananas bandana nabana".split(), "bb": "křížek êtres žluť kůň être".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 30))) + rng.choice(["", ".", "  !\n"]), lang) for i in range(160) for lang in [rng.choice(["aa", "bb"])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(df, calibration_rows=0)
    learned = defaultdict(list)
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            learned[lang].append(t)
    brute = {lang: kneser_ney("", ts) for lang, ts in learned.items()}
    alphabet = 1 + len({g[-1] for m in brute.values() for g in m[0][langid.ORDER]})
    tests = ["banana křížek", "a", "zzz žluť!", "Ananas, BANDANA", "1 x 2"]
    h, n = langid.entropies(pa.array(tests), model.models)
    assert model.languages == ("aa", "bb")
    for i, t in enumerate(tests):
        assert np.allclose(h[i], [kn_entropy(t, brute[lang], alphabet) for lang in model.languages], rtol=1e-4)


def test_langid_probabilities_sum_to_one_when_pruned(spark, docs):
    model = langid.train(docs, max_keys=8000)
    assert sum(len(k) for m in model.models for k in m.keys) <= 8000
    for m in model.models:
        codes = np.unique(np.concatenate([k >> (langid.BITS * i) for i, k in enumerate(m.keys) if len(k)]))
        # any context, seen or not: the known characters and the share of unknown ones
        for context in (0, int(m.contexts[-1][0]), int(m.contexts[-1][-1]), 12345678):
            g = (codes.astype(np.int64) << (langid.BITS * (langid.ORDER - 1))) | context
            assert 0.9 < np.exp2(langid.logs2(m, g)).sum() < 1.001


def test_langid_held_out_accuracy_and_rejection(spark, docs):
    model = langid.train(docs)
    out = langid.identify(docs.withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0), model).collect()
    held = [r for r in out if r.held]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and sum(r.accepted for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    foreign = spark.createDataFrame([(1, "Это совсем другой язык, его никто не учил."), (2, "xq zvw kkj qqx wvz jjk pqz xxk vvq")], "doc_id long, text string")
    assert not any(r.accepted for r in langid.identify(foreign, model).collect())


def test_langid_odd_and_empty(spark, odd, none, docs):
    model = langid.train(odd)
    out = langid.identify(odd, model)
    assert out.columns == [*[c for c in odd.columns if c != "score"], "lang_pred", "score", "accepted", "entropy"] and out.count() == odd.count()
    for r in out.collect():
        letters = any(ch.isalpha() for ch in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.score, r.accepted, r.entropy) == (0, False, None))
    by = defaultdict(set)
    for r in out.collect():
        by[r.text].add((r.lang_pred, r.score))
    assert all(len(v) == 1 for v in by.values())
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"} and langid.identify(none, model).count() == 0


def test_langid_reads_long_texts_in_slices(spark, docs, monkeypatch):
    model = langid.train(docs)
    texts = pa.array(["the reed " * 2000, None, "", "É" * 10, "der die das " * 500])
    whole = langid.entropies(texts, model.models)
    monkeypatch.setattr(langid, "SLICE", 997)
    parts = langid.entropies(texts, model.models)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_new_queries_are_whole(spark, smoke):
    n = spark.read.parquet(f"{smoke}/documents.parquet").count()
    for name in ("op11_fim", "op13_langid"):
        assert registry.queries()[name](spark, smoke).count() == n
    assert odd_rows()
