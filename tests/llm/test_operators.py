"""The text operators against brute force, and on odd and empty tables."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provena.llm import chat, components, decontaminate, imatch, licenses, mixing, neardup, registry, secrets, shard, suffix, toxicity, vec
from tests.compare import connect, rows
from tests.llm.conftest import odd_rows

pytestmark = pytest.mark.filterwarnings("ignore")


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, smoke, name):
    got = registry.queries()[name](spark, smoke).toPandas()
    assert rows(got) == rows(connect(smoke).execute(registry.oracle_sql()[name]).df())


# decontamination


ITEMS = [(1, "a b c d"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(20))), (None, "one"), (5, "A, b; C d")]


def test_decontamination_brute_force(spark, odd):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = Counter((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(decontaminate.judge(odd, bench)).collect())
    items = [("null" if i is None else i, t) for i, t in ITEMS]
    assert got == Counter(decontaminate.brute_force(r[1], items) for r in odd_rows())


def test_decontamination_in_blocks(docs, spark, smoke):
    bench = spark.read.parquet(f"{smoke}/benchmark.parquet")
    one = decontaminate.digest(decontaminate.judge(docs, bench)).collect()
    many = decontaminate.digest(decontaminate.judge(docs, bench, pass_bytes=2000)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    assert sum(r.n_hit > 0 for r in one) > 0


def test_decontamination_keeps_columns_and_bears_empty_tables(spark, odd, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.judge(none, bench).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()


def test_wu_manber_finds_overlapping_patterns():
    engine = decontaminate.tables(pa.array([b"a b a", None, b"B, a b"]))[0]
    (_, _, *words), = decontaminate.words_of(pa.array(["a b a b z", ""]))
    low, starts, ends, h, at = words
    assert sorted((e, o.tolist()) for e, o in engine.scan(low, starts, ends, h, at)) == [(3, [0]), (4, [2])]


def test_wu_manber_jumps_over_positions_and_misses_none():
    rng = np.random.default_rng(1)
    say = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 2000, n))
    items = [say(n) for n in (40, 13, 7, 3, 1, 300)]
    texts = [say(3000) + " " + x + " " + say(700) for x in items for _ in range(3)] + [items[0] * 2, "", "w1"]
    engines = decontaminate.tables(pa.array(items))
    got, looked = [[0, set()] for _ in texts], 0
    for lo, _, low, starts, ends, h, at in decontaminate.words_of(pa.array(texts)):
        for engine in engines:
            looked += len(engine.candidates(h, at)) if engine.m == 13 else 0
            for e, owners in engine.scan(low, starts, ends, h, at):
                got[lo + int(np.searchsorted(at, e, "left")) - 1][1] |= set(owners.tolist())
    for t, (_, found) in zip(texts, got, strict=True):
        assert found == {i for i, x in enumerate(items) if any(f" {' '.join(x.split()[k : k + 13])} " in f" {t} " for k in range(max(1, len(x.split()) - 12)))}
    assert looked < 3000  # of 67,000 places


def test_decontamination_tables_are_small():
    text = pa.array([" ".join(f"word{(i * j) % 9973}" for j in range(2000)) for i in range(1, 120)])
    size = sum(len(x) for x in text.to_pylist())
    (t,) = decontaminate.tables(text)
    held = sum(x.nbytes for x in (t.shift, t.key, t.first, t.owner, t.data, t.starts, t.ends))
    assert held < 12 * size


# chat


TRICKY = ["", "</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "<s><s>", "<<SYS>>x<</SYS>>", "a < b [c] </S>", "é\n\t$1\\2", "[/INST]</s>[INST]user[/INST]"]


def test_chat_round_trip(spark):
    data = [(c, i, r, t) for c in range(3) for i, (r, t) in enumerate((("user" if (i + c) % 2 else "assistant"), t) for i, t in enumerate(TRICKY))]
    turns = spark.createDataFrame([*data, (9, None, None, None), (None, 1, "assistant", "x"), (9, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(turns)).collect()}
    for c in range(3):
        assert [(t.role, t.text) for t in back[c].turns] == [(r, t) for k, _, r, t in data if k == c]
        assert back[c].loss_text == "".join(t for k, _, r, t in data if k == c and r == "assistant")
        assert len(re.findall(r"\[INST\]", back[c].formatted)) == len(TRICKY)
    assert [(t.role, t.text) for t in back[9].turns] == [("", ""), ("assistant", "")]
    assert back[None].loss_text == "x"
    assert chat.digest(turns.limit(0)).count() == 0


RECORDS = [
    ('{"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}', [("user", "q"), ("assistant", "a")]),
    ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a", "weight": 1}], "conv_id": 2, "model": {"name": "m"}}', [("user", "q"), ("assistant", "a")]),
    ('{"conv_id": 3, "prompt": "q", "response": "a", "extra": [1, 2]}', [("user", "q"), ("assistant", "a")]),
    ('{"conv_id": 4, "instruction": "q", "input": "more", "output": "a"}', [("user", "q\nmore"), ("assistant", "a")]),
    ('{"conv_id": 5, "instruction": "q", "output": "a"}', [("user", "q"), ("assistant", "a")]),
    ('{"conv_id": 6, "system": "s", "prompt": "q", "response": null}', [("system", "s"), ("user", "q"), ("assistant", None)]),
    ('{"conv_id": 7, "messages": []}', []),
    ('{"conv_id": 8, "messages": [{"role": "user"}, {"content": "a"}]}', [("user", None), (None, "a")]),
    ('{"conv_id": 9, "data": {"turns": [{"speaker": "user", "text": "q"}], "n": 1}}', [("user", "q")]),
    ('{"conv_id": 10, "turn": 4, "role": "user", "text": "q"}', [("user", "q")]),
    ('{"conv_id": 11, "system": "s", "instruction": "q", "input": "", "output": "a"}', [("system", "s"), ("user", "q"), ("assistant", "a")]),
]
STRANGE = ['{"conv_id": 5, "something": "else"}', "not json", None, "[]", '{"conv_id": 1, "prompt": "q", "response": "a", "instruction": "i", "output": "o"}', '{"conv_id": 1, "prompt": "q"}']


def test_chat_mixed_layouts(spark):
    df = spark.createDataFrame([(r,) for r in [x for x, _ in RECORDS] + STRANGE], "record string").withColumn("conv_id", F.lit("clash"))
    got = {}
    for r in chat.from_json(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {i: turns for i, (_, turns) in enumerate(RECORDS, 1) if turns}
    left = [r.record for r in chat.unknown(df).collect()]
    assert sorted(left, key=str) == sorted(STRANGE, key=str)
    with pytest.raises(ValueError, match="no layout"):
        chat.from_table(spark.range(1))


def test_chat_fingerprints_of_tables_and_records_agree(spark):
    for lay in chat.LAYOUTS:
        row = spark.createDataFrame([], lay.like).schema
        empty = lambda t: {f.name: empty(f.dataType) for f in t} if hasattr(t, "fields") else [empty(t.elementType)] if hasattr(t, "elementType") else "x"
        record = spark.createDataFrame([(json.dumps(empty(row)),)], "record string").select(chat.record_key().alias("k")).first().k
        assert record == chat.fingerprint(chat.paths(row))
        assert chat.mappings()[record] == chat.LAYOUTS.index(lay)


def test_chat_long_texts(spark):
    said = "</s>x[INST]" * 20_000
    back = chat.read_back(chat.formatted(spark.createDataFrame([(1, 0, "assistant", said), (1, 1, "user", said)], "conv_id long, turn long, role string, text string"))).first()
    assert (back.loss_text, back.turns[1].text) == (said, said)


# suffix sorting


def test_deep_shallow_orders_like_sorted():
    rng = np.random.default_rng(3)
    s = [bytes(rng.integers(97, 99, rng.integers(0, 300), dtype=np.uint8)) for _ in range(200)]
    s += [b"q" * 120 + x for x in s[:60]] + s[:10]
    assert [s[i] for i in suffix.deep_shallow(s)] == sorted(s)


@pytest.mark.parametrize(("length", "gram", "hot"), [(40, 8, 50_000), (40, 8, 1), (100, 16, 50_000)])
def test_suffix_dedup_brute_force(spark, length, gram, hot):
    data = [(i, r[1]) for i, r in enumerate(odd_rows())]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(df, length, gram, hot).collect()}
    assert got == suffix.brute_force(data, length)


def test_suffix_dedup_smoke(docs, odd, none):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(docs).collect()}
    assert got == suffix.brute_force(plain(docs))
    assert suffix.digest(odd).count() == odd.count()
    assert suffix.digest(none).count() == 0


# mixing


def test_mixing_follows_its_weights(docs):
    m = mixing.mix(docs, max_epochs=2.0)
    s = m.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("weight").alias("w"), F.max("epoch").alias("e"), F.countDistinct("doc_id").alias("d")).collect()
    own = {r.source: r.d for r in docs.groupBy("source").agg(F.count("*").alias("d")).collect()}
    total, longest = sum(r.t for r in s), docs.select(F.max(mixing.tokens())).first()[0]
    for r in s:
        assert r.d == own[r.source]  # nothing is dropped
        assert r.e <= 2
        assert abs(r.t - r.w * total) <= 2 * longest
    assert sum(r.w for r in s) == pytest.approx(1)


def test_mixing_by_entropy_and_budget(docs):
    flat = mixing.plan(docs, max_epochs=None, entropy=np.log(20) - 1e-6).collect()
    w = np.array([r.weight for r in flat])
    assert -(w * np.log(w)).sum() >= np.log(20) - 2e-6
    small = mixing.mix(docs, budget=20_000.0, max_epochs=4.0)
    assert 18_000 < small.agg(F.sum("n_tokens")).first()[0] < 60_000
    with pytest.raises(ValueError, match="limit or a target"):
        mixing.plan(docs, max_epochs=None)


def weights_by_bisection(tokens, max_epochs, entropy, budget):
    total = sum(tokens.values())

    def weigh(a):
        u = {k: (t / total) ** a for k, t in tokens.items()}
        w = {k: x / sum(u.values()) for k, x in u.items()}
        reads = {k: w[k] / tokens[k] for k in w}
        b = budget or 1 / min(reads.values())
        return w, b, -sum(x * np.log(x) for x in w.values()), max(reads.values()) * b

    lo, hi = 0.0, 1.0
    good = (lambda a: weigh(a)[2] < entropy) if entropy else (lambda a: weigh(a)[3] <= max_epochs)
    if good(lo):
        hi = lo
    for _ in range(60):
        lo, hi = (lo, (lo + hi) / 2) if good((lo + hi) / 2) else ((lo + hi) / 2, hi)
    return weigh(hi)[:2]


@pytest.mark.parametrize(("max_epochs", "entropy", "budget"), [(2.0, None, None), (1.3, None, None), (4.0, None, 30_000.0), (None, 2.9, None), (3.0, None, 300_000.0)])
def test_mixing_brute_force(spark, docs, monkeypatch, max_epochs, entropy, budget):
    """Weights by plain bisection; in the last epoch of a source its rows are a prefix by (order, part) that just reaches the budget."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 256)
    tokens = {r.source: r.t for r in docs.groupBy("source").agg(F.sum(mixing.tokens()).alias("t")).collect()}
    if budget:
        budget = min(budget, max_epochs * sum(tokens.values()) * 0.99)
    w, total = weights_by_bisection(tokens, max_epochs, entropy, budget)
    got = mixing.mix(docs, max_epochs, entropy, budget).toPandas()
    order = F.xxhash64(F.lit(mixing.SEED), "k", "whole", "block")
    every = docs.withColumn("k", F.col("source")).withColumn("t", mixing.tokens()).withColumn("h", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text")).where("t > 0")
    blocks = spark.createDataFrame([(r.k, r.blocks, r.whole) for r in mixing.plan(docs, max_epochs, entropy, budget).collect()], "k string, blocks int, whole int")
    every = every.join(blocks, "k").withColumn("block", F.pmod(F.pmod("h", F.lit(mixing.MAX_BLOCKS)), F.col("blocks"))).withColumn("o", order).withColumn("q", mixing._part()).toPandas()
    for k, own in every.groupby("k"):
        want = round(w[k] * total)
        reads = Counter(got[(got.source == k) & (got.n_tokens > 0)].doc_id)
        whole = own.whole.iloc[0]
        assert abs(whole * tokens[k] - want) <= tokens[k]
        steps, upto, inside = own.groupby(["o", "q"]).agg(t=("t", "sum"), ids=("doc_id", list)).sort_index(), whole * tokens[k], set()
        for t, ids in steps.itertuples(index=False):
            if upto >= want - 1e-6 * want - 1:
                break
            upto, inside = upto + t, inside | set(ids)
        assert {i for i, n in reads.items() if n == whole + 1} == inside
        assert {n for i, n in reads.items() if i not in inside} <= {whole}
        assert got[got.source == k].weight.iloc[0] == pytest.approx(w[k], rel=1e-5)
    # blocks of an epoch lie in the order of their keys
    assert got.groupby(["source", "epoch", "order_key"]).block.nunique().max() == 1


def test_mixing_refuses_what_no_weights_can_reach(docs):
    with pytest.raises(ValueError, match="over the limit"):
        mixing.plan(docs, max_epochs=1.0, budget=1e9)
    with pytest.raises(ValueError, match="over the limit"):
        mixing.plan(docs, max_epochs=0.5)
    with pytest.raises(ValueError, match="entropy"):
        mixing.plan(docs, max_epochs=None, entropy=9.0)


def test_mixing_odd_and_empty(odd, none):
    out = mixing.apply(odd)
    assert out.columns == odd.columns
    assert out.select("doc_id", "text").distinct().count() == odd.select("doc_id", "text").distinct().count()
    assert mixing.mix(none).count() == 0


# sharding


@pytest.mark.parametrize("n", [1, 3, 40])
def test_sharding_is_even_and_gapless(docs, n):
    s = shard.digest(docs, n).toPandas()
    g = s.groupby("shard")
    assert len(s) == docs.count()
    assert len(g) <= n
    assert all(sorted(x) == list(range(len(x))) for _, x in g["slot"])
    assert g["size"].sum().max() <= s["size"].sum() / n + 1.5 * s["size"].max()
    assert dict(zip(s.doc_id, s.text_crc32, strict=True)) == {i: zlib.crc32(t.encode()) for i, t in plain(docs)}


def tree_by_sorting(rows, leaves):
    """Shard of each row of (group, bytes, q0, q1, q2, row hash), by sorting the atoms of every node."""
    total, groups = sum(r[1] for r in rows), {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    atoms, shard_of = {}, {}
    for (g, w), rs in groups.items():
        low = (rs[0][2], min(r[3] for r in rs), min(r[4] for r in rs))
        for r in rs:
            tie = g % (1 << shard.TEXT_BITS) << shard.ROW_BITS
            tie += r[5] % (1 << shard.ROW_BITS) if len(rs) * w * leaves > total else 0
            c = tuple((q << shard.TIE) + tie for q in low)
            atoms.setdefault(c, [0, []])
            atoms[c][0] += w
            atoms[c][1].append(r)
    level = [(0, leaves, list(atoms))]
    while level:
        range_of = [max((c[d] >> shard.TIE for _, _, cs in level for c in cs if len(cs)), default=0) - min((c[d] >> shard.TIE for _, n, cs in level for c in cs), default=0) for d in range(3)]
        below = []
        for first, n, cs in level:
            spread = [(max(c[d] >> shard.TIE for c in cs) - min(c[d] >> shard.TIE for c in cs)) / max(1, range_of[d]) for d in range(3)] if cs else [0]
            d = spread.index(max(spread))
            cs = sorted(cs, key=lambda c: c[d])
            goal, upto, cut = sum(atoms[c][0] for c in cs) * (n // 2) / n, 0, 0
            for cut, c in enumerate(cs, 1):
                upto += atoms[c][0]
                if upto >= goal:
                    cut -= goal - (upto - atoms[c][0]) < upto - goal
                    break
            for f, k, part in ((first, n // 2, cs[:cut]), (first + n // 2, n - n // 2, cs[cut:])):
                if k > 1:
                    below.append((f, k, part))
                else:
                    shard_of |= {c: f for c in part}
        level = below
    return Counter((r, shard_of[c]) for c, (_, rs) in atoms.items() for r in rs)


@pytest.mark.parametrize(("leaves", "odd_rows_too"), [(7, False), (40, False), (5, True)])
def test_sharding_brute_force(docs, odd, monkeypatch, leaves, odd_rows_too):
    monkeypatch.setattr(shard, "FINE", 0.0)
    monkeypatch.setattr(shard, "BROADCAST_GROUPS", 0 if leaves == 7 else 1000)
    d = odd if odd_rows_too else docs.unionByName(docs.where("doc_id < 20").withColumn("source", F.lit("other")))
    rows = d.select("doc_id", shard.crc().alias("text_crc32"), *shard.coordinates(d)).cache()
    got = Counter(((r._g, r._w, r._q0, q1, q2, r._row), r._shard) for r, q1, q2 in ((r, r.p1, r.p2) for r in shard._numbered(rows.selectExpr("*", "_q1 p1", "_q2 p2"), rows, leaves).collect() for r in [r]))
    assert got == tree_by_sorting([(r._g, r._w, r._q0, r._q1, r._q2, r._row) for r in rows.collect()], leaves)


def test_sharding_keeps_groups_whole_and_copies_apart(spark, docs):
    twice = docs.unionByName(docs.where("doc_id % 3 = 0"))
    text = "equal words of a group " * 20
    big = spark.createDataFrame([(10_000 + i, text, "en", f"src{i % 4}") for i in range(2000)], "doc_id long, text string, lang string, source string")
    for d in (shard.assign(twice, 8), shard.digest(docs, 8).withColumnRenamed("text_crc32", "text"), shard.assign(docs.unionByName(big, allowMissingColumns=True), 8)):
        p = d.toPandas()
        p["size"] = p["size"] if "size" in p else [len((t or "").encode()) + 16 for t in p.text]
        groups = p.groupby("text").agg(n=("shard", "nunique"), b=("size", "sum"))
        assert set(groups[groups.n > 1].b > p["size"].sum() / 8) <= {True}
        assert p.groupby("shard")["size"].sum().max() <= p["size"].sum() / 8 + 3 * p["size"].max()
    p = shard.assign(twice, 8).toPandas().sort_values(["shard", "slot"])
    again = (p.doc_id == p.doc_id.shift()) & (p.shard == p.shard.shift())
    assert again.sum() <= 1


def test_sharding_odd_and_empty(odd, none):
    out = shard.assign(odd, 4)
    assert out.count() == odd.count()
    assert set(odd.columns) <= set(out.columns)
    assert shard.assign(odd, None, target_bytes=1 << 20).select("shard").distinct().count() == 1
    assert shard.digest(none).count() == 0
    assert shard.assign(none, 4).count() == 0


# secrets


def spans_of(text):
    a = re.compile(secrets.ASSIGN[4:], re.IGNORECASE | re.ASCII)
    out = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


CASES = ["é token=token: abcdefgh", "secret=token: abcdefgh", 'API_KEY = "x.y-z/12"', "PassWord:short, passwd:longer1", "AKIAAKIA" + "A" * 14, "AKIA" + "B" * 15, "f" * 24 + "g" + "0" * 23, "token=" + "a" * 40]


@pytest.fixture(scope="module")
def chains(docs):
    return secrets.train(docs)


def random_spans(text, model):
    """Spans of tokens over their band's threshold, from the definition of the ratio."""
    at = {c: i for i, c in enumerate(secrets._CHARS)}
    for m in re.finditer(secrets.TOKEN, text):
        w = m[0]
        mean = sum(model.table[at[a] * secrets.N + at[b]] for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1)
        if re.search("[A-Za-z]", w) and mean > model.cuts[sum(len(w) >= b for b in secrets.BANDS) - 1]:
            yield m.start(), m.end()


def test_secrets_brute_force(spark, docs, odd, chains):
    cases = [*CASES, "x " + "Zk8Qp2Lw9Xc4Vb7N" + " thing_and_other_name é " + "q7xw9zk2jv5m " * 700, "KEY = " + "A1" * 20]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").unionByName(docs.select("doc_id", "text")).unionByName(odd.select("doc_id", "text"))
    n = 0
    for r in secrets.scan(df, chains).select("text", "found").collect():
        text, got = r.text or "", [(x.kind, x.start, x.end) for x in r.found]
        fixed = [x for x in got if x[0] != "markov"]
        assert ",".join(f"{k}:{s}:{e}" for k, s, e in fixed) == spans_of(text)
        want = set(random_spans(text, chains)) - {x[1:] for x in fixed}
        assert {x[1:] for x in got if x[0] == "markov"} == want
        assert got == sorted(got, key=lambda x: (x[1], secrets.KINDS.index(x[0])))
        n += len(want)
    assert n > 700


ORDINARY = """HttpServletRequestWrapperFactory AbstractSingletonProxyFactoryBean /usr/local/lib/python3/site-packages getElementsByClassName org_apache_commons_lang3
ThreadPoolTaskExecutor content-security-policy MAX_RETRY_COUNT_EXCEEDED node_modules/react-dom internationalization kubernetes-dashboard-v2 shouldComponentUpdate
--max-old-space-size=4096 DEFAULT_CHARACTER_SET misunderstandings BufferedInputStreamReader""".split()


def test_secrets_chains_tell_random_strings_from_identifiers(spark, chains):
    got = secrets.rates(spark, chains)  # of vocabulary that trained nothing
    assert got["recall from 16"] >= 0.98 and got["recall"] > 0.97
    assert got["false, names"] <= 0.001 and got["false, identifiers"] <= 0.005
    assert all(c > 0 for c in chains.cuts)
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    secret = ["".join(rng.choice(letters[:k], n)) for k, least in ((62, 12), (36, 16)) for n in range(least, 40)]
    df = spark.createDataFrame([(w, w in ORDINARY) for w in ORDINARY + secret], "w string, ordinary boolean")
    wrong = [r.w for r in df.where(secrets.is_random(F.col("w"), chains) == F.col("ordinary")).collect()]
    assert len(wrong) <= 2
    assert not set(wrong) & set(ORDINARY)


def test_secrets_leave_joins_of_product_names_alone(spark, chains):
    names = """Mysql Oauth2 Nginx Crypt Https Sphinx Kafka Zookeeper Redis Postgres Mongo Kubernetes Docker Jenkins Grafana Prometheus Elastic Kibana Hadoop Flink Cassandra
    Rabbitmq Celery Django Flask React Svelte Webpack Babel Lodash Numpy Scipy Pytorch Keras Terraform Ansible Vagrant Vulkan Ffmpeg Snappy Protobuf Thrift Avro Graphql Kerberos""".split()
    joins = {a + b + c for i, a in enumerate(names) for j, b in enumerate(names) for k, c in enumerate(names) if (i * 7 + j * 3 + k) % 41 == 0}
    df = spark.createDataFrame([(w,) for w in sorted(joins) if len(w) >= secrets.TOKEN_MIN], "w string")
    assert df.where(secrets.is_random(F.col("w"), chains)).count() < 0.06 * df.count()


def test_secrets_keep_extra_columns(spark, odd, chains):
    out = secrets.scan(odd, chains)
    assert sorted(out.columns) == sorted(odd.columns)
    assert dict(out.dtypes)["found"].startswith("array")
    assert secrets.train(odd.limit(0)).cuts[0] > 0


def test_secrets_empty(none):
    assert secrets.digest(secrets.scan(none)).count() == 0


# fingerprints


def test_imatch_edits(spark, docs, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_BYTES", 1 << 15)
    got = imatch.edited(docs).toPandas().set_index("doc_id")
    order = sorted(plain(docs), reverse=True)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        assert got.edited_sha256[i] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
    assert (got.near_edited >= got.near_next).mean() > 0.95
    assert got.near_edited.mean() > got.near_next.mean() + 0.2
    assert got.near_edited.between(0, 1).all()


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def test_imatch_brute_force(spark, docs, odd):
    """Terms, band, sub-lexicons and likeness from their definitions, text by text, and the order of documents."""
    d = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).where("doc_id is null or doc_id > 11")
    rows = [(i, t or "") for i, t in plain(d)]
    texts = {t for _, t in rows}
    terms = {t: set(re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t in texts}
    shares = Counter(w for _, t in rows for w in terms[t])
    lex = {w for w, n in shares.items() if max(2, imatch.LOW * len(rows)) <= n <= max(2, imatch.HIGH * len(rows))}
    number = {w: int(vec.word_hashes(*vec.buffers(pa.array([w])), vec.ALNUM)[0][0]) for w in shares}
    seeds = [plain_mix(s * 0x9E3779B97F4A7C15 % 2**64) for s in range(1, imatch.SUBSETS + 1)]

    def subsets(ws):
        out, used = [[0] * imatch.SUBSETS for _ in range(imatch.LEVELS)], False
        for v in range(imatch.LEVELS):
            for k, seed in enumerate(seeds):
                draws = [plain_mix(number[w] ^ seed) for w in ws]
                inside = [plain_mix((x + 1) % 2**64) for x in draws if x % 4**v == 0]
                if inside:
                    out[v][k] = plain_mix(sum(inside) % 2**64) >> 48 | 1
            used = any(out[v])
            if not used:
                break
        return out

    def mark(t):
        if t not in terms:
            terms[t] = set(re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
            for w in terms[t] - set(number):
                number[w] = int(vec.word_hashes(*vec.buffers(pa.array([w])), vec.ALNUM)[0][0])
        return subsets(terms[t] & lex or terms[t])

    def like(a, b):
        if a == b:
            return 1.0
        used = [[x or y for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]
        from_ = max((v for v in range(imatch.LEVELS) if 2 * sum(map(bool, used[v])) >= imatch.SUBSETS), default=0)
        both = [(x, y) for p, q in zip(a[from_:], b[from_:], strict=True) for x, y in zip(p, q, strict=True) if x or y]
        return sum(x == y for x, y in both) / max(1, len(both))

    say = lambda m: "".join(f"{x & 255:02x}{x >> 8:02x}" for row in m for x in row)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), zlib.crc32(r[1].encode()) if r[0] is None else 0, r[1]))
    want, known = [], {}
    small = [(x, y) for x, y in zip(order, order[1:] + order[:1], strict=True) if len(x[1]) < 1500 and len(y[1]) < 4000]
    for (i, t), (_, nxt) in small:
        k = len(t) // 3
        new = t[: len(t) - k] + nxt[:k]
        a, b, c = (known.setdefault(x, mark(x)) if x not in known else known[x] for x in (t, new, nxt))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), say(a), say(b), round(like(a, b), 9), round(like(a, c), 9)))
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in imatch.edited(d).collect())
    assert len(want) > 80
    assert not Counter(want) - got


def test_imatch_rows_without_ids_in_many_ranges(spark, docs, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_BYTES", 1 << 14)
    d = docs.select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("doc_id"), "text")
    got = [(r.doc_id, r.edited_sha256) for r in imatch.edited(d).collect()]
    assert imatch.in_ranges(d).where("doc_id is null").select("range").distinct().count() > 3
    order = sorted(plain(d), key=lambda r: (r[0] is None, -(r[0] or 0), zlib.crc32(r[1].encode()) if r[0] is None else 0, r[1]))
    want = [(i, hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()) for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True)]
    assert Counter(got) == Counter(want)


def test_imatch_equal_texts_and_odd_rows(odd, none):
    got = imatch.edited(odd).toPandas()
    assert len(got) == odd.count()
    f = imatch.fingerprints(odd)
    assert f.groupBy("text").agg(F.countDistinct("fingerprint").alias("n")).where("n > 1").count() == 0
    assert imatch.edited(none).count() == 0


# near duplicates


def test_neardup_brute_force(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.groups(docs).collect()}
    assert got == neardup.brute_force(plain(docs))


def test_neardup_finds_edited_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    data = []
    for i in range(60):
        w = list(base)
        for p in rng.integers(0, 300, i % 9):
            w[p] = f"x{i}_{p}"
        data.append((i, " ".join(w)))
    data += [(100 + i, f"{i} a b c d e f g h i j") for i in range(5)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == neardup.brute_force(data)


def test_neardup_odd_and_empty(odd, none):
    g = neardup.groups(odd).collect()
    assert len(g) == odd.count()
    by = {r.doc_id: r for r in g if r.doc_id is not None}
    assert by[8].component_id == 7
    assert by[10].component_id == by[11].component_id == 9
    assert by[2].n_shingles == 0
    assert by[4].n_shingles == 1
    kept = neardup.clean(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 7").count() == 1
    assert neardup.groups(none).count() == 0
    assert neardup.clean(none).count() == 0


def test_neardup_clean_with_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    data = [(None, a), (None, a + " tail"), (None, a + " tail"), (None, ""), (None, None), (2, b), (3, b + " tail"), (3, c), (5, c + " tail"), (5, ""), (6, None), (None, c + " more")]
    got = Counter((r.doc_id, r.text) for r in neardup.clean(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect())
    ours = [x for x in got.elements() if x[0] is None and (x[1] or "").startswith("a")]
    assert len(ours) == 1 and ours[0] in data
    assert got - Counter(ours) == Counter([(None, ""), (None, None), (2, b), (3, c), (5, ""), (6, None)])


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.label for r in components.components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# licenses


def test_licenses_brute_force(docs, odd, none):
    for d in (docs, odd.where("doc_id is not null")):
        got = {(r.doc_id, r.license, r.template): r.containment for r in licenses.scan(d).collect()}
        assert got == pytest.approx(licenses.brute_force(plain(d)))
    assert licenses.scan(none).count() == 0
    assert licenses.scan(odd, []).count() == 0


def test_licenses_altered_text(spark):
    long = next(t for a, n, t in licenses.TEMPLATES if (a, n) == ("MIT", "grant"))
    data = [(1, "before it " * 30 + long.replace("without restriction", "with no restriction") + " after"), (2, long[:100]), (3, "all rights RESERVED"), (4, "rights all reserved")]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (3, "proprietary")}


def altered_licenses():
    """For every template, copies inside other words with every 30th, 40th or no word replaced, from several positions on."""
    rng = np.random.default_rng(5)
    out = []
    for _, _, t in licenses.TEMPLATES:
        for every in (30, 40, 10**6):
            ws = licenses._words(t)
            ws[every // 2 :: every] = ["changed"] * len(ws[every // 2 :: every])
            before = [f"w{k}" for k in rng.integers(0, 99, int(rng.integers(0, 200)))]
            out.append((len(out), " ".join(before + ws + ["after"] * 50)))
    return out


def test_licenses_recall_of_altered_copies(spark):
    data = altered_licenses()
    got = {(r.doc_id, r.license, r.template): r.containment for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()}
    want = licenses.brute_force(data)
    assert {len(licenses._words(t)) > 100 for _, _, t in licenses.TEMPLATES} == {True, False}
    assert len(want) > len(data)  # whole licenses hold grants and conditions too
    assert got == pytest.approx(want)


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_licenses_anchors_lose_nothing(least):
    for _, _, t in licenses.TEMPLATES:
        ws = licenses._words(t)
        k = min(licenses.SHINGLE, len(ws))
        grams = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
        known = set(licenses._anchors([ws], least))
        free = sum(not known & set(g) for g in grams)
        assert free / len(grams) < least
        assert set(licenses._anchors([ws, ws[::-1]], least)) >= known


def test_licenses_bounds(odd):
    for least in (0, 1.1):
        with pytest.raises(ValueError):
            licenses.scan(odd, least=least)


# toxicity


def test_toxicity_learns_and_holds_out(spark, docs, smoke):
    bad = ["vile", "nasty", "rotten"]
    rng = np.random.default_rng(2)
    text = lambda i, y: " ".join([f"w{k}" for k in rng.integers(0, 400, 60)] + [bad[i % 3]] * y)
    data = [(i, text(i, i % 4 == 0), int(i % 4 == 0)) for i in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, text string, y int")
    labels = df.selectExpr("doc_id", "1 AS quality", "y AS toxic")
    s = toxicity.scored(df, labels).collect()
    held = [r for r in s if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == r.y for r in held) / len(held) > 0.97
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r.doc_id, r.score) for r in toxicity.scored(df, flipped).collect()) == sorted((r.doc_id, r.score) for r in s)


def test_ftrl_brute_force():
    """One epoch of the update rule, coordinate by coordinate, from a start with weights."""
    rng = np.random.default_rng(8)
    size, n = 40, 60
    texts = [np.unique(rng.integers(0, size, rng.integers(0, 12))) for _ in range(n)]
    y, order = rng.integers(0, 2, n).astype(float), rng.permutation(n)
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    w0, n0 = np.where(rng.random(size) < 0.3, rng.normal(size=size), 0.0), rng.random(size)
    z = [-w * ((b + m**0.5) / a + l2) - np.sign(w) * l1 for w, m in zip(w0, n0, strict=True)]
    seen, zb, nb = list(n0), -0.25 * (b / a), 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((b + seen[i] ** 0.5) / a + l2)

    for t in order:
        bias = -zb / ((b + nb**0.5) / a)
        p = 1 / (1 + np.exp(-(sum(weight(i) for i in texts[t]) + bias)))
        g = p - y[t]
        if abs(g) < 1e-4:
            continue
        for i in texts[t]:
            w = weight(i)
            z[i] += g - ((seen[i] + g * g) ** 0.5 - seen[i] ** 0.5) / a * w
            seen[i] += g * g
        zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / a * bias
        nb += g * g
    w1, n1, b1 = toxicity.ftrl(texts, y, (w0, n0, 0.25), order)
    assert w1 == pytest.approx([weight(i) for i in range(size)])
    assert n1 == pytest.approx(seen)
    assert b1 == pytest.approx(-zb / ((b + nb**0.5) / a))
    assert (w1 == 0).any()


def test_toxicity_scores_are_those_of_the_weights(spark, odd, smoke, docs):
    """Each score by summing the model's weights over the distinct features of the whole text."""
    model = toxicity.train(docs, spark.read.parquet(f"{smoke}/labels.parquet"))
    weights = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    for r in toxicity.score(docs.unionByName(odd.select(docs.columns)), model).collect():
        h = vec.word_hashes(*vec.buffers(pa.array([r.text or ""])), vec.ALNUM)[0].tolist()
        f = {x >> (64 - toxicity.BITS) for x in h}
        for gap in (1, 2, 3):
            f |= {plain_mix((a * 0x9FB21C651E98DF25 + b + (1 if gap == 1 else 2)) % 2**64) >> (64 - toxicity.BITS) for a, b in zip(h, h[gap:], strict=False)}
        s = sum(weights.get(x, 0.0) for x in f) + model.bias
        assert r.score == pytest.approx(1 / (1 + np.exp(-max(-35, min(35, s)))))
        assert r.predicted == (r.score >= 0.5)


def test_toxicity_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(odd, labels)
    assert out.count() == odd.count()
    assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.clean(odd, labels).columns == odd.columns
    assert toxicity.scored(none, labels).count() == 0
    assert toxicity.scored(odd, labels.limit(0)).where("score <> 0.5").count() == 0


# hashing


def test_word_hashes_depend_on_words_alone():
    a = pa.array(["The cat", None, "", "sat the CAT é", "x" * 400_000])
    got = []
    for lo, hi, data, off in vec.runs(a, 8):
        h, at = vec.word_hashes(data, off, vec.NOT_SPACE)
        got += [h[at[i] : at[i + 1]].tolist() for i in range(hi - lo)]
    assert [len(x) for x in got] == [2, 0, 0, 4, 1]
    assert got[0] == got[3][1:3]
    assert len({x for y in got for x in y}) == 5


@pytest.mark.parametrize("name", [lay.name for lay in chat.LAYOUTS])
def test_chat_typed_table_of_each_layout(spark, name):
    said = [("user", "q"), ("assistant", "a")]
    record, want = {
        "turn rows": ((1, 0, "user", "q"), said[:1]),
        "messages": ((1, said), said),
        "conversations": ((1, [("human", "q"), ("gpt", "a")]), said),
        "dialog": ((1, (said,)), said),
        "prompt": ((1, "s", "q", "a"), [("system", "s"), *said]),
        "instruction": ((1, None, "q", "", "a"), said),
    }[name]
    lay = next(x for x in chat.LAYOUTS if x.name == name)
    df = spark.createDataFrame([record], lay.like).withColumn("other", F.lit(1))
    tables = [df] + ([df.drop("system")] if "system" in df.columns else [])
    for d in tables:
        got = [(r.conv_id, r.role, r.text) for r in chat.from_table(d).orderBy("turn").collect()]
        assert got == [(1, *x) for x in (want if d is df else said)]


def test_chat_refuses_a_mixture_of_layouts(spark):
    both = spark.createDataFrame([(1, "q", "a", "i", "", "o")], "conv_id long, prompt string, response string, instruction string, input string, output string")
    with pytest.raises(ValueError, match="no layout"):
        chat.from_table(both)
