"""Every graph query against its DuckDB oracle at the smoke scale, and units of the functions behind them."""

import pytest
from pyspark.sql import Window, functions as F

from provena import catalog, session
from provena.functions import text as X
from provena.operators import greedy, notes, patterns, rules, selection
from provena.operators.quotes import holding
from provena.sources import records
from tests.compare import connect, rows


@pytest.fixture(scope="module")
def con(smoke):
    return connect(smoke)


#: Queries that may have no rows in the smallest tables; all others must have some, or the comparison says nothing.
EMPTY_AT_SMOKE = {"A4_common_needs_across_domains", "Q6_raw_signals"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, smoke, con, name):
    got = catalog.queries()[name](spark, smoke).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()
    assert len(want) > 0 or name in EMPTY_AT_SMOKE
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, smoke, name):
    assert catalog.queries()[name](spark, smoke).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.count() > 0
    assert {"need", "domain_count", "accounts"} <= set(out.columns)


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "won"), [
    ("1억", 1e8), ("4억 -> 3.15억", 3.15e8), ("약 2,500만원", 2.5e7), ("1억 내외", 1e8), ("2.5~3억", None), ("5천만원 이하", None),
    ("0.5", None), ("123456", 123456.0), ("500원", None), ("150000원", 150000.0), ("-", None), (None, None), ("3억(잠정)", 3e8),
])
def test_parse_amount(spark, raw, won):
    got = one(spark, raw, X.parse_amount)
    assert got == pytest.approx(won) if won is not None else got is None


def test_sentences_end_before_space_only(spark):
    assert one(spark, "Use v2.0 now. Is it? Yes! a.b", X.sentences) == ["Use v2.0 now.", "Is it?", "Yes!", "a.b"]


def test_whole_numbers(spark):
    df = spark.createDataFrame([("costs 3.77 and 4,000", "3.7", "4000", "400")], "t string, a string, b string, c string")
    r = df.select(X.has_number(F.col("t"), F.col("a")).alias("a"), X.has_number(F.col("t"), F.col("b")).alias("b"), X.has_number(F.col("t"), F.col("c")).alias("c")).first()
    assert (r.a, r.b, r.c) == (False, True, False)


def test_overlap_parity_and_default(spark):
    df = spark.createDataFrame([("the cat sat", ["cat", "통제"]), ("고객cat사 통제·모니터링", ["cat", "통제"])], "t string, terms array<string>")
    got = df.select(X.overlap(F.col("terms"), F.col("t")).alias("d"), X.overlap(F.col("terms"), F.col("t"), parity=True).alias("p")).collect()
    assert [r.d for r in got] == [["cat"], ["cat", "통제"]]
    assert [r.p for r in got] == [[], ["cat", "통제"]]


def test_match_key(spark):
    assert one(spark, "(주) 가나다 (본사)", X.match_key) == "가나다"
    assert one(spark, "Acme Ltd.", X.match_key) == "acme"


def packed_lines(text, width=500):
    """What `packed` must give for one text."""
    out, now = [], ""
    for line in (text or "").split("\n"):
        while len(line) > width:
            out += [x for x in (now, line[:width]) if x]
            now, line = "", line[width:]
        joined = f"{now}\n{line}" if now else line
        if len(joined) > width:
            out.append(now)
            now = line
        else:
            now = joined
    return [*out, now] if now.strip() else out


def test_packed_lines(spark, smoke):
    assert packed_lines("ab\ncd", 4) == ["ab", "cd"]
    cases = [None, "", "\n\n", "a" * 600, "a" * 500, "ab\ncd", "x\n" + "b" * 1500 + "\ny\n\nz", "\n" + "c" * 499 + "\n", "é" * 501 + "\n" + "d" * 499, "a\n \n" * 300]
    df = spark.createDataFrame([(c,) for c in cases], "text string").unionByName(spark.read.parquet(f"{smoke}/documents.parquet").select("text"))
    for width in (4, 500):
        for r in df.select("text", X.packed(F.col("text"), width).alias("p")).collect():
            assert r.p == packed_lines(r.text, width)


def anchored(sentences, snippets, least=2):
    """What `anchors` must give."""
    words = [set(s.lower().split()) for s in snippets]
    out = []
    for s in sentences:
        hits = [len(set(s.lower().split()) & x) for x in words]
        out.append(hits.index(max(hits)) if max(hits, default=0) >= least else None)
    return out


def test_anchors(spark, smoke):
    cases = [(["a b c", "x", "A  b"], ["b a", "c b a", "a b c"]), ([], ["a"]), (["a b"], [])]
    said = spark.read.parquet(f"{smoke}/conversations.parquet").select(X.sentences(F.col("text")).alias("a"), X.sentences(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).alias("b")).where("b is not null")
    df = spark.createDataFrame(cases, "a array<string>, b array<string>").unionByName(said)
    for r in df.select("a", "b", X.anchors(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == anchored(r.a, r.b)


def test_normalize_composes(spark):
    assert one(spark, "ﬁne\u200b  ½ Ａ e\u0301 é", X.normalize) == "fine 1⁄2 A é é"
    assert one(spark, None, X.normalize) == ""


@pytest.mark.parametrize(("raw", "masked", "hits"), [
    ("mail a.b@c.org or (123) 456-7890, card 1234 5678 9012 3456", "mail ***@***.*** or (***) ***-****, card ****-****-****-****", {"email": 1, "phone": 1, "card": 1}),
    ("900101-1111111 and 9001011234567", "######-******* and ######-*******", {"resident": 2}),
    ("010-1234-5678, 01087654321, 0101234567890", "010-****-****, 010-****-****, ######-*******", {"mobile": 2, "resident": 1}),
    ("02-769-0321 or 1588-0000", "0*-****-**** or 1***-****", {"landline": 1, "service": 1}),
    ("123-45-67890 1338510955", "***-**-***** ***-**-*****", {"business": 2}),
    ("입금 계좌 110-234-567890", "입금 계좌 ***-***-*****", {"account": 1}),
    ("ratio 110-234-567890", "ratio 110-234-567890", {}),
    ("at 1700642391152 and 1743492135.982449 v 2.2.0.DEV-SNAPSHOT", "at 1700642391152 and 1743492135.982449 v 2.2.0.DEV-SNAPSHOT", {}),
    ("<tel:010-1234-5678|call> <mailto:a@b.org|a@b.org> <@U01AB|Kim>", "010-****-**** call ***@***.*** ***@***.*** Kim", {"mobile": 1, "email": 2}),
    (None, None, {}), ("", "", {}), ("nothing", "nothing", {}),
])
def test_mask(spark, raw, masked, hits):
    assert X.mask_text(raw) == (masked, hits)
    assert X.mask_text(masked) == (masked, {})
    got = spark.createDataFrame([(raw,)], "x string").select(X.masked(F.col("x")).alias("m")).first().m
    assert (got.text, got.hits) == (masked, hits)


def test_mask_options():
    assert X.mask_text("a.b@c.org", ("a.b@c.org",)) == ("a.b@c.org", {})
    assert X.mask_text("met 남소리 twice, 남소리", deny=("남소리",)) == ("met [이름] twice, [이름]", {"name": 2})
    assert X.mask_text("Kim", column=" 담당자 ") == ("[담당자]", {"column": 1})
    assert X.mask_text("6000000000", number=True) == ("6000000000", {})
    assert X.mask_text("6000000000") == ("***-**-*****", {"business": 1})


def test_content_and_search_terms(spark):
    assert one(spark, "고객사들은 통제하지 못하는 Domain들을 우리 창고에서는 The API", X.content_terms) == ["고객사", "통제", "못하", "domain", "창고", "api"]
    assert one(spark, "Business Domain 들은 창고", X.search_terms) == ["들은", "창고"]
    assert one(spark, "고객 통제abc시 x1", X.search_tokens) == ["고객", "통제", "abc", "시", "x1"]
    assert one(spark, "통제시스템 École", X.search_tokens) == ["통제", "제시", "시스", "스템", "école"]


def test_amounts(spark):
    got = one(spark, "180M 달러, 18억 달러, 2,564억 원, 3천 엔, 12 개, 1.5 유로", X.amounts)
    assert [(a.value, a.currency) for a in got] == [(1.8e8, "달러"), (1.8e9, "달러"), (2.564e11, "원"), (3000.0, "엔"), (1.5, "유로")]


def test_quotes_are_found_whole_or_within_words(spark):
    texts = [(1, "one two  three four five six"), (2, "xone two three fourx"), (3, "Four FIVE six"), (4, None), (5, "")]
    quotes = [(1, "two  three four"), (2, "one two three four"), (3, "five"), (4, "ve si"), (5, "two three four five six seven"), (6, None), (7, "one two  three four five six")]
    d, q = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(quotes, "item_id int, text string")
    got = {(r.item_id, r.doc_id) for r in holding(d, q).collect()}
    assert got == {(i, k) for i, x in quotes for k, t in texts if x is not None and t is not None and x in t}
    flat = lambda s: " ".join(s.split()).lower()
    got = {(r.item_id, r.doc_id) for r in holding(d, q, squeezed=True).collect()}
    assert got == {(i, k) for i, x in quotes for k, t in texts if x is not None and t is not None and flat(x) in flat(t)}


def test_html_units():
    html = "<h1>A</h1><p>x <b>y</b></p><script>no()</script><h2>B</h2>z<h2>B</h2>w"
    assert records.html_units(html) == [{"path": "A", "text": "x y"}, {"path": "A > B", "text": "z"}, {"path": "A > B", "text": "w"}]
    assert records.html_units(None) == []
    body = "".join(f"\\u003cp\\u003e{x}\\u003c/p\\u003e" for x in ("cover of it", "🔥 INTRO here", "01", "first", "🔥 MAIN", "Q1", "10"))
    hidden = '<i>c</i><div data="{\\"html\\": \\"' + body + '\\"}"></div>'
    assert [u["path"] for u in records.html_units(hidden)][1:] == ["INTRO", "INTRO/01", "MAIN", "MAIN/Q1"]
    assert [u["path"] for u in records.question_units(["c", "🔥 INTRO here", "01", "first", "🔥 MAIN", "Q1", "10", "★ no", "🔥 INTRO again", "01", "more"])] == ["COVER", "INTRO", "INTRO/01", "MAIN", "MAIN/Q1"]


def test_asciidoc(spark):
    text = "\n\n[#one]\n= A\nx\n[#two]\n=== C\ny\n== B\n----\n= no\n----\n=== D"
    got = records.asciidoc_units(records._lines(spark.createDataFrame([("f", text), ("g", "only\ntext")], "doc string, text string"))).orderBy("doc", "section").collect()
    assert [(r.doc, r.level, r.anchor, r.path, r.text) for r in got] == [
        ("f", 1, "one", "A", "x\n[#two]"), ("f", 3, "two", "A > C", "y"), ("f", 2, None, "A > B", "----\n= no\n----"), ("f", 3, None, "A > B > D", ""), ("g", None, None, "(preamble)", "only\ntext")]


def test_snapshot_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("a", "txt"), ("b", "txt")], "source_id string, format string")
    e = spark.createDataFrame([("a", "ev_1", "x", ("k",)), ("a", "ev_2", "y", None)], "source_id string, evidence_id string, excerpt string, structured struct<record_kind: string>")
    records.write_snapshot(s, e, str(tmp_path))
    got = {(r.source_id, r.record_kind, r.n, r.note) for r in records.read_snapshot(spark, str(tmp_path)).collect()}
    assert got == {("a", "k", 1, None), ("a", "none", 1, None), ("b", None, 0, "no evidence file")}
    assert records.read_snapshot(spark, str(tmp_path), ["b"]).count() == 1
    with pytest.raises(ValueError, match="record of evidence"):
        records.write_snapshot(s, e.withColumn("excerpt", F.lit(None).cast("string")), str(tmp_path))


def test_edges_need_known_ends_and_types(spark):
    n = spark.createDataFrame([("a",), ("b",)], "key string")
    e = lambda *rows: spark.createDataFrame(rows, "type string, from_key string, to_key string")
    assert records.upsert_edges(e(("T", "a", "b")), e(("T", "a", "b"), ("T", "b", "a")), n, ("T",)).count() == 2
    with pytest.raises(LookupError, match="c"):
        records.upsert_edges(e(("T", "a", "b")), e(("T", "a", "c")), n, ("T",))
    with pytest.raises(ValueError, match="edge type"):
        records.upsert_edges(e(("T", "a", "b")), e(("U", "a", "b")), n, ("T",))


def test_stored_tables_go_with_their_folder(spark):
    df = spark.range(5)
    with session.scratch(spark) as place:
        kept = session.stored(df, outside=f"{session.shared_folder(spark)}/kept")
        inner = session.stored(df)
        assert inner.count() == 5
        assert place in session.run_folder(spark)
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not exist"):
        spark.read.parquet(place).count()
    session.discard(spark, f"{session.shared_folder(spark)}/kept")


def test_markdown_drops_text_before_the_first_heading(spark):
    lines = ["lost", "# A", "x", "```", "# no heading", "```", "## B", "y"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "doc int, no int, line string")
    got = [(r.title, r.text) for r in records.markdown_units(df).orderBy("section").collect()]
    assert got == [("A", "x\n```\n# no heading\n```"), ("B", "y")]


def test_snapshot_and_keyed_rewrite(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"evidence_id": "ev_1", "source_id": "s", "structured": {"k": "v"}}\n\n{broken\n')
    got = records.snapshot(spark, str(tmp_path / "in")).collect()
    assert [(r.evidence_id, r.structured, r.file) for r in got] == [("ev_1", {"k": "v"}, "a.jsonl")]
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None)], "id int, v string, updated_at int")
    records.write_keyed(df, str(tmp_path / "out"), ["id"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "v").collect()) == [(1, "b"), (2, "c")]


def test_merge_keeps_first_scalar_and_all_items(spark):
    df = spark.createDataFrame([("k", 1, None, ["a"]), ("k", 2, "x", ["b", "a"]), ("k", 3, "y", None)], "key string, seq int, v string, l array<string>")
    r = selection.merge_first(df, ["key"], "seq", ("l",)).first()
    assert (r.v, r.l) == ("x", ["a", "b"])


def test_verdict_layers(spark):
    rules_ = spark.createDataFrame([("spec", "fact", True, "VERIFIED")], "source_type string, claim_kind string, verified_allowed boolean, default_status string")
    cols = "source_type string, claim_kind string, extractor string, critical boolean, conflict boolean, unreadable boolean"
    df = spark.createDataFrame([("spec", "fact", "rule", False, False, False), ("spec", "fact", "rule", True, False, False), ("spec", "fact", "llm", True, False, False), ("memo", "x", "rule", False, True, False), ("spec", "fact", "rule", True, False, True)], cols)
    got = [(r.status, r.lanes) for r in rules.verdict(df, rules_).collect()]
    assert got == [("VERIFIED", "default"), ("CRITICAL", "default|critical"), ("UNVERIFIED", "default|critical"), ("CANDIDATE", "default|conflict"), ("CANDIDATE", "default|critical")]


def test_access_denies_what_it_does_not_know(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "odd", None), ("c", "public", "superseded"), ("d", "internal", "final")], "source string, sensitivity string, doc_status string")
    assert [r.source for r in patterns.permitted(df).collect()] == ["a", "d"]


def test_greedy_helpers():
    assert greedy.balanced([("a", 1), ("a", 2), ("b", 1), ("b", 3)], 3) == [1, 3, 2]
    assert greedy.rotated([(1, 1.0, "g", "s", 0), (2, 1.0, "g", "s", 1), (3, 1.0, "h", "s", 2)], 3) == [1, 3, 2]
    assert greedy.select([(i, i, False, i) for i in range(5)]) == [0, 1, 2, 3, 4]
    big = greedy.select([(i, float(i), i < 3, i) for i in range(40)])
    assert len(big) == 24
    assert {0, 1, 2} <= set(big)
    assert greedy.grow({"a": 0, "b": 2, "c": 2, "d": 2, "e": 2}, [("a", "b"), ("c", "d")]) == ["a", "b", "c", "d"]


def test_notes_guards_and_logs(spark, tmp_path):
    assert one(spark, "no structure here", notes.meeting_note) is None
    n = one(spark, "# T\nDate: 2024-01-02\nAttendees: a, b,\n- x\n* y", notes.meeting_note)
    assert (n.title, n.day, n.attendees, n.actions) == ("T", "2024-01-02", ["a", "b"], ["x", "y"])
    df = spark.createDataFrame([(1, "a")], "id int, status string")
    assert notes.forbidden(df) == ["status"]
    notes.append_log(df, str(tmp_path / "log"))
    notes.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert not hasattr(notes.Reader({"t": df}), "replace")
    notes.Writer({"t": df}).replace("t", str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_hard_gate_takes_support_from_the_whole_text(spark):
    support = "word " * 120 + "Late 4,200 and 3.77 stand here."
    said = ["Late 4200.", "Only 3.7 of it.", "Write to a.b@c.org.", "No number."]
    df = spark.createDataFrame([(1, support, said), (2, None, said)], "doc_id long, support string, sentences array<string>")
    got = {r.doc_id: (r.answer, r.removed) for r in rules.hard_gate(df).collect()}
    assert got == {1: ("Late 4200. No number.", 2), 2: ("No number.", 3)}
