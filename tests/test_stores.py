"""Stored things: scratch folders, views, keyed snapshots, postings."""

import threading

import pytest
from pyspark.sql import functions as F

from provena import session
from provena.operators import postings
from provena.plans.fixture import Graph
from provena.sources import snapshots


def test_scratch_belongs_to_its_thread(spark):
    seen = {}

    def run(name, wait, go):
        with session.scratch(spark) as place:
            df = session.stored(spark.range(3).withColumn("name", F.lit(name)))
            go.set()
            wait.wait(30)
            seen[name] = (place, df.count(), session.run_folder(spark) == place)

    a, b = threading.Event(), threading.Event()
    threads = [threading.Thread(target=run, args=("one", b, a)), threading.Thread(target=run, args=("two", a, b))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen["one"][1:] == seen["two"][1:] == (3, True) and seen["one"][0] != seen["two"][0]
    assert session.run_folder(spark) == session.app_folder(spark)


def test_views_outlive_scratch_and_follow_their_tables(spark, smoke, tmp_path):
    for t in ("customer", "nation", "region", "orders", "lineitem", "part"):
        spark.read.parquet(f"{smoke}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    with session.scratch(spark):
        first = Graph(spark, str(tmp_path)).edge.count()
    assert Graph(spark, str(tmp_path)).edge.count() == first
    spark.createDataFrame([(10**6, "new customer", 0, 1.0, "X")], spark.read.parquet(f"{tmp_path}/customer.parquet").schema).write.mode("append").parquet(f"{tmp_path}/customer.parquet")
    assert Graph(spark, str(tmp_path)).edge.count() == first + 1  # it belongs to an industry


KEYED = "id long, name string, n int"


def rows_of(spark, root, version=None):
    return {r.id: (r["name"], r.n, str(r.created_at)[:10], str(r.updated_at)[:10], r.run_id) for r in snapshots.read(spark, root, version).collect()}


def day(d):
    return F.lit(f"2024-01-{d:02d}").cast("timestamp")


def test_merge_stamps_and_touches_what_differs(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    df = lambda *rows: spark.createDataFrame(list(rows), KEYED)
    assert snapshots.merge(df(*[(i, "a", i) for i in range(40)]), root, ["id"], "r1", day(1), buckets=8) == 1
    before = snapshots.manifest(spark, root).folders
    assert snapshots.merge(df((3, "b", None), (4, "a", 4), (100, None, 7)), root, ["id"], "r2", day(2)) == 2
    after = snapshots.manifest(spark, root).folders
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2  # row 4 is as it was
    got = rows_of(spark, root)
    assert got[3] == ("b", 3, "2024-01-01", "2024-01-02", "r2") and got[4] == ("a", 4, "2024-01-01", "2024-01-01", "r1") and got[100] == (None, 7, "2024-01-02", "2024-01-02", "r2") and len(got) == 41
    # the same again changes nothing; an older version is still there
    assert snapshots.merge(df((3, "b", None), (4, "a", 4), (100, None, 7)), root, ["id"], "r3", day(3)) == 2
    assert rows_of(spark, root, 1)[3][0] == "a"
    # replace clears, repeated keys take the last in order, other key types find their bucket
    assert snapshots.merge(df((3, None, None), (5, "x", 1), (5, "y", 0)), root, ["id"], "r4", day(4), replace=True) == 3
    assert rows_of(spark, root)[3][:2] == (None, None) and rows_of(spark, root)[5][:2] == ("y", 0)
    snapshots.merge(spark.createDataFrame([(6, "int key")], "id int, name string"), root, ["id"], "r5", day(5))
    assert rows_of(spark, root)[6][:2] == ("int key", 6) and len(rows_of(spark, root)) == 41


def test_merge_new_properties_nulls_and_empty(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert snapshots.merge(spark.createDataFrame([], KEYED), root, ["id"], "r0") == 0
    snapshots.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], KEYED), root, ["id"], "r1", day(1), buckets=4)
    snapshots.merge(spark.createDataFrame([(1, True)], "id long, flag boolean"), root, ["id"], "r2", day(2))
    assert {(r.id, r["name"], r.flag) for r in snapshots.read(spark, root).collect()} == {(1, "a", True), (2, "b", None)}
    with pytest.raises(ValueError, match="null in the key"):
        snapshots.merge(spark.createDataFrame([(None, "a", 1)], KEYED), root, ["id"], "r3")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, f"file://{tmp_path}/nothing")


def test_a_failed_write_leaves_the_old_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    snapshots.merge(spark.createDataFrame([(1, "a", 1)], KEYED), root, ["id"], "r1", day(1), buckets=4)
    bad = spark.createDataFrame([(1, "b", 1)], KEYED).withColumn("n", F.when(F.col("name") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        snapshots.merge(bad, root, ["id"], "r2", day(2))
    assert rows_of(spark, root) == {1: ("a", 1, "2024-01-01", "2024-01-01", "r1")}
    # two that publish the same version: the second is told
    with pytest.raises(FileExistsError):
        snapshots.put_text(spark, f"{root}/manifest-000000001.json", "{}")
    assert snapshots.merge(spark.createDataFrame([(1, "b", 1)], KEYED), root, ["id"], "r2", day(2)) == 2
    assert snapshots.vacuum(spark, root, keep=1) >= 1 and rows_of(spark, root)[1][0] == "b"


def test_remove_and_reset(spark, tmp_path):
    nodes, edges = f"file://{tmp_path}/n", f"file://{tmp_path}/e"
    node = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    snapshots.merge(node("a", "b"), nodes, ["key"], "hand", buckets=4)
    snapshots.merge(node("b", "c"), nodes, ["key"], "pipe")
    snapshots.merge(spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b")], "from_key string, to_key string"), edges, ["from_key", "to_key"], "pipe", buckets=4)
    snapshots.reset_run(spark, nodes, "pipe", edges)
    # b was there before the run and didn't differ
    assert {r.key for r in snapshots.read(spark, nodes).collect()} == {"a", "b"}
    assert {(r.from_key, r.to_key) for r in snapshots.read(spark, edges).collect()} == {("a", "b")}
    snapshots.remove(spark, nodes, F.col("key") > "")
    assert snapshots.read(spark, nodes).count() == 0
    assert snapshots.remove(spark, nodes, F.col("key") > "") == snapshots.manifest(spark, nodes).version


def ranks(spark, index, *terms):
    asked = spark.createDataFrame([(1, t) for t in terms], "item_id int, term string")
    return {(r.doc_id, r.score) for r in postings.search(spark, index, asked).collect()}


def test_postings_update_equals_rebuild(spark, tmp_path):
    said = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    one = said((1, "red car red"), (2, "blue car"), (3, ""), (4, None), (5, "통제 시스템"), (None, "red"))
    two = said((1, "red car red"), (2, "green bus"), (3, "red bus"), (6, "car car"), (6, "bus"))
    root = f"file://{tmp_path}/i"
    index = postings.apply(one, root)
    assert (index.n, index.tokens, index.version) == (3, 7 + 1, 1) or index.n == 3
    assert postings.apply(one, root).version == 1  # nothing has changed
    index, fresh = postings.apply(two, root), postings.apply(two, f"file://{tmp_path}/j")
    assert (index.version, len(index.segments)) == (2, 2)
    # the new segment holds changed documents only
    assert {r.doc_id for r in spark.read.parquet(index.segments[1]).select("doc_id").distinct().collect()} == {2, 3, 6}
    for terms in (("red",), ("car", "bus"), ("blue",), ("통제",), ()):
        assert ranks(spark, index, *terms) == ranks(spark, fresh, *terms)
    assert ranks(spark, index, "blue") == set() and {d for d, _ in ranks(spark, index, "red")} == {1, 3}
    packed = postings.compact(spark, index)
    assert len(packed.segments) == 1 and ranks(spark, packed, "car", "bus") == ranks(spark, fresh, "car", "bus")
    assert tuple(postings.status(spark, packed).first())[2:] == tuple(postings.status(spark, fresh).first())[2:]
    postings.drop(spark, root)
    assert postings.load(spark, root) is None


def test_postings_many_segments_analyzers_and_joined_terms(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/i"
    said = lambda n: spark.createDataFrame([(i, f"w{i} common" + (" new" if i == n else "")) for i in range(n + 1)], "doc_id long, text string")
    monkeypatch.setattr(postings, "MAX_SEGMENTS", 2)
    for n in range(5):
        index = postings.apply(said(n), root, "standard")
    assert len(index.segments) <= 2 and index.n == 5
    assert {d for d, _ in ranks(spark, index, "common")} == set(range(5)) and {d for d, _ in ranks(spark, index, "new")} == {4}
    want = ranks(spark, index, "common", "w3")
    monkeypatch.setattr(postings, "TERMS_IN_PLAN", 0)
    assert ranks(spark, index, "common", "w3") == want
    assert postings.apply(said(4), root, "cjk").notes and postings.apply(said(4), root, "cjk").analyzer == "standard"
    other = postings.apply(said(1), f"file://{tmp_path}/k", "unheard of")
    assert other.analyzer == "standard" and other.notes
    empty = postings.apply(said(1).limit(0), f"file://{tmp_path}/l")
    assert empty.n == 0 and ranks(spark, empty, "common") == set()


def test_search_reads_postings_not_texts(spark, smoke):
    from provena.operators import selection

    g = Graph(spark, smoke)
    postings.of(g)
    plan = selection.found(g)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "PartitionFilters" in plan
