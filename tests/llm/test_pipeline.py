"""Stages of the corpus pipeline, one by one and together."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from provena.llm import decontaminate, neardup


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_and_empty_tables(spark, smoke, odd, none, k):
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, smoke)
    assert set(odd.columns) <= set(out.columns) if k == 4 else out.columns == odd.columns
    assert out.count() > 0
    assert stage(spark, none, smoke).count() == 0


def test_run_keeps_what_the_stages_keep(spark, smoke, docs):
    out = corpus_pipeline.run(spark, smoke)
    assert set(docs.columns) <= set(out.columns)
    kept = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    left = neardup.brute_force(rows, corpus_pipeline.NEAR)
    assert all(k for _, _, k in left.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{smoke}/benchmark.parquet").collect()]
    assert not any(decontaminate.brute_force(t, items)[4] for t in kept.values())
    slots = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert all(r.n == r.d == r.m + 1 for r in slots)


def test_whole_pipeline_on_odd_rows(spark, smoke, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{smoke}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.select("doc_id", "text", "shard", "slot").collect()
    assert {r.text for r in got} >= {None, "", "one", "a b c d", "x" * 3000} and len({(r.shard, r.slot) for r in got}) == len(got)


def test_near_copies_from_four_fifths_on_go(spark, smoke):
    """Texts of 104 words have 100 shingles; `cut` new words at the end leave 100 - cut of 100 + cut."""
    word = [f"w{i}" for i in range(104)]
    data = []
    for k, cut in enumerate((8, 9, 10, 11, 12, 14)):
        a = [f"{k}_{w}" for w in word]
        data += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a[:-cut] + [f"x{k}_{i}" for i in range(cut)]))]
    assert [neardup.band_rows(p) for p in (80, 85)] == [6, 8]
    want = {i for i, (_, _, kept) in neardup.brute_force(data, 80).items() if kept}
    assert want == {0, 2, 4, 6, 8, 9, 10, 11} < {i for i, (_, _, kept) in neardup.brute_force(data).items() if kept}
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(data, "doc_id long, text string"), smoke)
    assert {r.doc_id for r in out.collect()} == want
