import os

import pytest

import corpus_pipeline
from quadtide.llm import quality

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no data folder")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    fitted, held = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    got = quality.score(docs, fitted).join(held, quality.F.col("id") == held.doc_id).select("kept", "quality").collect()
    assert len(got) > 50 and sum(r.kept == (r.quality == 1) for r in got) >= 0.95 * len(got)


def test_sparse_sites_shrink_to_their_level(spark):
    good = "This is a fine sentence with many ordinary words in it, and it ends well."
    bad = "### $$$ %%% &&& ### $$$ %%% &&& ### @@@ !!! ###"
    rows = [(i, f"{good if i % 5 else bad} Number {i % 9} of some.", "en", f"site{i % 17}") for i in range(1, 600)]
    rows += [(600, bad, "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(1, 600, 2)], "doc_id long, quality int")
    got = {r.id: r for r in quality.score(docs, labels).collect()}
    # One bad document does not make a bad site; all its documents would.
    assert got[600].evidence < -1 and not got[600].kept and got[1].kept and not got[5].kept
    assert got[600].host_prior > 0.4
    assert got[1].posterior > got[5].posterior


def test_odd_rows_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(odd, labels).count() == 13 and quality.score(none, labels).count() == 0
    assert all(r.kept for r in quality.score(odd, labels).collect())


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for kind, docs in (("odd", odd), ("none", none)):
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{kind}")
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data folder")
def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert rows and {r.doc_id for r in rows} <= docs
    assert all(n == 4096 or n & (n - 1) == 0 for n in used.values())
