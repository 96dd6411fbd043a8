"""The pipeline's stages take effect, keep clean documents and agree with one another."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = C.written(docs, "test")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] >= counts[4] > 0
    assert docs.select("doc_id").distinct().count() == counts[4]
    pieces = C.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == counts[4]
    before = set(C.written_tables(spark))
    assert C.run(spark, sf_dir).count() == pieces.count()
    left = [path.rsplit("/", 1)[-1].rsplit("-", 1)[0] for path in C.written_tables(spark) if path not in before]
    assert sorted(left) == ["tracklens-near-duplicates", "tracklens-tokens"]  # what the last stage still reads
    assert len(C.STAGES) == 5 and C.ORACLE_SQL is None


@pytest.mark.parametrize("name", [name for name, _ in C.STAGES])
def test_stage_edge_cases(spark, sf_dir, edge_documents, no_documents, name):
    """Nulls in any column, empty and long texts, repeated rows and ids, an empty table, columns with clashing names."""
    stage = dict(C.STAGES)[name]
    docs = edge_documents.unionByName(spark.createDataFrame([(2, "another text of the same id", None, None, None), (None, None, None, None, None)], edge_documents.schema))
    for c in ("_id", "_text", "_key", "_hash", "_part", "_n", "class_id", "component", "_covered", "start", "score", "ids", "_own_hash"):
        docs = docs.withColumn(c, F.lit("x"))
    out = stage(spark, docs, sf_dir)
    if name == "packing":
        texts = out.groupBy("doc_id").agg(F.sum("length").alias("n")).filter("doc_id = 3").first()
        assert texts["n"] == 1 and out.filter("doc_id is null").count() >= 2  # the end mark alone; null ids are documents too
    else:
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) <= docs.count() and all(r["_text"] == "x" for r in rows)
        if name == "line dedup":
            assert len(rows) == docs.count()
        if name == "near duplicates":
            assert sorted(r["text"] for r in rows if r["doc_id"] in (1, 2)) == ["another text of the same id", "the quick brown fox jumps over the lazy dog again and again"]
            assert sum(r["doc_id"] is None for r in rows) == 2
    assert stage(spark, no_documents, sf_dir).count() == 0


def test_classifying_stages_keep_clean_rows(spark):
    """On the table of sf0.01; a tenth of its labelled rows is too few to learn from."""
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("the driver's tables are not here")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    clean = docs.join(labels.filter("quality = 1 and toxic = 0"), "doc_id").select(*docs.columns)
    bad = docs.join(labels.filter("quality = 0"), "doc_id").select(*docs.columns)
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id").select(*docs.columns)
    kept = [stage(spark, rows, sf_dir).count() / rows.count() for stage, rows in ((C.quality_stage, clean), (C.quality_stage, bad), (C.toxicity_stage, clean), (C.toxicity_stage, toxic))]
    print("kept: good", kept[0], "bad", kept[1], "clean", kept[2], "toxic", kept[3])
    assert kept[0] >= 0.9 and kept[1] <= 0.3 and kept[2] >= 0.95 and kept[3] <= 0.4
