"""Queries read the whole of their tables."""

from graphloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_op7_segments_every_document(spark):
    ids = {str(x[0]) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {x[0] for x in queries.op7_segmentation(spark, SF).select("row_key").collect()} == ids
