"""pipeline (language_id): a corpus without labels keeps its clean documents."""

import corpus_pipeline


def test_all_null_languages(spark):
    rows = [(1, "some clean words", None), (2, "日本語", None), (3, None, None), (4, "", None), (5, "12 34 !", None), (None, "no id", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.keep_languages(spark, table, "")
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, None}
