import os

from pagescan.sources import readers
from registry import inputs


def test_partitions_grow_with_the_text(spark, tmp_path, monkeypatch):
    """A larger table has more partitions, not longer tasks."""
    path = f"{tmp_path}/pages.parquet"
    spark.range(4000).selectExpr("id AS page_id", "concat('http://h.example.com/', id) AS url", "repeat(md5(cast(id AS string)), 9) AS html").write.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert inputs.pages(spark, str(tmp_path)).rdd.getNumPartitions() == cores
    size = sum(os.path.getsize(os.path.join(path, name)) for name in os.listdir(path))
    monkeypatch.setattr(readers, "PART_BYTES", size // (3 * cores))
    parts = inputs.pages(spark, str(tmp_path)).rdd.getNumPartitions()
    assert 3 * cores <= parts <= 3 * cores + 2
