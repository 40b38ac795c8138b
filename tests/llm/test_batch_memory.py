import random
import tracemalloc

import numpy as np
import pyarrow as pa

from llm import bpe, language, near
from llm.queries import tokenizer
from llm.tables import BATCH_BYTES, texts

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_long_texts_are_bounded(spark):
    """Of 24 MB in one partition, fewer rows than a batch may have, Python gets a few MB at a time; a size set by the user stays."""

    def largest(batches):
        yield pa.record_batch({"n": pa.array([max((batch.nbytes for batch in batches), default=0)], pa.int64())})

    before = spark.conf.get(SETTING, None)
    try:
        docs = spark.range(2000, numPartitions=1).selectExpr("id doc_id", "repeat('word of text ', 1000) text", "'en' lang")
        model = language.Model([], np.zeros((0, 0), np.float32), np.zeros((0, 0), bool))
        for step in (texts, lambda docs: language.with_language(docs, model)):
            spark.conf.unset(SETTING)
            assert 0 < step(docs).mapInArrow(largest, "n bigint").first().n < 2 * BATCH_BYTES
        spark.conf.set(SETTING, "9999999")
        texts(docs)
        assert spark.conf.get(SETTING) == "9999999"
    finally:
        spark.conf.unset(SETTING)
        if before is not None:
            spark.conf.set(SETTING, before)


def _peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_python_steps_of_the_pipeline_are_small():
    """Peak MB of each text step over one batch of some 6 MB."""
    own = random.Random(6)
    vocabulary = [f"w{own.randrange(10**5)}" for _ in range(3000)]
    rows = [" ".join(own.choices(vocabulary, k=500)) for _ in range(2000)]
    ids = pa.array(np.arange(len(rows)))
    batch = pa.record_batch({"doc_id": ids, "text": pa.array(rows), "version": ids})
    assert batch.nbytes > 5 << 20
    model = language.Model(["a", "b", "c"], np.zeros((language.BUCKETS, 3), np.float32), np.ones((len(language.SCRIPTS), 3), bool))
    got = {
        "profiles": _peak(lambda: [None for _ in near._profiles(iter([batch]))]),
        "sets": _peak(lambda: [None for _ in near._sets(iter([batch]))]),
        "labels": _peak(lambda: language._labels(batch, model, language.SWITCH)),
        "ids": _peak(lambda: [None for _ in bpe.encoded(iter([batch]), tokenizer())]),
    }
    most = {"profiles": 35, "sets": 35, "labels": 60, "ids": 150}
    assert all(got[step] < most[step] for step in most), got
