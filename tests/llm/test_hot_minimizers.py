"""op1: no shard grows with the documents that have a passage between words of their own."""

import random

from pyspark.sql import functions as F

from llm import substrings


def test_hot_minimizers_are_split(spark, monkeypatch):
    own = random.Random(4)

    def fresh(n):
        return " ".join(f"w{own.randrange(10**6)}" for _ in range(n))

    passage = fresh(20)
    rows = [(i, f"{fresh(15)} {passage} {fresh(15)}") for i in range(200)]
    rows += [(300 + i, rows[i][1] + " end") for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(substrings, "SYMBOLS", 400)
    docs = table.withColumn("version", F.hash("text"))
    shared = docs.join(substrings.candidates(table), "doc_id")
    sizes = substrings.sharded(shared, substrings.hot_minimizers(table)).groupBy("shard").agg(F.sum(F.length("codes") / 4).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 400
    seen, want = {}, {}
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove(table).collect()} == want
