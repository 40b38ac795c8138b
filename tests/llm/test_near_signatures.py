import random

from llm import near


def test_near_unlikely_pairs_are_not_tried(spark):
    """Documents 0.42 alike meet in nodes of nearly all trees, and hardly a pair of them costs its sets."""
    own = random.Random(3)

    def fresh(n):
        return " ".join(f"w{own.randrange(10**9)}" for _ in range(n))

    template = fresh(72)
    rows = [(i, f"{template} {fresh(47)}") for i in range(40)]
    rows += [(40 + i, rows[i][1].rsplit(" ", 5)[0] + " " + fresh(5)) for i in range(3)]
    join = near.Join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r.doc_id: r.component_id for r in join.verdicts().collect()}
    assert {i: c for i, c in got.items() if i != c} == {40: 0, 41: 1, 42: 2}
    tried = spark.read.parquet(join.work.folder("forest")).select("a", "b").distinct().count()
    assert 3 <= tried < 20


def test_near_reads_only_needed_sets(spark):
    """Sets that no pair names are left where they are."""
    own = random.Random(4)
    rows = []
    for i in range(200):
        words = [f"w{own.randrange(10**9)}" for _ in range(60)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "end"]))]
    join = near.Join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    join.verdicts().collect()
    assert join.sets.count() >= 400
    wanted = spark.createDataFrame([(0,), (7,)], "id bigint")
    found = {r.id for r in join._sets_of(wanted, "id").collect()}
    assert {0, 7} <= found and len(found) < 40
