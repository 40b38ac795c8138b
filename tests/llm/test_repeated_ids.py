"""pipeline (near_dedup): an id that is repeated with different texts."""

from llm import near


def test_only_the_copies_of_an_id_go(spark):
    one, other = "a text of seven words or so", "quite another text without a copy"
    rows = [(3, one), (5, one.upper()), (5, other), (7, None), (None, one)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = near.deduplicate(table)
    assert left.columns == table.columns
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [(3, one), (5, other), (7, None), (None, one)]))
    got = sorted(map(tuple, near.classes(table).select("doc_id", "component_id", "kept").collect()))
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 7, True)]
