from pagescan.storage import Workspace
from pagescan.streaming import live


def test_first_rows_ask_no_python_for_each_key(spark):
    """The first row of each key over several batches and two runs, from a state that Spark keeps itself."""
    space = Workspace(spark, "test_firsts")
    folder, schema = space.folder("in"), "url string, place bigint"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)

    firsts = live.FirstOfKeys(space, ["url"], ["place"], None)

    def run():
        stream = live.page_stream(spark, folder, schema, max_files=1)
        firsts.arrivals(stream).trigger(availableNow=True).start().awaitTermination()
        answers = firsts.answers(spark, stream.schema).trigger(availableNow=True).start()
        answers.awaitTermination()
        found = firsts.rows(spark, stream.schema)
        return sorted(map(tuple, found.collect()), key=str), {s["operatorName"] for p in answers.recentProgress for s in p["stateOperators"]}

    arrive(("a", 3), ("a", 2), (None, 5))
    arrive(("a", 1), ("b", 7))
    got, operators = run()
    assert got == sorted([("a", 2), (None, 5), ("b", 7)], key=str)
    assert operators == {"stateStoreSave"}
    arrive(("b", 0), ("c", 9), ("c", 8), (None, 1))
    got, _ = run()
    assert got == sorted([("a", 2), (None, 5), ("b", 7), ("c", 8)], key=str)
