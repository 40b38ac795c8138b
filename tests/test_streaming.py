import random
import time
from collections import Counter

from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.operators import dedup, links, results
from pagescan.options import ScanOptions
from pagescan.sources import readers
from pagescan.storage import Workspace
from pagescan.streaming import live

OPTIONS = ScanOptions(scope_mode=2)
SCHEMA = "page_id bigint, url string, html string"


def arriving(spark, folder, parts=4):
    """The small page table as several files, so that a stream reads several batches."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.repartition(parts, "page_id").write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return pages, stream


def as_responses(pages):
    return readers.responses_from_pages(pages, F.lit("t")).withColumn("depth", (F.col("page_id") % 3).cast("int"))


def test_stream_equals_batch(spark, tmp_path):
    pages, stream = arriving(spark, str(tmp_path / "pages"))
    space = Workspace(spark, "test")
    key = ["page_id", "rule", "count"]
    got = live.run_to(live.live_findings(stream.select("page_id", "html")).select(*key), space, "findings")
    want = live.live_findings(pages.select("page_id", "html")).select(*key)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = live.run_firsts(live.kept_links(stream, OPTIONS), Workspace(spark, "test"), ["url"])
    want = links.kept_links(links.page_links(pages, OPTIONS)).select("link").distinct()
    assert sorted(r.url for r in got.collect()) == sorted(r.link for r in want.collect())
    signed = live.signed_results(as_responses(stream), rules=[]).select("target", "signature")
    got = live.run_firsts(signed, Workspace(spark, "test"), ["target", "signature"])
    want = dedup.with_signature(results.result_records(as_responses(pages), rules=[])).select("target", "signature").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_flags_across_batches(spark, tmp_path):
    pages, stream = arriving(spark, str(tmp_path / "pages"))
    twice = lambda p: as_responses(p).withColumn("content", F.repeat(F.lit("x"), (F.col("page_id") % 5).cast("int")))
    signed = lambda p: dedup.with_signature(results.result_records(twice(p), rules=[])).select("target", "depth", "url", "signature", "status_code")
    space = Workspace(spark, "test")
    got = live.run_flagged(signed(stream), space)
    assert got.count() == pages.count() == 50
    assert got.where("not is_duplicate_signature").count() == 5
    firsts = got.where("not is_duplicate_signature")
    assert firsts.select("signature").distinct().count() == 5


FLAG_ROWS = "target string, depth int, url string, original_url string, signature string, status_code int"


def in_batches(spark, folder, batches):
    """A stream whose every batch is one of the lists of rows."""
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, FLAG_ROWS).coalesce(1).write.parquet(f"{folder}/{number}")
    return spark.readStream.schema(FLAG_ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def row(target, url, original, signature, depth=0):
    return (target, depth, url, original, signature, 200)


def test_flags_of_redirected_rows(spark, tmp_path):
    """Rows that redirects lead to one URL keep flags of their own, within and across batches."""
    first = [row("t", "/z", "/a", "1|200|"), row("t", "/y", "/y", "2|200|")]
    second = [row("t", "/z", "/a2", "1|200|"), row("t", "/z", "/b", "3|200|")]
    third = [row("t", "/z", "/c", "1|200|"), row("t", "/z", "/d", "2|200|")]
    got = live.run_flagged(in_batches(spark, str(tmp_path / "in"), [first, second, third]), Workspace(spark, "test")).collect()
    flags = {r.original_url: r.is_duplicate_signature for r in got}
    assert len(got) == 6
    assert flags == {"/a": False, "/y": False, "/a2": True, "/b": False, "/c": True, "/d": True}


def test_flags_equal_the_batch_result(spark, tmp_path):
    """Four batches with null targets and signatures, repeated rows and redirects, against the batch operator."""
    pick = random.Random(4)
    rows = [
        row(pick.choice(["t", "u", None]), pick.choice(["/z", f"/{i}"]), f"/{i}", pick.choice([None, *"abcdefgh", f"s{i}"]), depth=i // 50)
        for i in range(200)
    ]
    batches = [rows[i : i + 50] for i in range(0, 200, 50)]  # depth grows by batch, so that both count in one order
    batches[1] += batches[1][:5]
    got = live.run_flagged(in_batches(spark, str(tmp_path / "in"), batches), Workspace(spark, "test"))
    want = dedup.flag_duplicates(spark.createDataFrame([r for b in batches for r in b], FLAG_ROWS).coalesce(1))
    columns = [*got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(*columns).collect()))


def test_flags_live_on_in_later_runs(spark, tmp_path):
    """What one run has seen is known to the next; a batch that is run again gives the same rows."""
    space, folder = Workspace(spark, "test"), str(tmp_path / "in")
    stream = in_batches(spark, folder, [[row("t", "/a", "/a", "1"), row("t", "/b", "/b", "1")]])
    assert live.run_flagged(stream, space).where("is_duplicate_signature").count() == 1
    spark.createDataFrame([row("t", "/c", "/c", "1"), row("t", "/d", "/d", "2")], FLAG_ROWS).coalesce(1).write.parquet(f"{folder}/9")
    again = live.run_flagged(stream, space)
    assert {r.url: r.is_duplicate_signature for r in again.collect()} == {"/a": False, "/b": True, "/c": True, "/d": False}
    flags = live.FirstOfKeys(space)
    answers = spark.read.parquet(space.folder("answers/batch=1"))
    flags._answer(stream.schema, spark.createDataFrame(answers.collect(), answers.schema), 1)
    assert flags.rows(spark, stream.schema).count() == 4


def test_a_batch_asks_the_state_once_per_signature(spark, tmp_path):
    """Hot signatures reach the state as one row a batch, and no earlier batch is read."""
    space = Workspace(spark, "test")
    batches = [[row("t", f"/{n}{i}", f"/{n}{i}", "hot") for i in range(300)] for n in range(3)]
    got = live.run_flagged(in_batches(spark, str(tmp_path / "in"), batches), space)
    assert got.count() == 900 and got.where("not is_duplicate_signature").count() == 1
    for n in range(3):
        assert spark.read.parquet(space.folder(f"firsts/batch={n}")).count() == 1


def test_state_can_be_bounded(spark, tmp_path):
    """A signature that was forgotten is new again."""
    space, folder = Workspace(spark, "test"), str(tmp_path / "in")
    stream = in_batches(spark, folder, [[row("t", "/a", "/a", "1")]])
    assert live.run_flagged(stream, space, keep_ms=1).where("is_duplicate_signature").count() == 0
    spark.createDataFrame([row("t", "/b", "/b", "1")], FLAG_ROWS).coalesce(1).write.parquet(f"{folder}/9")
    time.sleep(0.1)
    assert live.run_flagged(stream, space, keep_ms=1).where("is_duplicate_signature").count() == 0


def test_live_csv(spark, tmp_path):
    _, stream = arriving(spark, str(tmp_path / "pages"))
    live.run_live_csv(live.signed_results(as_responses(stream), rules=[]), Workspace(spark, "test"), str(tmp_path / "out"))
    read = spark.read.options(header=True, escape='"', multiLine=True).csv(str(tmp_path / "out"))
    assert read.count() == 50 and read.columns == [*catalog.REPORT_HEADER, "batch"]


def test_hot_keys_are_combined_in_the_jvm(spark, tmp_path):
    """Rows of a key are thinned by an aggregate before they are written; no Python sees them."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("target"), F.lit(None).cast("string").alias("signature"),
        F.array(F.struct("id")).alias("more"),
    )
    space = Workspace(spark, "test")
    live.FirstOfKeys(space, flag=None)._arrive(rows, 0)
    arrived = spark.read.parquet(space.folder("arrived/batch=0"))
    assert arrived.count() == 10_001 and arrived.where("target = 'hot'").first().more[0].id == 0
