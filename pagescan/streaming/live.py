"""The scan operators on streams of captured pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from pagescan.operators.dedup import ROW_KEY, with_signature
from pagescan.operators.detect import Rule, findings
from pagescan.operators.links import page_links
from pagescan.operators.report import report_rows
from pagescan.operators.results import result_records
from pagescan.options import ScanOptions
from pagescan.sources.writers import titled
from pagescan.storage import Workspace

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_stream(spark: SparkSession, folder: str, schema: StructType | str, files: str = "*.parquet",
                spread_by: str | None = None, max_files: int | None = None) -> DataFrame:
    """Captured pages as they arrive in a folder.

    ``max_files`` bounds the files of one batch; what is more waits for the next.
    ``spread_by`` names a key to spread each batch by, for sources whose files
    are few and large; scanning text costs far more than reading it.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    stream = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(folder)
    return stream if spread_by is None else stream.repartition(spark.sparkContext.defaultParallelism, spread_by)


def signed_results(responses: DataFrame, rules: Iterable[Rule] | None = None, hashed: str | None = None) -> DataFrame:
    """Results with their signature as they come; stateless."""
    return with_signature(result_records(responses, rules), hashed)


def live_findings(pages: DataFrame, text: str = "html", rules: Iterable[Rule] | None = None) -> DataFrame:
    """Findings of pages as they arrive; stateless."""
    return findings(pages, text, rules)


def kept_links(pages: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Kept links of pages as they come; stateless."""
    return page_links(pages, options).where(F.col("disposition") == "keep").select(F.col("link").alias("url"))


def run_to(stream: DataFrame, space: Workspace, table: str) -> DataFrame:
    """Process all that has arrived into a table and return the table."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", space.folder(f"{table}-progress"))
        .trigger(availableNow=True)
        .start(space.folder(table))
    )
    query.awaitTermination()
    return space.read(table, stream)


def _whole_key(by: list[str]) -> Column:
    """The columns as one text that is never null and tells null from any value."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"})


class _FirstOfKey(StatefulProcessor):
    """Of the first rows that batches bring of a key, the first of all, now or in any earlier run."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "batch bigint", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda row: row["batch"])
        known = self.seen.exists()
        if not known:
            self.seen.update((rows[0]["batch"],))
        for place, row in enumerate(rows):
            yield Row(key=key[0], batch=row["batch"], row=row["row"], first=place == 0 and not known)

    def close(self) -> None:
        pass


class FirstOfKeys:
    """What is first of its key across the batches of a stream: duplicate flags, live results, new links.

    Two queries work hand in hand.  `arrivals` writes each batch of rows once and, for every value of the key ``by`` in it, its
    first row by ``order`` and place: one row a key, however many share it, by a pre-aggregated minimum.  `answers` reads these first rows as a
    stream of its own and asks a keyed state, one value for each key, whether the key is new (a streaming aggregate where only the first rows are wanted
    and no key is forgotten, else a processor of each key); then it
    joins the answers to the batch's rows.  What a batch costs depends on its own rows, not on those of earlier batches.

    With ``flag`` all rows come out, with the column ``flag``, false for the first of a key; without it only the first rows do, and no others are written.
    Batches go to folders named after them, so one that is run again overwrites what it wrote.  Rows count in
    batches as in a scan; null is a value of a key like others.  ``keep_ms`` forgets a key after so long;
    without it the state keeps every one.  ``sink`` gets the rows of each batch of answers and its number; by default they are
    written as Parquet and read by `rows`.
    """

    def __init__(self, space: Workspace, by: list[str] = ["target", "signature"], order: list[str] = ["depth", "url", *ROW_KEY],
                 flag: str | None = "is_duplicate_signature", keep_ms: int | None = None, sink: Callable[[DataFrame, int], None] | None = None):
        self.space, self.by, self.order, self.flag, self.keep_ms = space, by, order, flag, keep_ms
        self.sink = sink or (lambda rows, number: rows.write.mode("overwrite").parquet(self._batch("rows", number)))

    def _batch(self, table: str, number: int | str) -> str:
        return f"{self.space.folder(table)}/batch={number}"

    def _arrive(self, batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"_row": F.monotonically_increasing_id(), "_key": _whole_key(self.by)})
        order = F.struct(*dict.fromkeys(c for c in [*self.order, "original_url", "_row"] if c in rows.columns))
        if self.flag is None:
            rows = rows.groupBy("_key").agg(F.min_by(F.struct(*batch.columns, "_row"), order).alias("least")).select("least.*", "_key")
        rows.write.mode("overwrite").parquet(self._batch("arrived", number))
        firsts = batch.sparkSession.read.schema(rows.schema).parquet(self._batch("arrived", number))
        if self.flag is not None:
            firsts = firsts.groupBy("_key").agg(F.min(order).alias("least")).select("_key", "least._row")
        firsts = firsts.select(F.col("_key").alias("key"), F.lit(number).cast("bigint").alias("batch"), F.col("_row").alias("row"))
        firsts.write.mode("overwrite").parquet(self._batch("firsts", number))

    def _answer(self, schema: StructType, answers: DataFrame, number: int) -> None:
        spark = answers.sparkSession
        # Written first: the state is asked once, and the answers say which batches to read.
        folder = self._batch("answers", number)
        answers.write.mode("overwrite").parquet(folder)
        answers = spark.read.schema(answers.schema).parquet(folder)
        if self.flag is None:
            answers = answers.where("first")
        batches = sorted(r["batch"] for r in answers.select("batch").distinct().collect())
        if not batches:
            return
        # Named one by one: neither the rows nor the list of earlier batches is read.
        stored = StructType([*schema, StructField("_row", LongType()), StructField("_key", StringType()), StructField("batch", LongType())])
        rows = spark.read.schema(stored).option("basePath", self.space.folder("arrived")).parquet(*[self._batch("arrived", b) for b in batches])
        answers = answers.withColumnsRenamed({"key": "_key", "row": "_least"})
        met = rows.join(answers, ["_key", "batch"])
        if self.flag is None:
            # The only row of its key that the batch has written.
            self.sink(met.select(*schema.names), number)
        else:
            first = F.col("first") & (F.col("_row") == F.col("_least"))
            self.sink(met.select(*schema.names, (~first).alias(self.flag)), number)

    def arrivals(self, stream: DataFrame) -> DataStreamWriter:
        """Rows as they come; call ``start``."""
        return stream.writeStream.foreachBatch(self._arrive).option("checkpointLocation", self.space.folder("arrivals-progress"))

    def answers(self, spark: SparkSession, schema: StructType) -> DataStreamWriter:
        """What is first among the rows that have arrived (``schema`` is theirs); call ``start``.

        The keyed state needs the RocksDB state store, which is set for the session.
        """
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
        Path = spark._jvm.org.apache.hadoop.fs.Path
        folder = Path(self.space.folder("firsts"))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        firsts = spark.readStream.schema("key string, row bigint, batch bigint").parquet(self.space.folder("firsts"))
        if self.flag is None and self.keep_ms is None:
            # A key is new if no earlier batch of answers, each of a time of its own, has met it.
            met = firsts.withColumn("now", F.current_timestamp()).groupBy("key")
            met = met.agg(F.min("batch").alias("batch"), F.min("now").alias("since"), F.max("now").alias("now"))
            answers, mode = met.select("key", "batch", (F.col("since") == F.col("now")).alias("first")), "update"
        else:
            answers, mode = firsts.groupBy("key").transformWithState(
                _FirstOfKey(self.keep_ms), "key string, batch bigint, row bigint, first boolean", "Append",
                "None" if self.keep_ms is None else "ProcessingTime",
            ), "append"
        return answers.writeStream.outputMode(mode).foreachBatch(lambda rows, number: self._answer(schema, rows, number)).option(
            "checkpointLocation", self.space.folder("answers-progress")
        )

    def rows(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """All rows written so far."""
        flag = [] if self.flag is None else [StructField(self.flag, BooleanType())]
        folder = self.space.folder("rows")
        return spark.read.schema(StructType([*schema, *flag, StructField("batch", LongType())])).option("basePath", folder).parquet(folder).drop("batch")

    def run(self, stream: DataFrame) -> None:
        """Process all that has arrived."""
        self.arrivals(stream).trigger(availableNow=True).start().awaitTermination()
        # With a time to live the state wants another batch for ever; one takes all first rows.
        trigger = {"availableNow": True} if self.keep_ms is None else {"once": True}
        self.answers(stream.sparkSession, stream.schema).trigger(**trigger).start().awaitTermination()


def run_flagged(results: DataFrame, space: Workspace, keep_ms: int | None = None) -> DataFrame:
    """Results of a stream with their duplicate flag, after all that has arrived."""
    flags = FirstOfKeys(space, keep_ms=keep_ms)
    flags.run(results)
    return flags.rows(results.sparkSession, results.schema)


def run_firsts(stream: DataFrame, space: Workspace, by: list[str], order: list[str] = [], keep_ms: int | None = None) -> DataFrame:
    """The first row of each key of a stream, after all that has arrived."""
    firsts = FirstOfKeys(space, by, order, None, keep_ms)
    firsts.run(stream)
    return firsts.rows(stream.sparkSession, stream.schema)


def run_live_csv(results: DataFrame, space: Workspace, path: str, keep_ms: int | None = None) -> None:
    """Report rows of the first result of each signature, as CSV files in a folder for each batch."""
    def write(rows: DataFrame, number: int) -> None:
        titled(report_rows(rows)).write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(f"{path}/batch={number}")

    FirstOfKeys(space, flag=None, keep_ms=keep_ms, sink=write).run(results)
