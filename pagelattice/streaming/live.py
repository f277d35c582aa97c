"""Streams: search over pages that still arrive, documents opened once, batches of requests in order. State that follows event time is in `ordered`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import is_pdf
from ..operators import search
from ..sources import letters as L

TICK = "500 milliseconds"


def documents(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    """A stream of the rows of Parquet files that are put under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def live_search(docs: DataFrame, query: str) -> DataFrame:
    """Hits in documents as they arrive: without state, as each page is seen once."""
    return search.search(search.page_text(L.word_values(L.pages(docs))), query)


def opened(paths: DataFrame, watermark: str | None = None) -> DataFrame:
    """Paths (path, ts) of PDF files, each once; with a watermark, once within it, and the state stays bounded."""
    found = paths.where(is_pdf(F.col("path")))
    return found.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["path"]) if watermark else found.dropDuplicates(["path"])


def start(df: DataFrame, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream to Parquet files; once: all that is there, else every half second."""
    w = df.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=TICK)).start()


def in_order(requests: DataFrame, work, checkpoint: str) -> StreamingQuery:
    """Hands each batch of requests (page_no, type, cancelled) to work(df, batch), most urgent first, without cancelled ones. A batch that
    fails is noted and left, as one request's failure must not stop the others."""
    from ..operators.order import priority

    def each(df: DataFrame, batch: int) -> None:
        try:
            work(priority(df), batch)
        except Exception as e:  # noqa: BLE001
            df.sparkSession.sparkContext._jvm.System.err.println(f"batch {batch}: {e}")

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(done, total):
    """Percent of the pages that are searched, rounded up; 0 of none."""
    return F.coalesce(F.ceil(100.0 * done / F.nullif(total, F.lit(0))), F.lit(0)).cast("int")


class Search:
    """The one search that runs over a stream: a new query stops the one before, whose hits stay where they are."""

    def __init__(self, docs: DataFrame, base: str, once: bool = False):
        self.docs, self.base, self.once = docs, base, once
        self.running: StreamingQuery | None = None
        self.number = 0

    def replace(self, query: str) -> str:
        """Starts a query and gives the folder of its hits."""
        if self.running is not None and self.running.isActive:
            self.running.stop()
        self.number += 1
        sink = f"{self.base}/hits-{self.number}"
        self.running = start(live_search(self.docs, query), sink, f"{self.base}/checkpoint-{self.number}", self.once)
        return sink


def selected(changes: DataFrame) -> DataFrame:
    """What each change (window, ts, id, doc_id) of a window's selected document does: doc_id becomes active, and `cleared` is the one
    that was, if it is another."""
    from pyspark.sql import Window as W

    before = F.lag("doc_id").over(W.partitionBy("window").orderBy("ts", "id"))
    return changes.withColumn("cleared", F.when(before != F.col("doc_id"), before))
