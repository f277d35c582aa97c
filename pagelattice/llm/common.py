"""What the operators of this package share: the shared folder, written intermediate tables, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the operators know: space and the controls 9 to 13.
SPACE = "\x20\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process may do without: it has a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: tables between the steps are written there")
        found = _own.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="pagelattice-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


#: Folders of sessions in one process that name no shared folder.
_own: dict[str, str | None] = {}


#: Bytes of a batch that goes to a Python worker or comes back. Buffers double as they grow, on both sides and for each running task.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_BYTES for the jobs that are planned within; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    if 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(key, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends, and a lost executor loses nothing. by: a folder for each
    value of this column, so that drop() may take one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame | None, part: str | None = None) -> None:
    """Deletes a table that staged() wrote, or one of its parts ("column=value"). For tables whose results have all been written elsewhere."""
    if table is None:
        return
    spark = table.sparkSession
    root = shared_dir(spark)
    for folder in {f[: f.index("/", f.index(root) + len(root) + 1)] for f in table.inputFiles() if root in f}:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}" if part else folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df; 0 where it has none (rows that the driver or an RDD brought)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are over; they otherwise stay until the driver collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives what a worker has freed back to the system. Worker processes go on from stage to stage, and hold it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 16 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the texts of each hold about `most` bytes (one row may hold more)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (held + n > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_column(df: DataFrame):
    return F.coalesce(df["text"], F.lit(""))
