"""What the operators of this subpackage share: inputs, the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='chronoloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it back, which cuts its lineage. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronoloom-{uuid.uuid4().hex}/{name}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


#: Bytes of an Arrow batch sent to Python, so that a worker's memory doesn't follow the length of texts.
BATCH_BYTES = 8 << 20


def release_memory() -> None:
    """Gives back to the system what a task has freed; workers are used again by later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries
        pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of bounded size, with its memory released at the end of each task.

    The bound is a setting of the session that is read when a plan runs, so it stays set for the session."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) != str(BATCH_BYTES):
        conf.set(key, str(BATCH_BYTES))

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(tidy, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key():
    """A key for a row of documents: equal for repeated rows, different for rows which share only doc_id."""
    return F.concat_ws(
        "|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.coalesce(F.md5(F.col("text")), F.lit("~"))
    )


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the row offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - lo if len(column) else np.zeros(1, np.int64)


def row_slices(offsets: np.ndarray, most: int):
    """Cuts rows into runs of about `most` bytes each; a longer row is a run of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end
