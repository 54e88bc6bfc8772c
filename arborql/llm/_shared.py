"""What the operators of this subpackage share: the shared folder, tables written to cut lineage, text batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found:
        path = context._jvm.org.apache.hadoop.fs.Path(found)
        whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
        return re.sub(r"^file:/+", "file:///", whole).rstrip("/")
    if not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    found = f"file://{tempfile.mkdtemp(prefix='arborql-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    context.setCheckpointDir(found)
    return found


#: So many rows are worth a file of their own.
ROWS_PER_FILE = 20_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and lost executors cost nothing.

    ``rows``: at most so many, if that's known; few rows of many partitions become few files, of which each costs its writer
    several calls to the file system.

    Inside ``scratch`` the table goes when that ends, unless it's ``kept``. Tables that a result reads stay: they go with the
    folder, which is its owner's to clean.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    written = df if rows is None else df.coalesce(rows // ROWS_PER_FILE + 1)
    written.write.option("compression", "zstd").parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at the end; shuffle files go with the plans that nothing refers to any more."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _SCRATCH.pop():
            at = hadoop.Path(path)
            at.getFileSystem(conf).delete(at, True)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def kept(df: DataFrame) -> DataFrame:
    """A stored table that outlives the scratch that it was stored in, up to the end of the one around it."""
    if _SCRATCH and df._stored_at in _SCRATCH[-1]:
        _SCRATCH[-1].remove(df._stored_at)
        if len(_SCRATCH) > 1:
            _SCRATCH[-2].append(df._stored_at)
    return df


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most_bytes`` each (one row at least), so that memory stays bounded.

    When a task's input ends, what its worker holds for later goes back to the system: workers are used again and again, and
    beside the executor's heap there's little room for what one task needed once.
    """
    seen = 0
    for batch in batches:
        rows = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        seen += batch.nbytes
        if seen >= RELEASE_BYTES:
            seen = 0
            released()
    released()


#: So many bytes of input are read between two releases of memory.
RELEASE_BYTES = 32 << 20


def released() -> None:
    """Gives unused memory of this process back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Rows and bytes of an Arrow batch at most: texts are long, and a batch is held on both sides.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_arrow(spark: SparkSession) -> None:
    """Bounds the memory of what goes to Python and back, unless the session bounds it more."""
    for key, most in ARROW.items():
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_arrow(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column: str, by: int):
    """crc32 of the value as text, modulo ``by``: the fold of a document."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


#: Rows of keys (about 50 bytes each) that are broadcast at most; more are joined by shuffling.
BROADCAST_KEYS = 500_000
KEY = ["__key_a", "__key_b"]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a 128-bit key of id and text in two columns: rows with one key are copies of each other."""
    a, b = F.xxhash64(docs[id_col], docs[text_col]), F.xxhash64(docs[text_col], docs[id_col], F.lit(1))
    return docs.withColumn(KEY[0], a).withColumn(KEY[1], b)


def held(keys: DataFrame) -> DataFrame:
    """``keys``, a stored table, to be broadcast if it's small enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def one_row_each(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """``rows``, keyed, with one row of each key; ``counted`` (keys, n) tells the keys with several, so other rows stay in place."""
    several = stored(counted.where("n > 1").select(*KEY), "several", counted.count() if hasattr(counted, "_stored_at") else None)
    if several.isEmpty():
        return rows
    few = held(several)
    return rows.join(few, KEY, "left_anti").unionByName(rows.join(few, KEY, "left_semi").dropDuplicates(KEY))
