"""Pieces shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: a run of bytes other than the space and the five controls 0x09-0x0D. ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []
#: What empties the tables that a Python worker keeps from task to task.
TABLES: list[Callable[[], None]] = []
#: Seconds that a worker keeps its tables after a task.
IDLE = 2.0
_waiting: list[threading.Timer] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one all executors share (spark.checkpoint.dir); a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="factloom-"))
        base = f"file://{_own_dir[0]}"
    return f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Buckets for what a task gathers in memory: as many as shuffle partitions, or more if ``df`` reads more files' bytes than that."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a plan without statistics says Long.MaxValue or so
    return max(n, min(-(-size // bytes_each), 1 << 20)) if size < 1 << 60 else n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds about ``limit`` bytes in each; one longer row stays whole."""
    for batch in batches:
        sizes = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def local_table(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    """Collected rows as a table again, by way of Arrow; from a list Spark would start Python workers on the executors only to pickle them."""
    return spark.createDataFrame(pa.Table.from_pylist([r.asDict() for r in rows], to_arrow_schema(schema)), schema)


def sampled(known: DataFrame, n: int) -> list:
    """At most ``n`` rows of ``known``, least digest of the id first. A digest's threshold leaves about that many before any are sent to the driver."""
    total = known.count()
    if total > 2 * n:
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) < int((1 << 40) * 1.5 * n / total))
    return known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(n).collect()


def released(tables: bool = True) -> None:
    """Gives a worker's freed memory back to the system; workers live on and share an executor. Kept tables go too, but for ``tables=False``."""
    if tables:
        for empty in TABLES:
            empty()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def tables_kept() -> Iterator[None]:
    """Around a task that uses kept tables: they stay for the next such task if that begins within ``IDLE`` seconds, and go otherwise.

    The next stage may have no Python task that would empty them, and idle workers share its executor's memory.
    """
    while _waiting:
        _waiting.pop().cancel()
    try:
        yield
    finally:
        _waiting.append(timer := threading.Timer(IDLE, released))
        timer.daemon = True
        timer.start()


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id's text is a multiple of 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
