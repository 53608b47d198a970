"""What the training-data operators share: inputs, batch bounds and shared-folder tables."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch for the Python operators, and bytes that an operator works on at once. Spark's default of 10,000 rows of long texts is too much memory.
BATCH_ROWS, SLICE_BYTES = 1000, 1 << 21
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, unless the session already asks for smaller ones."""
    if not 0 < int(spark.conf.get(_KEY, "10000")) <= BATCH_ROWS:
        spark.conf.set(_KEY, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for plans that run inside."""
    was = spark.conf.get(_KEY, "10000")
    spark.conf.set(_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_KEY, was)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if b.num_rows < 2 or b.nbytes <= SLICE_BYTES:
        yield b
    else:
        half = b.num_rows // 2
        yield from _slices(b.slice(0, half))
        yield from _slices(b.slice(half))


def sliced(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow() that gets its batches in slices of SLICE_BYTES, a row at least, and gives free memory back when its task is done."""

    @functools.wraps(run)
    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(s for b in batches for s in _slices(b))
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no such call in this C library
            return

    return go


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator needs, under fixed names; whatever else the table has stays out of its way."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def fold_of(doc_id: int | None, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is set a local session gets a temporary one; a cluster is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="waysift-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder's owner sweeps it
        return


def table(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and lost executors cost nothing of what lies behind. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/waysift-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop_named(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # as in _remove()
        return


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As table(), in buckets of key: joins on key shuffle the other side only. It lies in the warehouse, which a cluster shares."""
    spark = df.sparkSession
    n, at = int(spark.conf.get("spark.sql.shuffle.partitions")), f"waysift_{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).saveAsTable(at)
    atexit.register(_drop_named, spark, at)
    return spark.table(at)


def drop(tables: list[DataFrame], collect: bool = True) -> None:
    """Removes tables made by table() or bucketed() that no later plan reads. With collect the driver's heap is collected then, so that Spark removes the shuffle files of plans that are done."""
    for t in tables:
        for f in t.inputFiles()[:1]:
            folder = f.rsplit("/", 1)[0]
            last = folder.rsplit("/", 1)[1]
            if last.startswith("waysift_"):
                _drop_named(t.sparkSession, last)
            else:
                _remove(t.sparkSession, folder)
    if tables and collect:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def training_sample(labelled: DataFrame, docs: DataFrame, n: int, max_chars: int = 1 << 15):
    """A bounded sample to fit a classifier on, as an Arrow table sorted by doc_id: the n labelled rows that come first by a hash of the id, each with a passage of its text. labelled: doc_id and labels; docs: doc_id, text. A text of over max_chars characters gives max_chars of them, from a place that its id's hash picks, so long texts count however many they are. The picked ids are at most n rows, so they are broadcast."""
    picked = labelled.filter("doc_id is not null").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(n)
    start = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.greatest(F.length("text") - max_chars + 1, F.lit(1))).cast("int") + 1
    passage = F.when(F.length("text") > max_chars, F.substr("text", start, F.lit(max_chars))).otherwise(F.col("text"))
    return docs.withColumn("text", passage).join(F.broadcast(picked), "doc_id").limit(2 * n).toArrow().sort_by("doc_id")
