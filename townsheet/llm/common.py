"""What several operators share: the documents table, the shared folder, word rules, batches."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these (space, tab, line feed to carriage return).
SPACES = "[\\x20\\x09-\\x0D]"

#: Rows and bytes of an Arrow batch sent to Python, and bytes of text that a task opens at a time.
BATCH_ROWS, BATCH_BYTES, PIECE_BYTES = 2000, 8 << 20, 4 << 20
#: Bytes of files, compressed, of a table that may be broadcast.
BROADCAST_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of the session's Arrow batches, so that long texts do not pile up in one."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(key, None)
        if held is None or not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, most)


def pieces(texts: pa.Array, most: int = PIECE_BYTES):
    """(start, slice) of some MB of text each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = 0
    while at < len(sizes):
        upto, size = at, 0
        while upto < len(sizes) and (upto == at or size < most):
            size += sizes[upto]
            upto += 1
        yield at, texts.slice(at, upto - at)
        at = upto


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; local mode, which is one machine, may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_SCRATCH: list[list[DataFrame]] = []


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(out)
    return out


@contextmanager
def scratch():
    """Tables saved within are deleted at its end, but for those to keep: for steps that write their result."""
    made: list[DataFrame] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.pop()
        forget(*made)


def _files(table: DataFrame):
    """File system and path of a saved table."""
    spark = table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(table.saved_path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def sized(table: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """A saved table, or a projection of it, marked for broadcast only if the bytes of its files allow it."""
    system, where = _files(table if of is None else of)
    return F.broadcast(table) if system.getContentSummary(where).getLength() <= BROADCAST_BYTES else table


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`saved` that no later step reads."""
    for table in tables:
        if getattr(table, "saved_path", None):
            system, where = _files(table)
            system.delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def py_crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
