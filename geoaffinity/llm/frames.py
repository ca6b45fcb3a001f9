"""Helpers that the operators share: words, row streams and written intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaffinity.sources.shared import remove


def utf8(text: str | None) -> bytes:
    """The text in UTF-8; nothing for null."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and U+0009 to U+000D, in UTF-8."""
    return utf8(text).split()


def give_back() -> None:
    """Return to the system what Arrow, and the C library where it can, keep free for more."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; after the last, Arrow gives back the memory that it keeps for more.

    A Python worker outlives its task and may be idle while other stages need the memory.
    """
    try:
        yield from batches
    finally:
        give_back()


def columns_of(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[list[list]]:
    """The columns of each batch as Python lists, a bounded number of rows at a time."""
    for batch in returned(batches):
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield [column.to_pylist() for column in part.columns]


def small_columns_of(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 8 << 20) -> Iterator[list[list]]:
    """The same with a bound on the bytes of each part too, of more rows than one."""

    def parts(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if part.num_rows <= 1 or (part.num_rows <= rows and part.nbytes <= size):
            yield part
            return
        half = part.num_rows // 2
        yield from parts(part.slice(0, half))
        yield from parts(part.slice(half))

    for batch in returned(batches):
        for part in parts(batch):
            yield [column.to_pylist() for column in part.columns]


def small_batches(spark: SparkSession) -> None:
    """Let the session send no more than 1,000 rows or 8 MB to a Python worker at once, and read no
    more than 1,000 rows of Parquet at once.

    A batch is held by Spark and by the worker, as Arrow and as Python objects; a thousand texts
    are work enough for it. Smaller bounds that are already set stay.
    """
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(rows, min(1000, int(spark.conf.get(rows))))
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def unused(names: list[str], taken: list[str]) -> list[str]:
    """Column names like these that differ from all taken ones, in any case."""
    lowered = {name.lower() for name in taken}
    while any(name.lower() in lowered for name in names):
        names = [f"_{name}" for name in names]
    return names


def batch_of(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(columns, schema, strict=True)],
        schema=schema,
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where nothing is named, as in tests on a local master, a temporary folder is set; any other
    master has to name one, because its executors share no temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    named = named or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="llm-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def checkpointed(frame: DataFrame) -> DataFrame:
    """The rows of a frame, stored in the shared folder; Spark removes them when unreachable."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """The rows of a frame, written as Parquet to the shared folder and read again.

    For large intermediate tables of which later steps read some columns. The folder's retention
    policy removes them.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Remove the folder of a frame as stored returned it, when no later step reads it."""
    for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
        if not folder.rpartition("/")[2].startswith("llm-"):
            raise ValueError(f"{folder} holds no stored frame")
        remove(frame.sparkSession, folder)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes the shuffle files of each query when the query ends.

    For steps that are stored and whose frames are not run again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def smallest_hashes(place: Column, rows: int, total: int) -> tuple[Column, float]:
    """Whether a 64-bit hash is among the least that some more rows than these have, of a total; and
    the share of all hashes that this is. What is chosen this way needs no sort of all rows."""
    share = min(1.0, (1.2 * rows + 200) / max(1, total))
    return place <= F.lit(min((1 << 63) - 1, int(share * 2**64) - (1 << 63))), share


def crc_fold(column: str = "doc_id", folds: int = 5):
    """crc32 of an id as text, modulo the number of folds; 0 for a null id."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
