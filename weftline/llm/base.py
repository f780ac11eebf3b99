"""What the operators share: written intermediate tables, orders by hash, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, drop_folder, new_folder, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Places of rows in an order by hash.
PLACES = 1 << 62


def place_of(*columns: str) -> F.Column:
    """A row's place, 0 to PLACES, in an order by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(PLACES))


def first_by_hash(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """The first ``size`` rows in the order by hash of ``columns``.

    A place that about twice as many rows stay below cuts the rest off in the scan, so that what is sorted
    and gathered does not grow with the table or with the number of its partitions.
    """
    n = df.count()
    place = place_of(*columns)
    if n > 4 * size:
        cut = PLACES // n * 2 * size
        if df.where(place < cut).limit(size).count() == size:
            df = df.where(place < cut)
    return df.orderBy(place, *columns).limit(size)


def crc32_of(column: str) -> F.Column:
    """crc32 of a column's text form; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


#: Rows of an Arrow batch of texts at most: Spark's own default holds tens of megabytes on both sides, twice.
BATCH_ROWS = 1000


@contextmanager
def short_batches(spark: SparkSession):
    """Within the block, jobs send rows to Python in short batches; afterwards the session is as it was."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        conf.set(key, before)


def give_back() -> None:
    """Return memory that a finished task leaves in the worker's allocators to the system."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def chunks(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of at most ``rows`` rows, so that a worker's memory
    depends on that many documents and not on Arrow's batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


#: Bytes of text that are encoded together, about.
TEXT_BYTES = 4 << 20


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of about ``size`` bytes of text (or one longer text)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype("int64").cumsum()
        at = 0
        while at < b.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(ends.searchsorted(base + size, "right")))
            yield b.slice(at, to - at)
            at = to
    give_back()


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a column; null reads as the empty text."""
    return [t or "" for t in column.to_pylist()]
