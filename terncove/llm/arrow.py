"""Adding columns computed in Python while all other columns pass through as Arrow data, untouched."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows are handed to Python functions in groups of about this many characters, and of this many rows at most.
GROUP_CHARS = 500_000
GROUP_ROWS = 1_000
#: What goes to and from Python at once, unless the session asks for less: a batch is held by the JVM and by Python at a time.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes; texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Give memory that is free back to the system: a worker serves many tasks and would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's batches, with ``trim`` at its end."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def groups_of(texts: list[str | None], most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of at most about ``most`` characters; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def append(
    df: DataFrame, fn: Callable[..., dict[str, list]], reads: list[str], adds: list[tuple[str, T.DataType, pa.DataType]], drop: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` without ``drop`` and without columns named like an added one, and the columns ``fn`` computes.

    ``fn`` gets lists of the values of the columns ``reads``, the first of which holds strings, and returns lists by name.
    """
    small_batches(df.sparkSession)
    new = [a[0] for a in adds]
    gone = {n.lower() for n in (*new, *drop)}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t, _ in adds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, piece in enumerate(b.slice(at, GROUP_ROWS) for b in batches for at in range(0, b.num_rows, GROUP_ROWS)):
            if k % 8 == 7:
                trim()
            texts = piece.column(piece.schema.get_field_index(reads[0])).to_pylist()
            for lo, hi in groups_of(texts):
                part = piece.slice(lo, hi - lo)
                rest = [part.column(part.schema.get_field_index(r)).to_pylist() for r in reads[1:]]
                made = fn(texts[lo:hi], *rest)
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(made[n], t) for n, _, t in adds)], [*names, *new])

    return df.mapInArrow(trimmed(run), schema)
