"""What the operators share: words, tables written between steps, slices of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.session import scratch_folder

#: ASCII white space; everything else belongs to a word.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it survives lost executors and its size is known."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def row_key(*values: Column) -> Column:
    """16 bytes that tell rows apart by these values; NULL differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def slices(batches: Iterable[pa.RecordBatch], text: str, characters: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows of about so many bytes of text; one long text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > characters:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def released(run: Callable) -> Callable:
    """``run`` over the batches of a task; what it has freed goes back to the system at the end, since Python workers live on."""
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # Another C library: it keeps what it holds.

    return over


def aside(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, under the operator's own names: others cannot clash."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def held(docs: DataFrame) -> Column:
    """All columns of a row as one struct, out of the way of the operator's own names; ``row.*`` gives them back."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
