"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.storage import settle as materialise
from quern.storage import shared_dir

__all__ = ["chunks_by_size", "column_bytes", "fold", "materialise", "released", "shared_dir", "table", "text_or_empty", "with_payload"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_payload(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of docs, and all its own columns as one struct ``payload``, in which no name can clash with others."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("payload"), *columns)


def released(batches):
    """A function for mapInArrow that gives Arrow's unused memory back to the system when its task ends, since workers live on."""

    def run(source):
        import pyarrow as pa

        try:
            yield from batches(source)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def text_or_empty(column: str | Column = "text") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def column_bytes(batch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column of an Arrow batch; null gives b''."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunks_by_size(items: Iterable, limit: int, size=len) -> Iterable[tuple[int, int]]:
    """Ranges (from, to) of consecutive items of about ``limit`` in sum of sizes; one item at least."""
    start, held = 0, 0
    at = 0
    for at, item in enumerate(items, 1):
        held += size(item)
        if held >= limit:
            yield start, at
            start, held = at, 0
    if start < at:
        yield start, at
