"""Pieces that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def unit_hash(*columns: Column) -> Column:
    """A deterministic number in [0, 1) for each row, for bounded samples of training rows."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_exchange(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``keys`` (longs or strings) as new expressions, for the side of a join that was just aggregated by them.

    The planner then exchanges this small side again instead of taking over its partitioning, and with an exchange of
    its own on both sides adaptive execution can split the partition of a hot key on the other side.
    """
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.withColumns({k: F.concat(k, F.lit("")) if k in text else F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})


def slices(batches: Iterator[pa.RecordBatch], column: str | int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose ``column`` has at most ``most_bytes`` bytes (one row at least)."""
    for batch in batches:
        data = batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column % batch.num_columns)
        start = size = 0
        lengths = pc.fill_null(pc.binary_length(data), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
