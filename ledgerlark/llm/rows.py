"""Rows that keep their columns while an Arrow job replaces one of them by others."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame


def free_name(names: list[str], name: str) -> str:
    """name, or name with underscores where a column, in any spelling, has it already."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def replaced(batch: pa.RecordBatch, drop: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch without its column number drop, and with columns at its end."""
    kept = [i for i in range(batch.num_columns) if i != drop]
    return pa.RecordBatch.from_arrays(
        [batch.column(i) for i in kept] + list(columns.values()), names=[batch.schema.names[i] for i in kept] + list(columns)
    )


def replaced_schema(df: DataFrame, drop: str, columns: dict[str, str]) -> str:
    """The schema of what replaced() gives, as DDL."""
    kept = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name != drop}
    return ", ".join(f"`{n.replace('`', '``')}` {kind}" for n, kind in [*kept.items(), *columns.items()])
