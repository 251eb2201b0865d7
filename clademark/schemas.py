"""Schema checks for tables of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ensure_schema(df: DataFrame, schema: T.StructType, required: tuple[str, ...] = (), defaults: dict | None = None) -> DataFrame:
    """Add missing columns with their default (null if none), fail on missing required ones, drop nothing (T-4)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    new = {f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(new)
