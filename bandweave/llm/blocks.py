"""Vectors packed into blocks of bounded size, one row a block, so that blocks can be joined in place of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Whether no component is null, NaN or infinite; null for a null vector."""
    return ~F.exists(v.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`id` and `v` (doubles) of rows whose vector takes part: an id, no null, NaN or infinite component, not empty.

    Rows with the same id count as one, with the least of their vectors.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0").where(finite(F.col("v")))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def share(id_col: str, parts: Column) -> Column:
    """Part 0..parts-1 of a row, by a hash of its id that is independent of how Spark deals rows out."""
    return F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), parts.cast("long")).cast("int")


def pack(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """One row for each value of `keys`, which bound the block's size: `{prefix}_ids` (long) and `{prefix}_v` (double), in order of id.

    Vectors in a block must have one length, so `keys` holds it.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        column = table.column("v").combine_chunks()
        raw = column.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
        ids = table.column("id").to_numpy().astype("<i8").tobytes()
        return pa.table({**{k: table.column(k)[:1] for k in keys}, f"{prefix}_ids": pa.array([ids], pa.binary()), f"{prefix}_v": pa.array([raw], pa.binary())})

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "id", "v").groupBy(*keys).applyInArrow(run, f"{schema}, {prefix}_ids binary, {prefix}_v binary")


def unpack(ids: bytes, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    where = np.frombuffer(ids, "<i8")
    return where, np.frombuffer(raw, "<f8").reshape(len(where), -1)
