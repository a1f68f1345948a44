"""Embedding columns as packed bytes: one binary value a vector, ready for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import ship


def width(df: DataFrame, vector: str) -> int:
    """The commonest length of the vectors (the larger on a tie); vectors of other lengths take no part."""
    row = df.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return int(row["d"]) if row else 0


def packed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), zeros: bool = False) -> tuple[DataFrame, str, int]:
    """((vec_id, packed, *keep), numpy type, length): packed is null for a vector that is null, zero (unless zeros take part), of another
    length, or holds a null or a non-finite component."""
    ship(df.sparkSession)
    d = width(df, vector)
    kind = "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column("vector"), batch.num_rows
            size = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
            rows = np.flatnonzero(size == d) if d else np.zeros(0, int)
            out: list[bytes | None] = [None] * n
            if len(rows):
                flat = column.take(pa.array(rows)).flatten().cast(pa.float32() if kind == "<f4" else pa.float64())
                x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), d).astype(kind)
                x = x + np.array(0, kind)  # a negative zero equals zero
                wide = x.astype(np.float64)
                norm = np.sqrt((wide * wide).sum(axis=1))
                for k in np.flatnonzero(np.isfinite(x).all(axis=1) & (zeros | (norm > 0) & np.isfinite(norm))).tolist():
                    out[rows[k]] = x[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary()), *(batch.column(k) for k in keep)], names=["vec_id", "packed", *keep])

    slim = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), *keep)
    kept = "".join(f", {k} {slim.schema[k].dataType.simpleString()}" for k in keep)
    return slim.mapInArrow(run, "vec_id long, packed binary" + kept), kind, d


def unpack(values, kind: str, d: int) -> np.ndarray:
    """A float64 matrix of packed vectors."""
    return np.frombuffer(b"".join(map(bytes, values)), kind).reshape(-1, d).astype(np.float64)


def norms(x: np.ndarray) -> np.ndarray:
    """Row by row in the same order of additions, so that equal rows give equal norms."""
    return np.sqrt((x * x).sum(axis=1))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of row pairs, in double precision; equal pairs give equal results wherever they stand."""
    return (x * y).sum(axis=1) / (norms(x) * norms(y))
