"""Pixel types: what is written for each input type, and saturating casts.

Spark has no unsigned integers, so values stay doubles or wider integers and
the logical type travels beside them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Written type of each input type, and bounds of the integer types.
WRITTEN = {"bool": "uint8", "int64": "int32", "uint64": "uint32", "float16": "float32"}
KEPT = ("uint8", "uint16", "uint32", "int8", "int16", "int32", "float32", "float64")
ITEM_SIZES = {"bool": 1, "uint8": 1, "int8": 1, "uint16": 2, "int16": 2, "float16": 2, "uint32": 4, "int32": 4, "float32": 4, "uint64": 8, "int64": 8, "float64": 8}
SPARK_TYPES = {"uint8": "smallint", "int8": "tinyint", "uint16": "int", "int16": "smallint", "uint32": "bigint", "int32": "int", "float32": "float", "float64": "double"}


def written_type(dtype: str) -> str:
    """The type in which pixels of ``dtype`` are written; TypeError for others."""
    if dtype in KEPT:
        return dtype
    if dtype in WRITTEN:
        return WRITTEN[dtype]
    raise TypeError(f"pixels of type {dtype} cannot be written")


def bounds(dtype: str) -> tuple[int, int] | None:
    """Least and greatest value of an integer type; None for floats."""
    if dtype.startswith("float"):
        return None
    bits = 8 * ITEM_SIZES[dtype]
    return (0, (1 << bits) - 1) if dtype.startswith("u") else (-(1 << (bits - 1)), (1 << (bits - 1)) - 1)


def saturate(value: Column, dtype: str) -> Column:
    """Doubles as a pixel type: NaN is 0, rounded half to even, cut at the type's bounds."""
    dtype = written_type(dtype)
    limit = bounds(dtype)
    if limit is None:
        return value.cast(SPARK_TYPES[dtype])
    known = F.when(F.isnan(value), 0.0).otherwise(value)
    return F.least(F.greatest(F.rint(known), F.lit(float(limit[0]))), F.lit(float(limit[1]))).cast(SPARK_TYPES[dtype])


def output_type(dtype: str, deconvolved: bool) -> str:
    """Deskewed pixels take the input's type again, but deconvolved ones stay float32."""
    return "float32" if deconvolved else written_type(dtype)
