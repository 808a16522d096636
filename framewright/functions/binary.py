"""Float32 byte conversion, as Arrow-backed pandas functions (Spark has no built-in)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = T.ArrayType(T.FloatType())
_MATRIX = T.StructType([T.StructField("rows", T.IntegerType()), T.StructField("cols", T.IntegerType()),
                        T.StructField("values", _FLOATS)])


def _floats(data: bytes | None) -> np.ndarray | None:
    if data is None:
        return None
    if len(data) % 4:
        raise ValueError(f"byte length {len(data)} is not a multiple of 4")
    return np.frombuffer(data, dtype="<f4")


@F.pandas_udf(_FLOATS)
def bytes_to_floats(col: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array; other lengths are an error."""
    return col.map(_floats)


@F.pandas_udf(T.BinaryType())
def floats_to_bytes(col: pd.Series) -> pd.Series:
    """Array to little-endian float32 bytes."""
    return col.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(_MATRIX)
def matrix_from_bytes(col: pd.Series) -> pd.DataFrame:
    """Matrix dump: int32 rows, int32 columns, then float32 values."""
    out = []
    for data in col:
        rows, cols = np.frombuffer(data, dtype="<i4", count=2)
        values = _floats(data[8:])
        if len(values) != rows * cols:
            raise ValueError(f"matrix of {rows}x{cols} holds {len(values)} values")
        out.append((int(rows), int(cols), values))
    return pd.DataFrame(out, columns=["rows", "cols", "values"])
