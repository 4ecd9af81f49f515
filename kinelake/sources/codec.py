"""Arrays on the wire: MessagePack-like structs of bytes, element type and shape."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WIRE = "struct<data:binary,dtype:string,shape:array<int>>"


def pack_array(a: np.ndarray) -> dict:
    """Kinds without a plain byte form (objects, structures, complex numbers) are refused."""
    a = np.asarray(a)
    if a.dtype.kind in "VOc":
        raise ValueError(f"unsupported element type {a.dtype}")
    return {"data": a.tobytes(), "dtype": a.dtype.str, "shape": list(a.shape)}


def unpack_array(data: bytes, dtype: str, shape) -> np.ndarray:
    return np.frombuffer(data, np.dtype(dtype)).reshape([int(n) for n in shape])


def decoded(wire: Column) -> Column:
    """Numeric arrays from the wire, flat, as doubles; a null stays null. Those of one type and size are read as one array."""

    @F.pandas_udf("array<double>")
    def run(w: pd.DataFrame) -> pd.Series:
        out = np.full(len(w), None, object)
        there = np.flatnonzero(w["data"].notna())
        size = w["data"].str.len().to_numpy()
        kinds = w["dtype"].to_numpy()
        for kind, n in dict.fromkeys(zip(kinds[there].tolist(), size[there].tolist())):
            at = there[(kinds[there] == kind) & (size[there] == n)]
            values = np.frombuffer(b"".join(w["data"].to_numpy()[at]), np.dtype(kind)).astype(float).reshape(len(at), -1)
            for k, i in enumerate(at.tolist()):
                if int(np.prod(w["shape"].iloc[i])) != values.shape[1]:
                    raise ValueError("an array whose bytes don't fill its shape")
                out[i] = values[k]
        return pd.Series(out)

    return run(wire)


def encoded(values: Column, dtype: str = "<f4") -> Column:
    """Array columns for the wire; a null stays null. Rows of one length are converted as one array."""
    kind = np.dtype(dtype)
    if kind.kind in "VOc":
        raise ValueError(f"unsupported element type {kind}")

    @F.pandas_udf(WIRE)
    def run(v: pd.Series) -> pd.DataFrame:
        data, shape = np.full(len(v), None, object), np.full(len(v), None, object)
        there = np.flatnonzero(v.notna())
        size = np.array([len(x) for x in v.to_numpy()[there]], np.int64)
        for n in np.unique(size).tolist():
            at = there[size == n]
            raw = np.stack(v.to_numpy()[at]).astype(kind).tobytes() if n else b""
            step = n * kind.itemsize
            for k, i in enumerate(at.tolist()):
                data[i], shape[i] = raw[k * step : (k + 1) * step], [n]
        return pd.DataFrame({"data": data, "dtype": np.where(v.notna(), kind.str, None), "shape": shape})

    return F.when(values.isNotNull(), run(values))
