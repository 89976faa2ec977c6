"""Variable-length codes of non-negative integers: base-127 digits, least first, the first digit d written as -d-1.

A negative byte thus begins a number.  Parquet's own encodings are the default
choice; this one is for exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from ..checkpoints import ship

BASE = 127


def compress(values: np.ndarray) -> bytes:
    x = np.asarray(values, np.int64)
    if (x < 0).any():
        raise ValueError("numbers must not be negative")
    digits = np.ones(len(x), np.int64)
    rest = x // BASE
    while rest.any():
        digits += rest > 0
        rest //= BASE
    at = np.cumsum(digits) - digits
    out = np.zeros(int(digits.sum()), np.int8)
    out[at] = -(x % BASE) - 1
    x, k = x // BASE, 1
    while (digits > k).any():
        m = digits > k
        out[at[m] + k] = x[m] % BASE
        x, k = x // BASE, k + 1
    return out.tobytes()


def decompress(data: bytes) -> np.ndarray:
    d = np.frombuffer(data, np.int8).astype(np.int64)
    start = np.flatnonzero(d < 0)
    if not len(d):
        return np.zeros(0, np.int64)
    number = np.cumsum(d < 0) - 1
    place = np.arange(len(d)) - start[number]
    digit = np.where(d < 0, -d - 1, d)
    out = np.zeros(len(start), np.int64)
    np.add.at(out, number, digit * BASE**place)
    return out


def compressed(ids: Column) -> Column:
    ship()

    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if v is None else compress(np.array(v)) for v in a.to_pylist()], pa.binary())

    return arrow_udf(run, "binary")(ids.cast("array<long>"))


def decompressed(data: Column) -> Column:
    ship()

    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if v is None else decompress(v) for v in a.to_pylist()], pa.list_(pa.int64()))

    return arrow_udf(run, "array<long>")(data)
