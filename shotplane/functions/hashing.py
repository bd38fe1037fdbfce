"""Column functions that hash."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Low halves of the 64-bit FNV-1a offset and prime (fixed values).
FNV_OFFSET, FNV_PRIME = 0x84222325, 435


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(FNV_OFFSET).cast("long"), lambda h, b: h.bitwiseXOR(b.cast("long")) * FNV_PRIME % 4294967296)


def fnv1a_low32(s: Column) -> Column:
    """The low 32 bits of FNV-1a of a text's UTF-8 bytes: they follow from low halves alone."""
    h = F.hex(s.cast("binary"))
    n = F.octet_length(s)
    bytes_ = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10))).otherwise(F.array().cast("array<string>"))
    return _fold(bytes_)


@F.pandas_udf(T.StringType())
def crop_id(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """A crop's id: low FNV-1a of its four single-precision numbers' bytes, as eight hex digits."""

    def one(*v: float) -> str:
        k = FNV_OFFSET
        for b in struct.pack("<4f", *v):
            k = (k ^ b) * FNV_PRIME % 4294967296
        return f"{k:08x}"

    return pd.Series([one(*v) for v in zip(x, y, w, h)])
