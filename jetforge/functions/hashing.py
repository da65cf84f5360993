"""Portable hash used wherever a reproducible random order is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def hash60(*parts: Column | str, seed: int | str = 42) -> Column:
    """First 60 bits of md5 over ``seed:part:part...`` as a bigint, equal in any SQL engine."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
