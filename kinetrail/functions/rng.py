"""Reproducible randomness: values depend on a key and a seed, never on row order."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(key: str | Column, seed: int | str = 0) -> Column:
    """Hex digest of key and seed; ordering by it is a seeded shuffle."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(column.cast("string"), F.lit(f":{seed}")).cast("binary"))


def hash_uniform(key: str | Column, seed: int | str = 0) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
