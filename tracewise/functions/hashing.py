"""Token hashing for the hashed bag-of-words embedding.

The bucket of a token is the first 32 bits of its MD5, as an unsigned
integer, modulo the embedding width.  Any engine with MD5 computes the same
bucket (the DuckDB oracle does), unlike Spark's seeded murmur hash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_bucket(token, dim: int) -> Column:
    t = F.col(token) if isinstance(token, str) else token
    return (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % F.lit(dim)).cast("int")
