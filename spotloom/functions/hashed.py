"""Numbers from hashes: the same for the same row and salt, wherever it is worked out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*names: str, salt: str) -> Column:
    """A number between 0 and 1 from the MD5 of the columns."""
    hexed = F.substring(F.md5(F.concat_ws("/", F.lit(salt), *names)), 1, 12)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(1 << 48)


def exponential(*names: str, salt: str, weight: Column | None = None) -> Column:
    """Keys whose n least are a sample of n without replacement, by weight."""
    e = -F.log(uniform(*names, salt=salt))
    return e if weight is None else e / weight
