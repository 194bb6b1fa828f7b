"""Repeatable draws: the same key gives the same number in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2 ** 32


def _as_column(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def digest(seed: int, *key) -> Column:
    """MD5 of ``seed:key:key...`` as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_as_column(k) for k in key]))


def draw(seed: int, *key) -> Column:
    """A whole number in ``[0, 2**32)``."""
    return F.conv(F.left(digest(seed, *key), F.lit(8)), 16, 10).cast("bigint")


def unit(seed: int, *key) -> Column:
    """A number in ``[0, 1)``."""
    return draw(seed, *key) / F.lit(float(SPAN))
