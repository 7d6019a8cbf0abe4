"""Seeded draws: the same (seed, key, position) always gives the same value, so
retried tasks and repeated runs agree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_BITS = 52  # 13 hexadecimal digits, exact in a double


def draw_bits(seed: int, *parts: Column) -> Column:
    """52 uniform bits as BIGINT."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[part.cast("string") for part in parts]))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("bigint")


def uniform(seed: int, *parts: Column) -> Column:
    """A double in [0, 1)."""
    return draw_bits(seed, *parts) / F.lit(float(1 << _BITS))
