"""Reproducible row-local randomness from md5 of a business key.

Draws depend on the key and the seed only, so they are the same under any
partitioning and after any task retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_RANGE = 4294967297.0  # 2**32 + 1, keeps draws strictly inside (0, 1)


def key_text(parts: Sequence[Column]) -> Column:
    """Join key parts with ``|``; NULL parts become a visible marker."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])


def milli(column: Column) -> Column:
    """A measure as whole thousandths, so that its text is engine-independent."""
    return F.round(column * 1000).cast("bigint")


def digest(key: Column, *tags: object) -> Column:
    return F.md5(F.concat_ws("|", key, *[t if isinstance(t, Column) else F.lit(str(t)) for t in tags]))


def uniform(key: Column, *tags: object) -> Column:
    """Uniform draw in (0, 1) for a key; ``tags`` separate independent draws."""
    word = F.conv(F.substring(digest(key, *tags), 1, 8), 16, 10).cast("bigint")
    return (word + F.lit(1)) / F.lit(_RANGE)


def normal(key: Column, mean: Column, spread: float, *tags: object) -> Column:
    """Normal draw by the Box-Muller transform of two uniform draws."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(key, *tags, "n1")))
    angle = F.lit(2.0) * F.pi() * uniform(key, *tags, "n2")
    return mean + F.lit(float(spread)) * radius * F.cos(angle)
