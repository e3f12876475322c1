"""Text rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def title_case(text: Column) -> Column:
    """Upper case for each letter that follows no letter, lower case for the others."""
    chars = F.split(text, "")
    follows = F.transform(
        chars,
        lambda c, i: F.when(
            (i > 0) & F.get(chars, i - 1).rlike(r"\p{L}"), F.lower(c)
        ).otherwise(F.upper(c)),
    )
    return F.array_join(follows, "")
