"""Row-level helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def settle(df: DataFrame, keep: Sequence[str | Column], **columns: Column) -> DataFrame:
    """Keep some columns and add computed ones, each worked out once per row.

    The new columns leave through a one-element generator.  A later filter on
    them stays above it, where a projection would let the optimizer copy the
    whole expression into the filter (and into what it in turn refers to);
    filters on the kept columns still reach the scan.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(made)))
