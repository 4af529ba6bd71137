"""Filters, joins, grouping, sorting and top-k.

All are declarative: Catalyst pushes filters and column lists into scans, picks the
join strategy by size, combines aggregates before the shuffle, and turns a sort
with a limit into a bounded heap per task (``TakeOrderedAndProject``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds; unknown counts as not."""
    return df.filter(condition)


def join(left: DataFrame, right: DataFrame, on: Column | Sequence[str] | None, how: str = "inner") -> DataFrame:
    """Inner, left, right, full or cross join; a list of names joins as USING does."""
    if on is None:
        return left.crossJoin(right)
    return left.join(right, list(on) if not isinstance(on, Column) else on, how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns of the same name; without any it is a cross product."""
    shared = [c for c in right.columns if c in left.columns]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def anti(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the left without a partner: what LEFT JOIN ... IS NULL asks for."""
    return left.join(right, list(on), "left_anti")


def group(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Groups with aggregates; without aggregates the distinct keys."""
    return df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()


def top(df: DataFrame, key: Column, k: int, *, descending: bool = False, tie: str | None = None) -> DataFrame:
    """The first `k` rows by a key, nulls smallest; ties by another column."""
    order = [key.desc_nulls_last() if descending else key.asc_nulls_first()]
    return df.orderBy(*order, *([F.col(tie)] if tie else [])).limit(k)


def distinct_in_order(df: DataFrame, columns: Sequence[str], key: Column, *, descending: bool = False) -> DataFrame:
    """Distinct rows of some columns, ordered by a key they don't include: a row stands where its first occurrence does."""
    name = "_order_key"
    first = F.max(name) if descending else F.min(name)
    # NULL is the smallest: a group with any NULL key comes first in ascending order
    any_null = F.max(F.col(name).isNull())
    found = df.select(*columns, key.alias(name)).groupBy(*columns).agg((F.when(any_null, None).otherwise(first) if not descending else first).alias(name))
    order = F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_first()
    return found.orderBy(order, *columns).select(*columns)
