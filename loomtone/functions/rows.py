"""Turning arrays into rows.

The outer generators are used on purpose, with the empty rows filtered out afterwards: for the plain ones the optimizer
infers a filter on the array and pushes it below, which computes a derived array twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once. Inside a lambda, a repeated expression would be evaluated at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def struct_rows(df: DataFrame, keep: list[str], array: Column, never_null: str) -> DataFrame:
    """One row per struct of ``array``, its fields as columns; ``never_null`` names a field that is always set."""
    return df.select(*keep, F.inline_outer(array)).filter(F.col(never_null).isNotNull())


def value_rows(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """One row per non-null element of ``array``."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def indexed_rows(df: DataFrame, keep: list[str], array: Column, index: str, name: str) -> DataFrame:
    """One row per element of ``array`` with its 0-based index."""
    return df.select(*keep, F.posexplode_outer(array).alias(index, name)).filter(F.col(index).isNotNull())
