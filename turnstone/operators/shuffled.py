"""Joins of tables that both grow."""

from __future__ import annotations

from pyspark.sql import DataFrame


def grown_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Join by shuffle and sort, at any size.

    Spark sizes exploded rows by the file they come from, so at some sizes it would gather millions of lines or
    tokens on the driver to broadcast them.
    """
    return left.join(right.hint("merge"), on, how)
