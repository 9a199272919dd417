"""Plan shaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def settle(df: DataFrame, column: str) -> DataFrame:
    """The same rows; filters on ``column`` and on what is selected with it stay above this point of the plan.

    Catalyst pushes a filter on a computed column below the projection that computes it, copying the
    expression; for columns read out of parsed JSON that repeats the parsing per copy and makes plans that
    grow with each step. It does not do so past an expression it takes for non-deterministic, and the
    number of the partition counts as one. Columns that nobody reads are still left out, down to the scan.
    """
    return df.withColumn(column, F.when(F.spark_partition_id() >= 0, F.col(column)))


def join_back(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of a summary that was itself made from ``rows``, one row per key.

    The match is null-safe: an ordinary equality lets Catalyst infer not-null filters for one of the two
    branches, which then no longer share the shuffle of ``rows``.
    """
    side = summary.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in summary.columns if c not in keys]
    )
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    )
    return rows.join(side, same).drop(*[f"_of_{k}" for k in keys])
