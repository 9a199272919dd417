"""Row numbers, running totals and quantile positions without a one-task sort.

Every function splits its groups into buckets of bounded size, adds up the buckets (few rows), and
finishes inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoy.session import staged

#: Distinct values a slice holds about; beyond MOST_SLICES of them slices grow, and a slice is sorted with spilling.
SLICE_ROWS = 65536
FAN = 32
MOST_SLICES = FAN * FAN


def numbered(
    df: DataFrame, keys: list[str], order: str, name: str = "rn", bucket: int = 65536
) -> DataFrame:
    """1-based position of each row within its keys by a unique integer column.

    A bucket spans ``bucket`` order values, hence at most that many rows.
    """
    slot = F.floor(F.col(order) / F.lit(bucket))
    rows = df.withColumn("_slot", slot)
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        rows.groupBy(*keys, "_slot")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy(order)
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_slot"])
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_slot", "_before", "_rn")
    )


def _edges(values: DataFrame, column: str, slices: int) -> Column:
    """Cut points that share out the distinct values evenly, in rows of FAN (a scalar subquery)."""
    shares = F.expr(f"array({', '.join(f'{i / slices!r}D' for i in range(1, slices))})")
    cuts = F.percentile_approx(column, shares, 10 * MOST_SLICES)
    rows = F.transform(F.sequence(F.lit(0), F.lit((slices - 2) // FAN)), lambda i: F.slice(cuts, i * FAN + 1, FAN))
    return values.agg(rows.alias("edges")).scalar()


def _slice_of(values: DataFrame, column: str, slices: int) -> Column:
    """Number of cut points at or below the value, found by row first and then within the row."""
    if slices < 2:
        return F.lit(0)
    edges = F.col("_edges")
    row = F.size(F.filter(edges, lambda e: F.element_at(e, 1) <= F.col(column)))
    within = F.size(F.filter(F.element_at(edges, F.greatest(row, F.lit(1))), lambda e: e <= F.col(column)))
    return F.greatest(row - 1, F.lit(0)) * FAN + within


def running_by_value(
    values: DataFrame, column: str, measures: list[str], slices: int | None = None
) -> DataFrame:
    """For rows unique in ``column``: each measure's total over all smaller values, as ``<m>_before``.

    The rows are staged, as they are read several times. The cut points come from the data, so a slice holds about
    1/slices of the distinct values wherever these lie; any cut points give the same totals. The number of
    slices follows the number of rows unless it is given.
    """
    return _running(staged(values), column, measures, slices)


def _running(values: DataFrame, column: str, measures: list[str], slices: int | None = None) -> DataFrame:
    slices = min(slices or -(-values.count() // SLICE_ROWS), MOST_SLICES)
    rows = values if slices < 2 else values.withColumn("_edges", _edges(values, column, slices))
    rows = rows.withColumn("_slice", _slice_of(values, column, slices)).drop("_edges")
    earlier = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = rows.groupBy("_slice").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    offsets = totals.select(
        "_slice",
        *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_{m}_off") for m in measures],
    )
    inside = (
        Window.partitionBy("_slice").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = rows.select(
        "*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_{m}_in") for m in measures]
    ).join(offsets, "_slice")
    return out.select(
        *values.columns,
        *[(F.col(f"_{m}_off") + F.col(f"_{m}_in")).alias(f"{m}_before") for m in measures],
    )


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(q, value) with linear interpolation between the two neighbouring ranks.

    Works on one row per distinct value; only the rows at the wanted ranks reach the last step.
    """
    counts = staged(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).scalar()
    ranked = _running(counts, column, ["n"]).withColumn("_total", total)
    wanted = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("i"),
                    F.lit(float(q)).alias("q"),
                    (F.lit(float(q)) * (F.col("_total") - 1)).alias("at"),
                )
                for i, q in enumerate(shares)
            ]
        )
    )
    last = F.col("n_before") + F.col("n") - 1
    low, high = F.floor("w.at"), F.ceil("w.at")
    return (
        ranked.select(column, "n", "n_before", wanted.alias("w"))
        .filter(
            ((low >= F.col("n_before")) & (low <= last))
            | ((high >= F.col("n_before")) & (high <= last))
        )
        .groupBy("w.i", "w.q", "w.at")
        .agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
        .select(
            "i",
            "q",
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("at") - F.floor("at"))).alias(
                "value"
            ),
        )
    )
