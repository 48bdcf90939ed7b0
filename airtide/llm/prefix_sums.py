"""Running totals over a table of runs, without one task for all of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from airtide.plans.staging import stage

SPAN = 32


def with_offsets(runs: DataFrame, group: list[str], part: str, order: list[str], count: str) -> DataFrame:
    """Add ``offset``: the sum of ``count`` over the group's earlier rows by (part, order).

    ``part`` is a non-negative integer. Sums are taken over spans of SPAN parts first, so
    that a window sees the rows of one span, or one row per span.
    """
    runs = runs.withColumn("_span", F.expr(f"{part} DIV {SPAN}"))
    spans = runs.groupBy(*group, "_span").agg(F.sum(count).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        *group, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    within = (
        Window.partitionBy(*group, "_span")
        .orderBy(part, *order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.withColumn("_before", F.coalesce(F.sum(count).over(within), F.lit(0)))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in [*group, "_span"]]
    joined = runs.alias("a").join(spans.alias("b"), same)
    kept = [F.col(f"a.{c}") for c in runs.columns if c not in ("_span", "_before")]
    return joined.select(*kept, (F.col("_before") + F.col("_base")).alias("offset"))


def running_totals(table: DataFrame, order: list[str], count: str | None, name: str) -> DataFrame:
    """Add ``offset``: the sum of ``count`` over all earlier rows of the table by ``order``.

    The rows are range-partitioned and written, so that their order is settled; a window
    sees the rows of one range, and the ranges' totals are few. Without ``count`` rows are
    counted: the number of a row in its range is known as it is written.
    """
    ordered = table.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(ordered.withColumn("_row", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    total = F.sum(count) if count else F.count("*")
    parts = rows.groupBy("_part").agg(total.alias("_n")).withColumn("_all", F.lit(0))
    parts = with_offsets(parts, ["_all"], "_part", [], "_n").select(
        F.col("_part").alias("_range"), F.col("offset").alias("_base")
    )
    before = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    if count:
        within = Window.partitionBy("_part").orderBy("_row")
        within = within.rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(count).over(within), F.lit(0))
    rows = rows.withColumn("_before", before).join(parts, F.col("_part") == F.col("_range"))
    kept = [F.col(c) for c in table.columns]
    return rows.select(*kept, (F.col("_base") + F.col("_before")).alias("offset"))
