"""Dense numbers in a total order, without putting all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.settled import settle

_ROW = (1 << 33) - 1


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """df with 1, 2, ... in the given order, which must be total for the numbers to be repeatable.

    Rows are range-sorted and numbered within partitions; the partitions' sizes, one row
    each, are added up apart.
    """
    placed = settle(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit(_ROW)) + 1).drop("_part", "_before", "_place")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_first"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def occurrence_suffix(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], base: Column, name: str) -> DataFrame:
    """base, with .2, .3, ... for the second and later rows of a key in order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.concat(base, F.when(nth > 1, F.concat(F.lit("."), nth)).otherwise("")))


def carry_forward(df: DataFrame, partition: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """The last non-null value of column so far: how unnamed DD statements belong to the named one above."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))
