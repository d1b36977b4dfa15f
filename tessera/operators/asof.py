"""As-of join: each row with the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str]) -> DataFrame:
    """left with the columns take of the last row of right with the same by and the greatest at that is not later.

    One shuffle by the keys for both tables together, then one ordered pass: no row is compared with all others. Of rows
    of right at one time the one with the greatest values counts; without any earlier row the columns are null.
    """
    values = F.struct(*[F.col(c).alias(c) for c in take])
    one = right.groupBy(*by, at).agg(F.max(values).alias("__v")).select(*by, at, "__v", F.lit(None).alias("__l"), F.lit(0).alias("__side"))
    others = [c for c in left.columns if c not in (*by, at)]
    rest = F.struct(*[F.col(c) for c in others]) if others else F.struct(F.lit(0).alias("none"))
    mine = left.select(*by, at, F.lit(None).alias("__v"), rest.alias("__l"), F.lit(1).alias("__side"))
    order = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = one.unionByName(mine).withColumn("__v", F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    kept = [F.col(c) if c in (*by, at) else F.col("__l").getField(c).alias(c) for c in left.columns]
    return found.select(*kept, *[F.col("__v").getField(c).alias(c) for c in take])
