"""Running sums, neighbours and ranks over ordered groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.workspace import stored


def running(rows: DataFrame, per: Sequence[str], order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """``rows`` with ``<name>`` and ``<name>_total`` for each ``{name: column}``: the column's sum
    over the rows of the group up to this one (ties in ``order`` in any order), and over all.

    The order is cut into ranges, so a group may span many tasks; what meets by group is one
    row per range. Hand in narrow rows: they are written once, for the ranges to be fixed.
    """
    ranged = stored(rows.repartitionByRange(*per, *order).withColumn("__range", F.spark_partition_id()))
    parts = ranged.groupBy(*per, "__range").agg(*[F.sum(c).alias(f"{n}_part") for n, c in sums.items()])
    group = Window.partitionBy(*per)
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*per, "__range", *[F.coalesce(F.sum(f"{n}_part").over(before), F.lit(0)).alias(f"{n}_before") for n in sums], *[F.sum(f"{n}_part").over(group).alias(f"{n}_total") for n in sums])
    inside = Window.partitionBy("__range", *per).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.withColumns({f"{n}_in": F.sum(c).over(inside) for n, c in sums.items()}).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in per]
    joined = counted.join(offsets.alias("o"), [F.col("r.__range") == F.col("o.__range"), *same])
    return joined.select(*[f"r.{c}" for c in rows.columns], *[(F.col(f"{n}_before") + F.col(f"{n}_in")).alias(n) for n in sums], *[f"{n}_total" for n in sums])


def with_next(rows: DataFrame, per: Sequence[str], order: str, columns: Sequence[str], into: str = "next") -> DataFrame:
    """``rows`` with a struct of the columns of the group's next row; null for its last.

    The order is cut into ranges, so a group may span many tasks; a range's last row gets its
    neighbour from a table of one row per group and range.
    """
    ranged = stored(rows.repartitionByRange(*per, order).withColumn("__range", F.spark_partition_id()))
    firsts = ranged.groupBy(*per, "__range").agg(F.min_by(F.struct(*columns), F.struct(order)).alias("__first"))
    after = Window.partitionBy(*per).orderBy("__range")
    nexts = firsts.select(*per, "__range", F.lead("__first").over(after).alias("__after")).alias("o")
    inside = ranged.withColumn("__in", F.lead(F.struct(*columns)).over(Window.partitionBy("__range", *per).orderBy(order))).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in per]
    joined = inside.join(nexts, [F.col("r.__range") == F.col("o.__range"), *same])
    return joined.select(*[f"r.{c}" for c in rows.columns], F.coalesce("__in", "__after").alias(into))


def percentile(rows: DataFrame, per: Sequence[str], value: str, share: float, into: str) -> DataFrame:
    """A row per group with the exact percentile of a column by linear interpolation; null where all values are.

    Ranks are running counts over ranges; of a group only the two values around the percentile meet.
    """
    values = rows.filter(F.col(value).isNotNull()).select(*per, value, F.lit(1).alias("__one"))
    ranked = running(values, per, [value], {"__n": "__one"})
    at = F.lit(share) * (F.col("__n_total") - 1)
    near = ranked.filter((F.col("__n") - 1 == F.floor(at)) | (F.col("__n") - 1 == F.ceil(at)))
    low, high = F.min(value), F.max(value)
    cut = near.groupBy(*per).agg((low + (high - low) * F.first(at - F.floor(at))).alias(into)).alias("c")
    groups = rows.select(*per).distinct().alias("g")
    return groups.join(cut, [F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}")) for c in per], "left").select(*[f"g.{c}" for c in per], into)
