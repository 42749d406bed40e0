"""Running numbers and sums over a total order without gathering the rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import cut


def running_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name`` from 1 in ``order``, which must be total.

    Rows are range-partitioned in order and numbered within their part; the sizes of the parts
    before, as many as partitions, are added.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    lifted = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.join(F.broadcast(lifted), "__part").withColumn(name, within + F.col("__before")).drop("__part", "__before")


def prefix_sums(df: DataFrame, group: str, order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``df`` with ``pre_<c>``, the running sum of each of ``sums`` up to and with the row, per group.

    ``order`` must be total within a group. Rows are range-partitioned in order, summed within their
    part, and lifted by the totals of the parts before, of which there are as many as partitions; so
    a group of any size is spread over tasks.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, group, *order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy(group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(group, "__part").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lifted = totals.select(F.col(group).alias("__group"), F.col("__part").alias("__at"), *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums])
    out = placed.join(lifted, placed[group].eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__at")))
    return out.select(*df.columns, *[(F.sum(c).over(w) + F.col(f"__b_{c}")).alias(f"pre_{c}") for c in sums])


def with_previous(df: DataFrame, group: str, order: Sequence[str], columns: Sequence[str], back: int) -> DataFrame:
    """``df`` with ``<c>_1 .. <c>_<back>``, the values of the rows before in the group, and ``row``,
    a running number over all groups.

    ``group`` and ``order`` together must be total. Neighbours meet by joins on the running number,
    so a group of any size is spread over tasks; before a group's first row the values are null.
    """
    numbered = cut(running_number(df, [F.asc_nulls_first(group), *[F.asc_nulls_first(c) for c in order]], "row"))
    out = numbered
    for k in range(1, back + 1):
        p = numbered.select((F.col("row") + k).alias("row"), F.col(group).alias("__g"), F.lit(True).alias("__has"), *[F.col(c).alias(f"__{c}") for c in columns])
        out = out.join(p, "row", "left")
        same = F.col("__has") & F.col(group).eqNullSafe(F.col("__g"))
        out = out.select(*[c for c in out.columns if not c.startswith("__")], *[F.when(same, F.col(f"__{c}")).alias(f"{c}_{k}") for c in columns])
    return out


def with_next(df: DataFrame, order: Sequence[str], column: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``, the value of ``column`` in the next row of ``order``, null where the columns
    ``within`` change and in the last row.

    Rows are range-partitioned and sorted; the first row of each part, of which there are as many as
    partitions, is what follows the last row of the part before. So a group of any size is spread
    over tasks. ``order`` must be total and begin with ``within``.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    firsts = placed.groupBy("__part").agg(F.min(F.struct(*order, F.col(column).alias("__v"))).alias("__first"))
    ahead = firsts.select((F.lead("__part").over(Window.orderBy("__part"))).alias("__next"), "__part")  # one row per partition
    nxt = ahead.join(firsts.select(F.col("__part").alias("__next"), "__first"), "__next").select("__part", "__first")
    w = Window.partitionBy("__part").orderBy(*order)
    row = F.struct(*[F.col(c).alias(c) for c in order], F.col(column).alias("__v"))
    out = placed.withColumn("__lead", F.lead(row).over(w)).join(F.broadcast(nxt), "__part", "left").withColumn("__lead", F.coalesce("__lead", "__first"))
    same = F.lit(True)
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__lead.{c}"))
    return out.select(*df.columns, F.when(same, F.col("__lead.__v")).alias(name))
