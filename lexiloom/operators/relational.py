"""Relational idioms of concept-table analytics as functions over DataFrames.

Each states its tie and null rules; none relies on row order or on the engine's choice among rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import cut, meet


def keep_preferred(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per ``keys`` in ``order``, which must be total; null keys form groups of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def argmax_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows that hold the greatest ``value`` of their group; ties stay, null values never win.

    The maxima are aggregated before the join, so no group meets in one task.
    """
    top = df.groupBy(*keys).agg(F.max(value).alias("__top"))
    cond = [df[k].eqNullSafe(top[k]) for k in keys]
    return df.join(top, [*cond, df[value] == top["__top"]], "left_semi")


def undirected_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], how: str = "inner") -> DataFrame:
    """Join on an unordered pair of keys: ``(a1, a2)`` equals ``(b1, b2)`` or ``(b2, b1)``."""
    lo = lambda df, p: F.least(df[p[0]], df[p[1]])
    hi = lambda df, p: F.greatest(df[p[0]], df[p[1]])
    ok = right[b[0]].isNotNull() & right[b[1]].isNotNull() & left[a[0]].isNotNull() & left[a[1]].isNotNull()
    return left.join(right, (lo(left, a) == lo(right, b)) & (hi(left, a) == hi(right, b)) & ok, how)


def union_of_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], row_id: str) -> DataFrame:
    """``(row_id, ..right)`` where any of several key pairs is equal: one equi-join per pair, then
    distinct, instead of a nested-loop join on OR."""
    out = None
    for a, b in pairs:
        one = left.select(row_id, F.col(a).alias("__k")).join(right.withColumn("__k", F.col(b)), "__k").drop("__k")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``UPDATE .. JOIN .. SET column``: the source's value where its key matches, else the old one.

    Of several source rows with one key the least value counts.
    """
    s = source.groupBy(*keys).agg(F.min(column).alias("__new"))
    return target.join(s, list(keys), "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """``DELETE``: rows whose condition is false or unknown stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


GROUP_ROWS = 2000  # rows of a group that meet all rows of it in one task


def meet_within(df: DataFrame, group: Sequence[str], columns: dict[str, str], per_task: int = GROUP_ROWS) -> DataFrame:
    """Rows of ``df`` beside all rows of their group, whose ``columns`` get new names.

    A group of more than ``per_task`` rows is parted by a hash of the row: every row goes to each part
    of the other side, so a large group is spread over tasks. Null groups meet nothing.
    """
    group = list(group)
    sizes = df.groupBy(*group).agg(F.count("*").alias("__size")).filter(F.col("__size") > per_task)
    large = cut(sizes.withColumn("__parts", F.ceil(F.col("__size") / per_task).cast("int")).drop("__size"))
    if large.isEmpty():
        return df.join(df.select(*group, *[F.col(c).alias(n) for c, n in columns.items()]), group)
    parted = meet(df, large, group, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    left = parted.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    own = F.pmod(F.xxhash64(*df.columns), F.col("__parts")).cast("int").alias("__part")
    right = parted.select(*group, own, *[F.col(c).alias(n) for c, n in columns.items()])
    return left.join(right, [*group, "__part"]).drop("__part")


def where_given(df: DataFrame, given: dict[str, str | None]) -> DataFrame:
    """``LIKE`` on the columns a pattern is given for; None leaves the column alone. As in SQL, a null
    value is like nothing, not even ``%%``."""
    for column, pattern in given.items():
        if pattern is not None:
            df = df.filter(F.col(column).like(pattern))
    return df


def ordered_concat(value: Column, separator: str = ",", missing: str = "null") -> Column:
    """``GROUP_CONCAT(DISTINCT ..)`` in ascending order, nulls written as ``missing``."""
    return F.array_join(F.array_sort(F.collect_set(F.coalesce(value.cast("string"), F.lit(missing)))), separator)


def labelled_union(df: DataFrame, labels: dict[str, Column], label: str = "label") -> DataFrame:
    """A row per label whose predicate holds, from one scan (a UNION of filters reads the table once per branch)."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in labels.items()]))
    return df.select("*", F.explode(hits).alias(label))


def page_after(df: DataFrame, key: str, after: object, size: int) -> DataFrame:
    """Keyset page: the ``size`` rows that follow ``after`` in ``key`` order."""
    return df.filter(F.col(key) > after).orderBy(key).limit(size)


def md5_share(key: Column, seed: str = "") -> Column:
    """A number from 0 to 99 that only the key and the seed decide, the same in any engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 8), 16, 10).cast("bigint"), F.lit(100))


def hash_split(key: Column, percent: int) -> Column:
    """Reproducible test share: about ``percent`` of keys, the same at every run and size."""
    return F.pmod(F.xxhash64(key), F.lit(100)) < percent
