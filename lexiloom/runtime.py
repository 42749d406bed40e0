"""Session helpers: reading the test tables, the shared folder, cutting lineage, and joins that stay even."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 300_000  # a side of at most so many short rows is broadcast, once it has been counted
SALTS = 32  # copies of a larger side, so that a hot key meets it in so many tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder; columns and filters are pruned at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local one serves a local master, whose only machine it is; a
    cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexiloom-"))
        current = sc.getCheckpointDir()
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def meet(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join of ``rows`` with a table of one row per key, even where one key holds a third of all rows.

    ``lookup`` is counted, so it should be materialised: a small one is broadcast, a larger one is
    repeated ``SALTS`` times and each row meets one of the copies. Null keys meet nothing and are
    spread too. The larger one is merged, as Spark sizes the copies, like all exploded rows, as if
    there were one of each, and would broadcast them.
    """
    on = list(on)
    if small_enough(lookup, max_rows):
        return rows.join(F.broadcast(lookup), on, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


# Names of logical nodes that neither move rows nor gather them.
_NARROW = {"Project", "Filter", "Union", "SubqueryAlias", "Generate"}


def _only_scans(node) -> bool:
    below = node.children()
    return below.size() == 0 or (node.nodeName() in _NARROW and all(_only_scans(below.apply(i)) for i in range(below.size())))


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan in at least as many partitions as cores; fewer, as small files give, are hashed by ``key``.

    Only scans under projections, filters and unions are looked at, so nothing is run to find out.
    """
    plan = df._jdf.queryExecution()
    if not _only_scans(plan.optimizedPlan()):
        return df
    n = cores(df.sparkSession)
    return df if plan.toRdd().getNumPartitions() >= n else df.repartition(n, key)
