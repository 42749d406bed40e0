import datetime
import decimal
import glob
import os
from collections import Counter

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str, datetime.date)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, duck, f, sql):
    df = f(spark, DATA)
    got = bag(df.columns, df.collect())
    c = duck.execute(sql)
    assert got == bag([d[0] for d in c.description], c.fetchall())


def stored(spark, tmp_path, name, rows, schema):
    """Rows as a Parquet table, whose size Spark knows."""
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def broadcast_sides(df):
    """The sides of joins that the plan broadcasts."""
    joins = [n for n in nodes(df._jdf.queryExecution().sparkPlan()) if n.nodeName().startswith("BroadcastHashJoin")]
    return [j.left() if j.buildSide().toString() == "BuildLeft" else j.right() for j in joins]


def broadcasts_exploded(df):
    """Whether the plan broadcasts a side that explodes rows, which Spark sizes as if it did not."""
    return any(n.nodeName() == "Generate" for side in broadcast_sides(df) for n in nodes(side))
