"""Feature vectors: statistics, normalising, clusters, neighbours and ranking curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..runtime import cores, cut, small_enough


def dimension_stats(df: DataFrame, vector: str) -> DataFrame:
    """``(dim, n, mean, sd, low, high)`` of each place of a vector, population deviation."""
    d = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return d.groupBy("dim").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"))


def normalize_vectors(df: DataFrame, key: str, vector: str, outlier: float = 2.0, standardize: bool = False, rescale: bool = True, weights: list[float] | None = None) -> DataFrame:
    """``(key, dim, x)``: clipped at mean +- outlier deviations, then z-scored, then scaled to 0..1, then weighted.

    Clipping needs a deviation over 0.01, scaling a range over 1e-4 after clipping; weights apply
    after whichever normaliser ran.
    """
    s = dimension_stats(df, vector).select("dim", "mean", "sd", "low", "high")
    d = df.select(F.col(key).alias("key"), F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double")).join(s, "dim")
    c = F.col
    clips = (c("sd") > 0.01) & F.lit(outlier > 0.1)
    lo = F.when(clips, F.greatest(c("low"), c("mean") - outlier * c("sd"))).otherwise(c("low"))
    hi = F.when(clips, F.least(c("high"), c("mean") + outlier * c("sd"))).otherwise(c("high"))
    d = d.withColumn("lo", lo).withColumn("hi", hi).withColumn("x", F.least(F.greatest(c("x"), c("lo")), c("hi")))
    if standardize:
        z = lambda v: F.when(c("sd") > 0, (c(v) - c("mean")) / c("sd")).otherwise(c(v))
        d = d.withColumn("x", z("x")).withColumn("lo", z("lo")).withColumn("hi", z("hi"))
    if rescale:
        d = d.withColumn("x", F.when(c("hi") - c("lo") > 1e-4, (c("x") - c("lo")) / (c("hi") - c("lo"))).otherwise(c("x")))
    if weights:
        d = d.withColumn("x", c("x") * F.coalesce(F.get(F.array(*map(F.lit, weights)), c("dim")), F.lit(1.0)))
    return d.select("key", "dim", "x")


def nearest_centres(df: DataFrame, key: str, vector: str, centres: list[tuple[int, list[float]]]) -> DataFrame:
    """``(key, centre, cost, second)``: the nearest of few centres, squared distance, and that of the next.

    Centres are literals of the plan: their number is the model's, not the data's.
    """
    options = F.array_sort(F.array(*[F.struct(X.squared_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in v])).alias("cost"), F.lit(c).alias("centre")) for c, v in centres]))
    d = df.select(F.col(key).alias("key"), options.alias("o"))
    return d.select("key", F.get("o", F.lit(0))["centre"].alias("centre"), F.get("o", F.lit(0))["cost"].alias("cost"), F.get("o", F.lit(1))["cost"].alias("second"))


def revise_clusters(assigned: DataFrame, least_percent: float, least: int) -> DataFrame:
    """``(centre, size, kept)``: clusters that hold their relative and their absolute share."""
    sizes = assigned.groupBy("centre").agg(F.count("*").alias("size"))
    k, n = sizes.agg(F.count("*"), F.sum("size")).first()
    return sizes.select("centre", "size", ((k * F.col("size") * 100 / F.lit(n or 1) >= least_percent) & (F.col("size") >= least)).alias("kept"))


CLUSTERS = 2000  # a model has no more clusters, whose means go into the plan
QUERY_BLOCK, ROW_BLOCK = 4096, 65_536  # vectors of a block pair, which one task holds


def sample_cost(assigned: DataFrame, sampled: Column) -> DataFrame:
    """``(cost)``: the mean squared distance to the own centre over the rows that ``sampled`` picks."""
    return assigned.filter(sampled).agg(F.avg("cost").alias("cost"))


def rejoin_centres(df: DataFrame, key: str, vector: str, centres: list[tuple[int, list[float]]], kept: set[int], factor: float) -> list[int]:
    """Centres of the revised model: the kept ones, and dropped ones that lie further from the nearest
    kept one than ``factor`` times the average cost under the kept ones. All or none kept changes nothing."""
    stay = [c for c in centres if c[0] in kept]
    if not stay or len(stay) == len(centres):
        return sorted(c for c, _ in centres)
    mean = nearest_centres(df, key, vector, stay).agg(F.avg("cost")).first()[0] or 0.0
    far = lambda v: min(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) for _, w in stay)
    return sorted([c for c, _ in stay] + [c for c, v in centres if c not in kept and far(v) > mean * factor])


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(key, label, a, b, s)``: exact silhouette with squared distances.

    The mean squared distance to a cluster follows from its size, its sum and the sum of its squared
    norms, so no pair of rows is formed; the own row is left out of the own cluster. A row alone in
    its cluster has 0, rows with a null vector or label are left out.
    """
    d = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null and label is not null")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sums = d.select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.sum("x").alias("m"))
    sums = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda z: z["m"]).alias("m"))  # dimensions of one cluster
    sizes = d.groupBy("label").agg(F.count("*").alias("n"), F.sum(norm).alias("q"))
    stats = cut(sums.join(sizes, "label"))
    clusters = [(r.label, list(r.m), r.n, r.q) for r in stats.collect()] if small_enough(stats, CLUSTERS) else None
    if clusters is None:
        raise ValueError(f"more than {CLUSTERS} clusters")
    dot = lambda m: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in m]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    total = lambda m, n, q: F.lit(float(n)) * F.col("norm") - 2 * dot(m) + F.lit(float(q))
    d = d.withColumn("norm", norm)
    costs = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(n).alias("n"), total(m, n, q).alias("t")) for c, m, n, q in clusters]) if clusters else F.array()
    d = d.select("key", "label", costs.alias("c"))
    own = F.filter("c", lambda x: x["label"] == F.col("label"))[0]
    other = F.array_min(F.transform(F.filter("c", lambda x: x["label"] != F.col("label")), lambda x: x["t"] / x["n"]))
    d = d.select("key", "label", F.when(own["n"] > 1, own["t"] / (own["n"] - 1)).alias("a"), other.alias("b"))
    top = F.greatest("a", "b")
    return d.withColumn("s", F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top))


def knn(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """``(query, key, cost, place)``: the ``k`` nearest rows of each query but itself; ties by key.

    Queries form a stated set against all rows. Both sides are hashed into blocks that meet pair by
    pair; a pair keeps the best ``k`` of each query, so what meets at last is ``k`` rows per query and
    row block. Costs are exact: the matrix product only picks those that can be among the best. Null
    vectors are left out, null keys too.
    """
    import numpy as np
    import pandas as pd

    asked = queries.select(F.col(key).cast("bigint").alias("query"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null and query is not null")
    held = rows.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null and key is not null")
    blocks_q, blocks_r = max(1, -(-asked.count() // QUERY_BLOCK)), max(cores(rows.sparkSession), -(-held.count() // ROW_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.withColumn("i", block("query", blocks_q)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks_r - 1))))
    right = held.withColumn("j", block("key", blocks_r)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query": [], "key": [], "cost": []}
        if len(a) and len(b):
            b = b.sort_values("key", kind="stable")
            x, keys = np.array(b["v"].tolist(), dtype=np.float64), b["key"].to_numpy()
            norm = (x * x).sum(axis=1)
            for s in range(0, len(a), 256):
                m = np.array(a["v"].iloc[s : s + 256].tolist(), dtype=np.float64)
                near = norm[None, :] - 2 * (m @ x.T) + (m * m).sum(axis=1)[:, None]
                slack = 1e-9 * (norm.max() + (m * m).sum(axis=1).max()) + 1e-12
                for row, q, v in zip(near, a["query"].iloc[s : s + 256].tolist(), m, strict=True):
                    bar = np.partition(row, min(k, len(row) - 1))[min(k, len(row) - 1)] + slack  # one more than k, as the query may be among them
                    at = np.flatnonzero(row <= bar)
                    at = at[keys[at] != q]
                    cost = ((x[at] - v) ** 2).sum(axis=1)
                    first = np.lexsort((keys[at], cost))[:k]
                    out["query"] += [q] * len(first)
                    out["key"] += keys[at][first].tolist()
                    out["cost"] += cost[first].tolist()
        return pd.DataFrame(out).astype({"query": "int64", "key": "int64", "cost": "float64"})

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, "query bigint, key bigint, cost double")
    w = Window.partitionBy("query").orderBy("cost", "key")
    return met.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def rank_curve(df: DataFrame, order: list[Column], hit: Column, levels: int = 40, granularity: int = 5, beta: float = 0.5) -> DataFrame:
    """``(level, place, precision, recall, f)``: the first place that reaches each level of the ranking.

    A level is ``granularity`` percent of all rows; recall is against all hits, -1 where there is none.
    """
    from .ordering import running_number

    numbered = running_number(df.select("*", hit.cast("int").alias("__hit")), order, "place")
    hits = df.agg(F.sum(hit.cast("int"))).first()[0] or 0
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # cumulative hits: within blocks of places, lifted by the blocks before
    n = numbered.count()
    block = max(1, -(-n // parts))
    b = numbered.withColumn("__b", F.floor((F.col("place") - 1) / block))
    sums = b.groupBy("__b").agg(F.sum("__hit").alias("__s"))
    before = sums.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.sum("__hit").over(Window.partitionBy("__b").orderBy("place"))
    c = b.join(F.broadcast(before), "__b").withColumn("found", within + F.col("__before"))
    c = c.withColumn("level", F.expr(f"(place * 100 div {max(1, n)}) div {granularity}")).filter(F.col("level").between(1, levels))
    first = c.groupBy("level").agg(F.min("place").alias("place"), F.min_by("found", "place").alias("found"))
    p = F.col("found") / F.col("place")
    r = F.col("found") / F.lit(hits) if hits else F.lit(-1.0)
    return first.select("level", "place", p.alias("precision"), r.alias("recall"), X.f_beta(p, F.greatest(r, F.lit(0.0)), beta).alias("f"))


def simplified_silhouette(assigned: DataFrame) -> DataFrame:
    """Mean of (b - a) / max(a, b) with the distances to the own and the next centre."""
    s = F.when(F.greatest("cost", "second") == 0, 0.0).otherwise((F.col("second") - F.col("cost")) / F.greatest("cost", "second"))
    return assigned.agg(F.avg(s).alias("silhouette"))
