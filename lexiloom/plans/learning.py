"""Vectors, clusters, neighbours and ranking over the embeddings and term tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import relational as R
from ..operators import vectors as V
from ..runtime import cut, small_enough, table
from .registry import query

_DIM = "d as (select vec_id, unnest(embedding) as x0, generate_subscripts(embedding, 1) - 1 as dim from embeddings), dd as (select vec_id, dim, cast(x0 as double) as x from d)"


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query(f"with {_DIM} select cast(dim as bigint) as dim, count(*) as n, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as sd, round(min(x), 6) as low, round(max(x), 6) as high from dd group by dim")
def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    s = V.dimension_stats(_emb(spark, d), "embedding")
    return s.select(F.col("dim").cast("bigint").alias("dim"), "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "low", "high")])


@query(
    f"with {_DIM}, s as (select dim, avg(x) as mean, stddev_pop(x) as sd, min(x) as low, max(x) as high from dd group by dim), "
    "b as (select dim, mean, sd, case when sd > 0.01 then greatest(low, mean - 2.0 * sd) else low end as lo, case when sd > 0.01 then least(high, mean + 2.0 * sd) else high end as hi from s), "
    "c as (select vec_id, dim, least(greatest(x, lo), hi) as x, lo, hi from dd join b using (dim)) select vec_id, round(sum(case when hi - lo > 1e-4 then (x - lo) / (hi - lo) else x end), 4) as total from c group by vec_id"
)
def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = V.normalize_vectors(_emb(spark, d), "vec_id", "embedding")
    return n.groupBy(F.col("key").alias("vec_id")).agg(F.round(F.sum("x"), 4).alias("total"))


_CENTRES = "c as (select label, min(vec_id) as cid from embeddings group by label), cv as (select c.label as centre, embedding as v from c join embeddings e on e.vec_id = c.cid)"
_COST = "list_sum(list_transform(list_zip(e.embedding, v), lambda p: (cast(p[1] as double) - cast(p[2] as double)) * (cast(p[1] as double) - cast(p[2] as double))))"


def _centres(spark: SparkSession, d: str) -> list[tuple[int, list[float]]]:
    """The first vector of each label: as many rows as labels, of which there may be ``V.CLUSTERS``."""
    e = _emb(spark, d)
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    if not small_enough(first, V.CLUSTERS):
        raise ValueError(f"more than {V.CLUSTERS} labels")
    return [(r.label, list(r.embedding)) for r in e.join(first.select("vec_id"), "vec_id").select("label", "embedding").collect()]


@query(f"with {_CENTRES}, a as (select vec_id, centre, {_COST} as cost from embeddings e cross join cv), r as (select *, row_number() over (partition by vec_id order by cost, centre) as rn from a) select x.vec_id, x.centre, round(x.cost, 4) as cost, round(y.cost, 4) as second from r x join r y on x.vec_id = y.vec_id and y.rn = 2 where x.rn = 1")
def nearest_centre(spark: SparkSession, d: str) -> DataFrame:
    n = V.nearest_centres(_emb(spark, d), "vec_id", "embedding", _centres(spark, d))
    return n.select(F.col("key").alias("vec_id"), "centre", F.round("cost", 4).alias("cost"), F.round("second", 4).alias("second"))


@query(f"with {_CENTRES}, a as (select vec_id, centre, {_COST} as cost from embeddings e cross join cv), r as (select *, row_number() over (partition by vec_id order by cost, centre) as rn from a), s as (select centre, count(*) as size from r where rn = 1 group by centre) select centre, size, (select count(*) from s) * size * 100.0 / (select sum(size) from s) >= 50 and size >= 3 as kept from s")
def cluster_revision(spark: SparkSession, d: str) -> DataFrame:
    n = V.nearest_centres(_emb(spark, d), "vec_id", "embedding", _centres(spark, d))
    return V.revise_clusters(n, 50, 3)


@query(f"with {_CENTRES}, a as (select vec_id, centre, {_COST} as cost from embeddings e cross join cv), r as (select *, row_number() over (partition by vec_id order by cost, centre) as rn from a) select round(avg(case when greatest(x.cost, y.cost) = 0 then 0 else (y.cost - x.cost) / greatest(x.cost, y.cost) end), 5) as silhouette from r x join r y on x.vec_id = y.vec_id and y.rn = 2 where x.rn = 1")
def silhouette_simplified(spark: SparkSession, d: str) -> DataFrame:
    n = V.nearest_centres(_emb(spark, d), "vec_id", "embedding", _centres(spark, d))
    return V.simplified_silhouette(n).select(F.round("silhouette", 5).alias("silhouette"))


@query("with q as (select vec_id as query, embedding as v from embeddings where vec_id % 20 = 0), a as (select query, e.vec_id as key, " + _COST + " as cost from q cross join embeddings e where e.vec_id <> query), r as (select *, row_number() over (partition by query order by cost, key) as place from a) select query, key, place, round(cost, 4) as cost from r where place <= 10")
def knn_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every row whose id is divisible by 20, against all rows."""
    e = _emb(spark, d)
    return V.knn(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding").select("query", "key", F.col("place").cast("bigint").alias("place"), F.round("cost", 4).alias("cost"))


_TERMS = "t as (select distinct ngram, type, tf from k20all where ngram is not null and tf is not null), u as (select ngram, max(tf) as tf, max(case when type = 'train' then 1 else 0 end) as hit from t group by ngram)"


@query(
    f"with {_TERMS}, r as (select *, row_number() over (order by tf desc, ngram) as place, sum(hit) over (order by tf desc, ngram) as found, count(*) over () as n, sum(hit) over () as hits from u), l as (select *, (place * 100 // n) // 5 as level from r), "
    "f as (select level, min(place) as place, arg_min(found, place) as found, max(hits) as hits from l where level between 1 and 40 group by level), m as (select level, place, found / place as p, case when hits > 0 then found / hits else -1 end as r from f) "
    "select cast(level as bigint) as level, place, round(p, 6) as precision, round(r, 6) as recall, round(case when p + greatest(r, 0) = 0 then 0 else 1.25 * p * greatest(r, 0) / (0.25 * p + greatest(r, 0)) end, 6) as f from m"
)
def rank_curve(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "k20all").filter("ngram is not null and tf is not null")
    u = t.groupBy("ngram").agg(F.max("tf").alias("tf"), F.max(F.when(F.col("type") == "train", 1).otherwise(0)).alias("hit"))
    c = V.rank_curve(u, [F.desc("tf"), F.asc("ngram")], F.col("hit") == 1)
    return c.select(F.col("level").cast("bigint").alias("level"), "place", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f")])


@query("select k, count(*) as n, round(avg(tf), 6) as mean, round(stddev_pop(tf), 6) as sd, max(df) as top_df from k20all where tf is not null group by k")
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "k20all").filter("tf is not null").groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("tf"), 6).alias("mean"), F.round(F.stddev_pop("tf"), 6).alias("sd"), F.max("df").alias("top_df"))


_SHARE = "cast('0x' || substr(md5({k}), 1, 8) as bigint) % 100"


@query(f"select ngram, case when {_SHARE.format(k='ngram')} < 30 then 'test' else 'train' end as part from (select distinct ngram from k20all where ngram is not null)")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    """Reproducible split of the terms by a hash of their text."""
    t = table(spark, d, "k20all").filter("ngram is not null").select("ngram").distinct()
    return t.select("ngram", F.when(R.md5_share(F.col("ngram")) < 30, "test").otherwise("train").alias("part"))


@query(" union all ".join(f"select {r} as run, count(*) as n, count(*) filter (where {_SHARE.format(k=chr(39) + str(r) + chr(39) + ' || ngram')} < 30) as test, round(avg(tf) filter (where {_SHARE.format(k=chr(39) + str(r) + chr(39) + ' || ngram')} < 30), 5) as mean_tf from (select ngram, max(tf) as tf from k20all where ngram is not null group by ngram)" for r in range(5)))
def repeated_splits(spark: SparkSession, d: str) -> DataFrame:
    """An experiment repeated over seeds: size and mean frequency of each test part, from one pass."""
    t = table(spark, d, "k20all").filter("ngram is not null").groupBy("ngram").agg(F.max("tf").alias("tf"))
    runs = t.select("ngram", "tf", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), (R.md5_share(F.col("ngram"), str(r)) < 30).alias("test")) for r in range(5)])).alias("x")).select("tf", "x.*")
    return runs.groupBy("run").agg(F.count("*").alias("n"), F.count_if("test").alias("test"), F.round(F.avg(F.when(F.col("test"), F.col("tf"))), 5).alias("mean_tf"))


@query(
    f"with p as (select a.vec_id, a.label, b.label as other, count(*) as n, sum({_COST.replace('e.embedding', 'a.embedding').replace('list_zip(a.embedding, v)', 'list_zip(a.embedding, b.embedding)')}) as t from embeddings a join embeddings b on a.vec_id <> b.vec_id group by 1, 2, 3), "
    "s as (select vec_id, label, max(t / n) filter (where other = label) as a, min(t / n) filter (where other <> label) as b from p group by 1, 2) select vec_id, label, round(a, 4) as a, round(b, 4) as b, round(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end, 4) as s from s"
)
def silhouette_exact(spark: SparkSession, d: str) -> DataFrame:
    s = V.silhouette(_emb(spark, d), "vec_id", "embedding", "label")
    return s.select(F.col("key").alias("vec_id"), "label", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("s", 4).alias("s"))


_ASSIGNED = f"{_CENTRES}, a as (select vec_id, centre, {_COST} as cost from embeddings e cross join cv), r as (select *, row_number() over (partition by vec_id order by cost, centre) as rn from a), near as (select vec_id, centre, cost from r where rn = 1)"


@query(f"with {_ASSIGNED} select count(*) as n, round(avg(cost), 4) as cost from near where {_SHARE.format(k='cast(vec_id as varchar)')} < 20")
def sample_cost(spark: SparkSession, d: str) -> DataFrame:
    """The average cost of a model over a reproducible fifth of the rows."""
    n = V.nearest_centres(_emb(spark, d), "vec_id", "embedding", _centres(spark, d))
    picked = R.md5_share(F.col("key").cast("string")) < 20
    return n.filter(picked).agg(F.count("*").alias("n")).crossJoin(V.sample_cost(n, picked).select(F.round("cost", 4).alias("cost")))  # one row each


@query(
    f"with {_ASSIGNED}, size as (select centre, count(*) as size from near group by centre), kept as (select centre from size where (select count(*) from size) * size * 100.0 / (select sum(size) from size) >= 100 and size >= 3), "
    f"under as (select vec_id, min(cost) as cost from a where centre in (select centre from kept) group by vec_id), gap as (select x.centre, min({_COST.replace('e.embedding', 'x.v').replace(', v)', ', y.v)')}) as far from cv x cross join cv y where x.centre not in (select centre from kept) and y.centre in (select centre from kept) group by x.centre) "
    "select centre, true as kept from kept union all select centre, false from gap where far > (select avg(cost) from under) * 1.1"
)
def cluster_rejoin(spark: SparkSession, d: str) -> DataFrame:
    """Centres of the revised model: large clusters, and dropped centres that lie far from all of these."""
    centres = _centres(spark, d)
    sizes = V.revise_clusters(V.nearest_centres(_emb(spark, d), "vec_id", "embedding", centres), 100, 3)
    kept = {r.centre for r in sizes.filter("kept").collect()}  # as many as clusters
    final = V.rejoin_centres(_emb(spark, d), "vec_id", "embedding", centres, kept, 1.1)
    return spark.createDataFrame([(c, c in kept) for c in final], "centre int, kept boolean")


def _curve_sql(order: str) -> str:
    return (
        "with t as (select ngram, max(tf) as tf, max(case when regexp_matches(trim(cvalue), '^[+-]?[0-9]+([.][0-9]+)?$') then try_cast(cvalue as double) end) as cv, max(case when type = 'train' then 1 else 0 end) as hit from k20all where ngram is not null and tf is not null group by ngram), "
        f"r as (select *, row_number() over (order by {order}, ngram) as place, sum(hit) over (order by {order}, ngram) as found, count(*) over () as n, sum(hit) over () as hits from t), l as (select *, (place * 100 // n) // 5 as level from r), "
        "f as (select level, min(place) as place, arg_min(found, place) as found, max(hits) as hits, max(n) as n from l where level between 1 and 40 group by level) select cast(level as bigint) as level, place, round(found / place, 6) as precision, round(cast(hits as double) / n, 6) as random, round((found / place) / (cast(hits as double) / n), 6) as over_random from f"
    )


def _curve(spark: SparkSession, d: str, order: list) -> DataFrame:
    t = table(spark, d, "k20all").filter("ngram is not null and tf is not null")
    value = F.when(F.trim("cvalue").rlike(r"^[+-]?[0-9]+([.][0-9]+)?$"), F.col("cvalue").try_cast("double"))
    u = t.groupBy("ngram").agg(F.max("tf").alias("tf"), F.max(value).alias("cv"), F.max(F.when(F.col("type") == "train", 1).otherwise(0)).alias("hit"))
    share = u.agg(F.avg("hit")).first()[0] or 0.0
    c = V.rank_curve(u, [*order, F.asc("ngram")], F.col("hit") == 1)
    over = F.col("precision") / share if share else F.lit(None).cast("double")
    return c.select(F.col("level").cast("bigint").alias("level"), "place", F.round("precision", 6).alias("precision"), F.lit(round(share, 6)).alias("random"), F.round(over, 6).alias("over_random"))


@query(_curve_sql("1.0 / tf"))
def rank_curve_by_tf(spark: SparkSession, d: str) -> DataFrame:
    """Precision by rank of the inverse frequency, against a random ranking."""
    return _curve(spark, d, [F.asc(F.lit(1.0) / F.col("tf"))])


@query(_curve_sql("1.0 / (1 + abs(coalesce(cv, 0)))"))
def rank_curve_by_cvalue(spark: SparkSession, d: str) -> DataFrame:
    """Precision by rank of the inverse C-value, against a random ranking."""
    return _curve(spark, d, [F.asc(F.lit(1.0) / (1 + F.abs(F.coalesce("cv", F.lit(0.0)))))])


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return _emb(spark, d).select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query()
def kmeans_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Least training cost of several runs, and size of the smallest cluster, over a range of k; seeds are fixed."""
    from pyspark.ml.clustering import KMeans

    v = cut(_vectors(spark, d))
    rows = []
    for k in range(4, 13, 4):
        runs = [KMeans(k=k, seed=seed, maxIter=20).fit(v).summary for seed in (7, 11, 13)]
        best = min(runs, key=lambda x: x.trainingCost)
        rows.append((k, len(runs), float(best.trainingCost), int(min(best.clusterSizes))))
    return spark.createDataFrame(rows, "k int, runs int, cost double, smallest int")


@query()
def pca_project(spark: SparkSession, d: str, share: float = 0.5) -> DataFrame:
    """Vectors on as many principal components as hold ``share`` of the variance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    v = cut(_vectors(spark, d))
    held = PCA(k=len(v.first().features), inputCol="features", outputCol="p").fit(v).explainedVariance.toArray().cumsum()
    k = int((held < share).sum()) + 1
    return PCA(k=k, inputCol="features", outputCol="p").fit(v).transform(v).select("vec_id", vector_to_array("p").alias("p"))


@query()
def tree_classify(spark: SparkSession, d: str) -> DataFrame:
    """A classification tree on the vectors, its depth chosen by cross-validation, judged on held-out rows."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    v = cut(_vectors(spark, d).withColumn("test", R.hash_split(F.col("vec_id"), 30)))
    tree = DecisionTreeClassifier(seed=7)
    grid = ParamGridBuilder().addGrid(tree.maxDepth, [3, 8]).build()
    m = CrossValidator(estimator=tree, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(), numFolds=3, seed=7).fit(v.filter("not test"))
    return m.transform(v.filter("test")).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("right"))
