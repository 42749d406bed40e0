"""Queries of the general training-data operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.instants import kept_dictionaries, normalise_instants
from ..operators.packed import explode_packed
from ..runtime import table


def _zoned(rows: DataFrame, zones: DataFrame, name: str, scope: str) -> DataFrame:
    z = zones.filter(F.col("tbl") == name).groupBy("scope").agg(F.min("zone").alias("__zone"))
    return rows.join(z, rows[scope] == z["scope"], "left").drop(z["scope"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """UTC second of every post and chosen answer that states exactly one instant."""
    zones = table(spark, d, "source_zones")
    deaf = _zoned(table(spark, d, "dataset_deaf"), zones, "dataset_deaf", "type")
    yahoo = _zoned(table(spark, d, "tmp_org_yahoo"), zones, "tmp_org_yahoo", "category")
    kept = kept_dictionaries(spark)
    posts = normalise_instants(deaf, "postid", "date", "__zone", "time", "ampm", "month", "year", dictionary=f"{kept}/dataset_deaf")
    answers = normalise_instants(yahoo, "id", "chosenanswertimestamp", "__zone", order="written", dictionary=f"{kept}/tmp_org_yahoo")
    both = posts.select(F.lit("dataset_deaf").alias("tbl"), F.col("row_id").cast("bigint"), "epoch_s").unionByName(answers.select(F.lit("tmp_org_yahoo").alias("tbl"), F.col("row_id").cast("bigint"), "epoch_s"))
    return both.filter("row_id is not null").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per tag of a post, from both tables that pack tags into one field."""
    own = table(spark, d, "tmp_org").select(F.lit("tmp_org").alias("tbl"), F.col("blogid").cast("string").alias("row_key"), F.col("post_hashtag").alias("packed"))
    other = table(spark, d, "content_tag").select(F.lit("content_tag").alias("tbl"), F.col("blogid").cast("string").alias("row_key"), F.col("tags").alias("packed"))
    return explode_packed(own.unionByName(other), ["tbl", "row_key"], "packed").distinct()


def queries() -> dict:
    return {"p1_found": p1_found, "p4_found": p4_found}
