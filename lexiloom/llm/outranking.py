"""One ranking from scores on unlike scales: outranking net flow on percentiles.

Each score becomes a percentile (twice the mid-rank, an integer), so neither its range nor its
outliers matter. An item is preferred to another on a score by nothing up to an indifference
margin, fully beyond a preference margin, and linearly between; its flow is what it is preferred
to less what is preferred to it. All pairs are summed exactly from prefix counts and sums of the
sorted percentiles, so no pair is formed; flows meet their items by value, hot values being spread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import prefix_sums
from ..runtime import cut, meet, small_enough

INDIFFERENT = 0.02  # of the percentile range
PREFERRED = 0.25


@dataclass(frozen=True)
class Score:
    """A score column, its valid range and its weight; values outside are fillers and count as missing."""

    column: str
    low: float | None = None
    high: float | None = None
    weight: float = 1.0


def readable(value: Column, low: float | None, high: float | None) -> Column:
    """A finite number from a number or text (thousands commas allowed) inside its range, else null."""
    text = F.regexp_replace(F.trim(value.cast("string")), r"(?<=\d),(?=\d{3})", "")
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    ok = F.lit(True)
    if low is not None:
        ok = ok & (number >= low)
    if high is not None:
        ok = ok & (number <= high)
    return F.when(ok & (F.abs(number) < 1e300), number + F.lit(0.0))


def outranking_flows(items: DataFrame, key: str, scores: list[Score], indifferent: float = INDIFFERENT, preferred: float = PREFERRED) -> DataFrame:
    """``(key, flow_<score>.., net_flow)`` for each distinct non-null key.

    Flows lie between -1 and 1. An item without a score is compared with nobody on it and gets
    flow 0 there; of rows with one key the greatest readable value of each score counts. The net
    flow is the weighted mean of the flows. Ties get equal flows; an empty table gives no rows.
    """
    vals = items.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(*[F.max(readable(F.col(s.column), s.low, s.high)).alias(f"v{i}") for i, s in enumerate(scores)])
    vals = cut(vals)
    long = vals.select(F.explode(F.array(*[F.struct(F.lit(i).alias("score"), F.col(f"v{i}").alias("v")) for i in range(len(scores))])).alias("x")).select("x.*").filter("v is not null")
    distinct = cut(long.groupBy("score", "v").agg(F.count("*").alias("cnt")))
    ranked = prefix_sums(distinct, "score", ["v"], ["cnt"])
    sizes = {r.score: r.n for r in distinct.groupBy("score").agg(F.sum("cnt").alias("n")).collect()}  # one row per score
    n = F.coalesce(*[F.when(F.col("score") == i, F.lit(k)) for i, k in sizes.items()], F.lit(0).cast("bigint")).cast("bigint")
    # twice the mid-rank: below * 2 + own count
    ranked = ranked.select("score", "v", "cnt", n.alias("n"), F.col("pre_cnt").alias("upto"), (2 * F.col("pre_cnt") - F.col("cnt")).alias("p"))
    q = F.floor(F.col("n") * 2 * indifferent).cast("bigint")
    ranked = cut(ranked.withColumn("q", q).withColumn("t", F.greatest(F.floor(F.col("n") * 2 * preferred).cast("bigint"), q + 1)))
    ties = cut(ranked.filter("cnt > 1").select("score", (F.col("upto") - F.col("cnt")).alias("below"), "cnt"))
    counted = _counts_by_ties(ranked, ties) if small_enough(ties) else _counts_by_order(ranked)
    c = F.col
    mass = lambda k: c(k) * c(k)
    # of the items up to a mark there are as many as the count k says, and their percentiles sum to k squared:
    # the i-th alone has 2i - 1, and items that tie share the mean of theirs
    step = c("t") - c("q")
    whole = step * (c("lo_t") - (c("n") - c("hi_t")))
    part = ((c("lo_q") - c("lo_t")) * (c("p") - c("q")) - (mass("lo_q") - mass("lo_t"))) - ((mass("hi_t") - mass("hi_q")) - (c("hi_t") - c("hi_q")) * (c("p") + c("q")))
    flow = F.when(c("n") > 1, (whole + part).cast("double") / (step * (c("n") - 1)).cast("double")).otherwise(F.lit(0.0))
    flows = cut(counted.select("score", "v", flow.alias("flow")))
    out = vals
    for i, s in enumerate(scores):
        one = flows.filter(F.col("score") == i).select(F.col("v").alias(f"v{i}"), F.col("flow").alias(f"flow_{s.column}"))
        out = meet(out, one, [f"v{i}"], "left").withColumn(f"flow_{s.column}", F.coalesce(f"flow_{s.column}", F.lit(0.0)))
    weight = sum(s.weight for s in scores)
    net = sum((F.col(f"flow_{s.column}") * s.weight for s in scores), F.lit(0.0)) / weight
    return out.select("key", *[f"flow_{s.column}" for s in scores], net.alias("net_flow"))


def _marks() -> dict[str, Column]:
    p, q, t = F.col("p"), F.col("q"), F.col("t")
    return {"lo_t": p - t, "lo_q": p - q - 1, "hi_q": p + q, "hi_t": p + t - 1}


def _counts_by_ties(ranked: DataFrame, ties: DataFrame) -> DataFrame:
    """``ranked`` with the number of items up to each mark, looked up in the few groups of ties.

    Without ties the i-th item has percentile 2i - 1, so up to x there are (x + 1) div 2 items; a
    group of ties counts wholly from its shared percentile on and not at all below it.
    """
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    got = ties.toPandas()  # its size was checked
    for score, g in got.groupby("score"):
        g = g.sort_values("below")
        held[int(score)] = g["below"].to_numpy(np.int64), g["cnt"].to_numpy(np.int64)
    shared = ranked.sparkSession.sparkContext.broadcast(held)
    names = list(_marks())

    def look(score: pd.Series, n: pd.Series, *marks: pd.Series) -> pd.DataFrame:
        out = {}
        s, most = score.to_numpy(), n.to_numpy(np.int64)
        for name, mark in zip(names, marks, strict=True):
            x = mark.to_numpy(np.int64)
            k = np.clip((x + 1) // 2, 0, most)
            for one in np.unique(s):
                if int(one) not in shared.value:
                    continue
                below, cnt = shared.value[int(one)]
                at = s == one
                g = np.searchsorted(below, k[at], side="right") - 1
                b, c = below[np.maximum(g, 0)], cnt[np.maximum(g, 0)]
                inside = (g >= 0) & (k[at] < b + c)
                k[at] = np.where(inside, np.where(x[at] >= 2 * b + c, b + c, b), k[at])
            out[name] = k
        return pd.DataFrame(out)

    found = F.pandas_udf(look, ", ".join(f"{k} bigint" for k in names))("score", "n", *_marks().values())
    return ranked.withColumn("k", found).select(*ranked.columns, *[F.col(f"k.{k}").alias(k) for k in names])


def _counts_by_order(ranked: DataFrame) -> DataFrame:
    """The same, for ties of any number: marks are put in order with the values and read running counts."""
    zero = F.lit(0).cast("bigint")
    data = ranked.select("score", F.col("p").alias("x"), F.lit(0).alias("ask"), "cnt", F.col("p").alias("own"), F.lit("").alias("mark"))
    asks = ranked.select("score", "p", F.explode(F.array(*[F.struct(F.lit(k).alias("mark"), c.alias("x")) for k, c in _marks().items()])).alias("m")).select("score", F.col("m.x").alias("x"), F.lit(1).alias("ask"), zero.alias("cnt"), F.col("p").alias("own"), F.col("m.mark").alias("mark"))
    sums = prefix_sums(data.unionByName(asks), "score", ["x", "ask", "own", "mark"], ["cnt"]).filter("ask = 1")
    wide = sums.groupBy("score", F.col("own").alias("p")).agg(*[F.max(F.when(F.col("mark") == k, F.col("pre_cnt"))).alias(k) for k in _marks()])
    return ranked.join(wide, ["score", "p"])


def rank_items(flows: DataFrame) -> DataFrame:
    """``flows`` with ``place`` from 1 by falling net flow; ties share the lower place."""
    flows = cut(flows)
    per_value = flows.groupBy("net_flow").agg(F.count("*").alias("cnt")).withColumn("one", F.lit(0)).withColumn("down", -F.col("net_flow"))
    placed = prefix_sums(per_value, "one", ["down"], ["cnt"]).select("net_flow", (F.col("pre_cnt") - F.col("cnt") + 1).alias("place"))
    return meet(flows, cut(placed), ["net_flow"])
