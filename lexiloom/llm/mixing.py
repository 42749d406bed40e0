"""Mixing sources to target shares of tokens by cube-method balanced sampling.

Every document of a source has the same expected number of copies; its whole part is taken, the
fraction is an inclusion probability. The flight phase moves the probabilities of a block of
documents inside the null space of two constraints, token total and document count, until at most
two of a block are undecided; these meet in new blocks, until one small landing problem is left.
"""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..runtime import cut, meet, spread

BLOCK = 4096  # documents of a flight
VOCABULARY = os.environ.get("LEXILOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(spark: SparkSession, path: str):
    """Pandas UDF: tokens of a text by the vocabulary file at ``path``; null counts 0.

    The file is shipped with the job, so only the driver must reach ``path``.
    """
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def counts(text: pd.Series) -> pd.Series:
        enc = _encoding(SparkFiles.get(name))
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in text], dtype="int64")

    return F.pandas_udf(counts, T.LongType())


def flight(prob: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but at most two, with their sum and the sum of
    size times probability kept."""
    pi = prob.astype(float).tolist()
    x = size.astype(float).tolist()
    rng = np.random.default_rng(seed)
    draws = iter(())
    eps = 1e-9
    open_ = [i for i, p in enumerate(pi) if eps < p < 1 - eps]
    waiting = iter(open_)
    active: list[int] = []
    while True:
        while len(active) < 3:
            nxt = next(waiting, None)
            if nxt is None:
                break
            active.append(nxt)
        if len(active) < 3:
            break
        a, b, c = active
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])  # orthogonal to ones and to the sizes
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, d in zip(active, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - pi[i]) / d), min(down, pi[i] / d)
            elif d < 0:
                up, down = min(up, pi[i] / -d), min(down, (1 - pi[i]) / -d)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(1024).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        for i, d in zip(active, u, strict=True):
            pi[i] = min(1.0, max(0.0, pi[i] + step * d))
        active = [i for i in active if eps < pi[i] < 1 - eps]
    return np.array([0.0 if p <= eps else 1.0 if p >= 1 - eps else p for p in pi])


def land(prob: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """The few undecided of a source, decided so that the token total stays as near as it can."""
    pi = flight(prob, size, seed)
    left = [i for i in range(len(pi)) if 0 < pi[i] < 1]
    want = float((prob * size).sum())
    best = min(range(1 << len(left)), key=lambda m: abs(float((pi * size)[[i for i in range(len(pi)) if i not in left]].sum()) + sum(size[left[k]] for k in range(len(left)) if m >> k & 1) - want)) if left else 0
    for k, i in enumerate(left):
        pi[i] = float(best >> k & 1)
    return pi


def mix_sources(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The chosen mix ``(doc_id, source, tokens, copies)`` and the shares reached, per target source
    ``(source, target_share, max_repeat, documents, chosen, copies, tokens, share)``.

    The total is the largest at which no source exceeds its cap, so shares are those of the targets
    among sources that have tokens; a source without any gets share 0 and is reported. Documents
    without tokens, with a null source or one that is no target are never chosen.
    """
    read = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), "doc_id")
    sized = read.select("doc_id", "source", count_tokens(docs.sparkSession, vocabulary)(F.col("text")).alias("tokens")).filter("tokens > 0 and source is not null")
    goal = targets.select(F.col("source"), F.col("target_share").cast("double"), F.col("max_repeat").cast("int")).filter("source is not null and target_share is not null")
    goal = cut(goal)
    sized = cut(meet(sized, goal.select("source").distinct(), ["source"]))
    stock = sized.groupBy("source").agg(F.sum("tokens").alias("stock"), F.count("*").alias("documents"))
    plan = goal.join(stock, "source", "left").withColumn("stock", F.coalesce("stock", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    reach = plan.filter("stock > 0 and target_share > 0").agg(F.min(F.col("max_repeat") * F.col("stock") / F.col("target_share"))).first()[0] or 0.0
    ratio = F.when(F.col("stock") > 0, F.least(F.lit(reach) * F.col("target_share") / F.col("stock"), F.col("max_repeat").cast("double"))).otherwise(0.0)
    plan = cut(plan.withColumn("ratio", F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio)))
    rated = meet(sized, plan.select("source", "ratio"), ["source"]).withColumn("base", F.floor("ratio")).withColumn("prob", F.col("ratio") - F.floor("ratio"))
    whole = rated.filter("prob = 0").select("doc_id", "source", "tokens", F.col("base").cast("bigint").alias("copies"))
    undecided = rated.filter("prob > 0").select("doc_id", "source", "tokens", "base", "prob")
    schema = "doc_id bigint, source string, tokens bigint, base bigint, prob double"

    def fly(final: bool, turn: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            g = group.sort_values("doc_id", kind="stable").reset_index(drop=True)
            seed = int(g["doc_id"].iloc[0]) * 31 + turn if len(g) else turn
            g["prob"] = (land if final else flight)(g["prob"].to_numpy(), g["tokens"].to_numpy(), abs(seed))
            return g[["doc_id", "source", "tokens", "base", "prob"]]

        return run

    decided = [whole]
    turn = 0
    # the largest source's undecided; each turn leaves two of a block
    while (most := undecided.groupBy("source").count().agg(F.max("count")).first()[0] or 0) > 0:
        blocks = max(1, -(-most // BLOCK))
        final = blocks == 1
        moved = undecided.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(blocks)))
        moved = moved.groupBy("source", "block").applyInPandas(fly(final, turn), schema)
        moved = cut(moved)
        decided.append(moved.filter("prob in (0, 1)").select("doc_id", "source", "tokens", (F.col("base") + F.col("prob").cast("bigint")).alias("copies")))
        if final:
            break
        undecided = moved.filter("prob > 0 and prob < 1")
        turn += 1
    mix = decided[0]
    for d in decided[1:]:
        mix = mix.unionByName(d)
    mix = mix.filter("copies > 0")
    got = mix.groupBy("source").agg(F.count("*").alias("chosen"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    shares = plan.join(got, "source", "left").select("source", "target_share", "max_repeat", "documents", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chosen", "copies", "tokens")])
    total = got.agg(F.sum("tokens")).first()[0] or 0
    shares = shares.withColumn("share", F.col("tokens") / total if total else F.lit(0.0))
    return mix, shares
