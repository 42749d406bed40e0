"""How often items occur together in a basket, and how far that exceeds chance.

Items are parted into heavy ones, in a sixteenth of all baskets or more, and light ones. A task
takes its baskets in chunks: heavy items are rows of a bit matrix over the chunk whose pairs are
counted by popcount, light pairs are counted by hash within a basket, and mixed pairs by probing
the matrix with each light item's list of baskets. Counts leave the task pre-aggregated, whenever
they fill its memory. A basket of very many items is parted into blocks that meet pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import running_number
from ..runtime import cut, meet

HEAVY = 16  # an item in one of so many baskets is heavy, so the mean basket bounds their number
CHUNK = 1 << 13  # baskets of a bit matrix
DENSE = 2048  # with so many items at most, light pairs are counted in a square array
PAIRS_HELD = 4_000_000  # light pairs a task expands before it counts them, and different ones it keeps
BASKET_ITEMS = 4096  # items of a block of a large basket


def _offsets(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of elements of equal runs: for step 1, 2, .. each element with the one so far on."""
    start = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(len(start)) - start
    left = np.repeat(size, size) - place
    step, alive = 1, np.flatnonzero(left > 1)
    while len(alive):
        yield alive, alive + step
        step += 1
        alive = alive[left[alive] > step]


class PairCounter:
    """Counts of unordered item pairs over baskets of item numbers; numbers below ``heavy`` are heavy."""

    def __init__(self, items: int, heavy: int):
        self.items, self.heavy = items, heavy
        self.dense = np.zeros(items * items, np.int64) if items <= DENSE else None
        self.square = np.zeros((heavy, heavy), np.int64)
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def _add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        """Takes counts in; hands on those held where they would fill the memory."""
        if self.dense is not None:
            if counts is not None:  # keys that differ
                self.dense[keys] += counts
            elif len(keys) * 8 > len(self.dense):
                self.dense += np.bincount(keys, minlength=len(self.dense))
            else:
                u, n = np.unique(keys, return_counts=True)
                self.dense[u] += n
        elif len(keys):
            u, inverse = np.unique(keys, return_inverse=True)
            self.keys.append(u)
            self.counts.append(np.bincount(inverse, counts).astype(np.int64))
            self.held += len(u)
            if self.held > PAIRS_HELD:
                self._merge()
                if self.held > PAIRS_HELD // 2:
                    yield from self._hand_on()

    def _merge(self) -> None:
        k, n = np.concatenate(self.keys), np.concatenate(self.counts)
        u, inverse = np.unique(k, return_inverse=True)
        self.keys, self.counts, self.held = [u], [np.bincount(inverse, n).astype(np.int64)], len(u)

    def _hand_on(self) -> Iterator[pd.DataFrame]:
        for k, n in zip(self.keys, self.counts, strict=True):
            yield from _frames(k, n)
        self.keys, self.counts, self.held = [], [], 0

    def add_between(self, left: np.ndarray, right: np.ndarray) -> Iterator[pd.DataFrame]:
        """Pairs of two blocks of one basket."""
        step = max(1, PAIRS_HELD // max(1, len(right)))
        for s in range(0, len(left), step):
            a, b = np.meshgrid(left[s : s + step].astype(np.int64), right.astype(np.int64), indexing="ij")
            yield from self._add((np.minimum(a, b) * self.items + np.maximum(a, b)).ravel())

    def add(self, baskets: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        size = np.array([len(b) for b in baskets])
        if not size.sum():
            return
        flat = np.concatenate(baskets).astype(np.int64)
        basket = np.repeat(np.arange(len(baskets)), size)
        is_heavy = flat < self.heavy
        present = np.zeros((self.heavy, len(baskets)), bool)
        present[flat[is_heavy], basket[is_heavy]] = True
        bits = np.packbits(present, axis=1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64) if self.heavy else bits
        for a in range(self.heavy - 1):
            self.square[a, a + 1 :] += np.bitwise_count(bits[a] & bits[a + 1 :]).sum(axis=1, dtype=np.int64)
        light, at = flat[~is_heavy], basket[~is_heavy]
        # probing: a light item's baskets against the bits of each heavy item
        for a in range(self.heavy):
            hit = light[present[a, at]]
            u, n = np.unique(hit, return_counts=True)
            yield from self._add(a * self.items + u, n)
        waiting: list[np.ndarray] = []
        held = 0
        for i, j in _offsets(np.bincount(at, minlength=len(baskets))):
            a, b = light[i], light[j]
            waiting.append(np.minimum(a, b) * self.items + np.maximum(a, b))
            held += len(a)
            if held > PAIRS_HELD:
                yield from self._add(np.concatenate(waiting))
                waiting, held = [], 0
        if waiting:
            yield from self._add(np.concatenate(waiting))

    def result(self) -> Iterator[pd.DataFrame]:
        a, b = np.nonzero(self.square)
        yield from _frames(a * self.items + b, self.square[a, b])
        if self.dense is not None:
            k = np.flatnonzero(self.dense)
            yield from _frames(k, self.dense[k])
        elif self.keys:
            self._merge()
            yield from self._hand_on()


def _frames(k: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
    for s in range(0, len(k), 1 << 18):
        yield pd.DataFrame({"pair": k[s : s + (1 << 18)], "n_ab": n[s : s + (1 << 18)]})


def pair_lift(rows: DataFrame, basket: str, item: str, min_together: int = 1, min_share: float = 0.0) -> DataFrame:
    """``(a, b, n_a, n_b, n_ab, n, lift)`` with ``a < b`` for every pair that is together often enough.

    ``min_together`` baskets and ``min_share`` of all baskets bound ``n_ab`` below; an item in fewer
    baskets cannot reach them and is left out before any pair is formed, which loses no pair. Items
    are compared trimmed and in upper case; null and blank items and null baskets do not count, an
    item counts once per basket. ``lift`` is n_ab n / (n_a n_b). Empty input gives no rows.
    """
    spark = rows.sparkSession
    name = F.upper(F.trim(F.regexp_replace(F.col(item).cast("string"), r"^\s+|\s+$", "")))
    held = cut(rows.select(F.col(basket).alias("basket"), name.alias("item")).filter("basket is not null and item <> ''").distinct())
    per_item = held.groupBy("item").agg(F.count("*").alias("n_item"))
    total = held.select("basket").distinct().count()
    least = max(min_together, -int(-min_share * total // 1), 1)
    numbered = cut(running_number(per_item.filter(F.col("n_item") >= least), [F.desc("n_item"), F.asc("item")], "id").withColumn("id", (F.col("id") - 1).cast("int")))
    items = numbered.count()
    if items < 2:
        return spark.createDataFrame([], "a string, b string, n_a bigint, n_b bigint, n_ab bigint, n bigint, lift double")
    heavy = numbered.filter(F.col("n_item") * HEAVY >= total).count()
    coded = meet(held, numbered.select("item", "id"), ["item"]).select("basket", "id")
    sizes = coded.groupBy("basket").agg(F.count("*").alias("size")).filter(F.col("size") > BASKET_ITEMS)
    large = cut(sizes.withColumn("parts", F.ceil(F.col("size") / BASKET_ITEMS).cast("int")).drop("size"))
    none = F.array().cast("array<int>")
    if large.isEmpty():
        baskets = coded.groupBy("basket").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1).select("ids", none.alias("others"))
    else:
        coded = cut(meet(coded, large, ["basket"], "left"))
        usual = coded.filter("parts is null").groupBy("basket").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1).select("ids", none.alias("others"))
        # items of a large basket in blocks, each block with itself and with those after it
        blocks = coded.filter("parts is not null").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).groupBy("basket", "part", "parts").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        met = blocks.select("basket", "part", "ids", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("to"))
        right = blocks.select("basket", F.col("part").alias("to"), F.col("ids").alias("others"))
        cross = met.join(right, ["basket", "to"]).select("ids", F.when(F.col("part") == F.col("to"), none).otherwise(F.col("others")).alias("others"))
        baskets = usual.unionByName(cross)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PairCounter(items, heavy)
        chunk: list[np.ndarray] = []
        for batch in batches:
            for ids, others in zip(batch["ids"].tolist(), batch["others"].tolist(), strict=True):
                if len(others):
                    yield from counter.add_between(ids, others)
                else:
                    chunk.append(ids)
            if len(chunk) >= CHUNK:
                yield from counter.add(chunk)
                chunk = []
        yield from counter.add(chunk)
        yield from counter.result()

    together = baskets.mapInPandas(count, "pair bigint, n_ab bigint").groupBy("pair").agg(F.sum("n_ab").alias("n_ab")).filter(F.col("n_ab") >= least)
    left = numbered.select(F.col("id").alias("ia"), F.col("item").alias("x"), F.col("n_item").alias("n_x"))
    right = numbered.select(F.col("id").alias("ib"), F.col("item").alias("y"), F.col("n_item").alias("n_y"))
    out = together.select(F.expr(f"pair div {items}").alias("ia"), (F.col("pair") % items).alias("ib"), "n_ab")
    out = meet(meet(out, left, ["ia"]), right, ["ib"])
    first = F.col("x") < F.col("y")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return out.select(
        pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("n_x", "n_y").alias("n_a"), pick("n_y", "n_x").alias("n_b"), "n_ab", F.lit(total).cast("bigint").alias("n"),
        (F.col("n_ab").cast("double") * total / (F.col("n_x").cast("double") * F.col("n_y"))).alias("lift"),
    )
