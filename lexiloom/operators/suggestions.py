"""Concepts suggested for a phrase: candidates, trimming, choice by rules of type, and the rows that come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..runtime import cut, meet

LONGEST = 7  # words of a phrase that is taken apart
FULL, SUFFIX, PART, HEAD = range(4)  # how near a candidate is to the phrase


def trim_tokens(words: Column, tags: Column) -> Column:
    """Words without leading determiners and numbers and without a tail that is no noun or gerund.

    ``tags`` are one character each, as ``pos_tag`` gives; an array without a noun becomes empty.
    """
    lead = F.length(F.regexp_extract(F.array_join(tags, ""), r"^([TD]*)", 1))
    tail = F.length(F.regexp_extract(F.array_join(tags, ""), r"([^NG]*)$", 1))
    kept = F.size(words) - lead - tail
    return F.when(kept > 0, F.slice(words, lead + 1, kept)).otherwise(F.array().cast("array<string>"))


def conjuncts(phrase: Column) -> Column:
    """The phrase itself and, where ``and`` or ``or`` joins modifiers of one head, a phrase for each of them."""
    low = X.normalize(phrase)
    parts = F.split(low, r" (?:and|or) ")
    head = F.element_at(F.split(low, " "), -1)
    several = F.transform(parts, lambda p, i: F.when(i == F.size(parts) - 1, p).otherwise(F.concat(p, F.lit(" "), head)))
    return F.when(F.size(parts) > 1, F.concat(F.array(low), several)).otherwise(F.array(low))


def candidates(phrases: DataFrame, key: str, phrase: str) -> DataFrame:
    """``(key, candidate, rank, width, skipped)`` of the phrases to look up for each phrase.

    In order of nearness: the whole phrase, its suffixes of two words or more, other stretches of two
    words or more, and each modifier with the head, which skips what is between. Phrases are parted at
    ``;`` and at conjunctions and trimmed; of a longer one its last ``LONGEST`` words count as phrase.
    Null and blank phrases give no row.
    """
    p = phrases.select(F.col(key).alias("key"), F.explode(F.split(phrase, ";")).alias("p")).filter("trim(p) <> ''")
    p = p.select("key", F.explode(conjuncts(F.col("p"))).alias("p")).select("key", X.word_array(F.col("p")).alias("w"))
    p = p.select("key", trim_tokens(F.col("w"), F.transform("w", X.pos_tag)).alias("w")).filter(F.size("w") > 0)
    p = p.withColumn("w", F.slice("w", F.greatest(F.size("w") - LONGEST + 1, F.lit(1)), LONGEST)).distinct()
    n = F.size("w")

    def row(text: Column, rank: Column, width: Column, skipped: Column) -> Column:
        return F.struct(text.alias("candidate"), rank.cast("int").alias("rank"), width.cast("int").alias("width"), skipped.cast("int").alias("skipped"))

    def stretch(i: Column, j: Column) -> Column:
        rank = F.when((i == 1) & (j == n), FULL).when(j == n, SUFFIX).otherwise(PART)
        return row(F.array_join(F.slice("w", i, j - i + 1), " "), rank, j - i + 1, F.lit(0))

    stretches = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.filter(F.sequence(i, n), lambda j: (j > i) | (n == 1)), lambda j: stretch(i, j))))
    heads = F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: i < n - 1), lambda i: row(F.concat(F.get("w", i - 1), F.lit(" "), F.element_at("w", -1)), F.lit(HEAD), F.lit(2), n - i - 1))
    out = p.select("key", F.explode(F.concat(stretches, heads)).alias("c")).select("key", "c.*")
    return out.groupBy("key", "candidate").agg(F.min(F.struct("rank", "width", "skipped")).alias("b")).select("key", "candidate", "b.rank", "b.width", "b.skipped")


def resolve(found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(key, candidate, rank, width, skipped, cui)``: the candidates that the dictionary holds, of each
    phrase those of the nearest rank and there the widest.

    The dictionary is counted before it is broadcast, and the best are merged: Spark sizes candidates, which are
    exploded, by the scan of the phrases and would broadcast them.
    """
    known = cut(lexicon.select(F.col("norm").alias("candidate"), "cui").distinct())
    held = meet(found, known, ["candidate"])
    best = held.groupBy("key").agg(F.min(F.struct("rank", (-F.col("width")).alias("less"))).alias("b")).hint("merge")
    return held.join(best, "key").filter((F.col("rank") == F.col("b.rank")) & (-F.col("width") == F.col("b.less"))).drop("b")


def nearest_concept(matches: DataFrame) -> DataFrame:
    """Of the matches of each phrase the one whose string is nearest by edit distance, then by concept and string."""
    order = F.struct(F.levenshtein(F.lower("phrase"), F.lower("descr")), "cui", "descr")
    return matches.groupBy("phrase").agg(F.min(order).alias("b")).select("phrase", F.col("b.cui").alias("cui"), F.col("b.descr").alias("descr"), F.col("b.col1").alias("distance"))


def best_per_type(suggestions: DataFrame) -> DataFrame:
    """Of the suggestions of each phrase the best per type: by score, then concept."""
    w = Window.partitionBy("phrase", "tui").orderBy(F.desc("score"), F.asc("cui"))
    return suggestions.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def preference_masks(suggestions: DataFrame, rules: DataFrame) -> DataFrame:
    """``(phrase, cui, tui, score, mask)``: which suggested types lose, and why; mask 0 is what remains.

    Within a concept a type that a rule puts behind another of its types gets 1, and of those left all
    but the first in order 4. Between concepts a type left that a rule puts behind one of another
    concept gets 2; of what is then left only the best concept's stays, by whole score and then name,
    the others get 8. Rules are ``(a, b, preferred)`` and hold in both orders; rows with a null are
    left out, repeated ones count once.
    """
    s = suggestions.groupBy("phrase", "cui", "tui").agg(F.max("score").alias("score")).filter("phrase is not null and cui is not null and tui is not null")
    s = cut(s)
    r = rules.select(F.when(F.col("preferred") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("tui"), F.col("preferred").alias("over")).filter("tui <> over").distinct()
    r = cut(r)
    inner = s.join(r, "tui").select("phrase", "cui", "tui", "over").join(s.select("phrase", "cui", F.col("tui").alias("over")), ["phrase", "cui", "over"], "left_semi").select("phrase", "cui", "tui").distinct().withColumn("m1", F.lit(1))
    one = s.join(inner, ["phrase", "cui", "tui"], "left").withColumn("m1", F.coalesce("m1", F.lit(0)))
    first = one.filter("m1 = 0").groupBy("phrase", "cui").agg(F.min("tui").alias("first"))
    two = cut(one.join(first, ["phrase", "cui"], "left").withColumn("m4", F.when((F.col("m1") == 0) & (F.col("tui") != F.col("first")), 4).otherwise(0)).drop("first"))
    left = two.filter("m1 + m4 = 0").select("phrase", "cui", "tui")
    # what is left of a phrase by type: who the concepts are matters only where it is one alone
    held = left.groupBy("phrase", "tui").agg(F.min("cui").alias("low"), F.max("cui").alias("high"))
    beaten = left.join(r, "tui").join(held.select("phrase", F.col("tui").alias("over"), "low", "high"), ["phrase", "over"]).filter("low <> cui or high <> cui").select("phrase", "cui", "tui").distinct().withColumn("m2", F.lit(2))
    three = two.join(beaten, ["phrase", "cui", "tui"], "left").withColumn("m2", F.coalesce("m2", F.lit(0)))
    whole = F.floor("score").cast("bigint")
    winner = three.filter("m1 + m4 + m2 = 0").groupBy("phrase").agg(F.min(F.struct((-whole).alias("less"), "cui")).getField("cui").alias("winner"))
    out = three.join(winner, "phrase", "left")
    m8 = F.when((F.col("m1") + F.col("m4") + F.col("m2") == 0) & (F.col("cui") != F.col("winner")), 8).otherwise(0)
    return out.select("phrase", "cui", "tui", "score", (F.col("m1") + F.col("m2") + F.col("m4") + m8).cast("int").alias("mask"))


def fan_out(groups: DataFrame, suggestions: DataFrame, on: str = "phrase") -> DataFrame:
    """A row per group, concept and type, and one with ``none`` for a group without any concept."""
    out = meet(groups, cut(suggestions.groupBy(on).agg(F.collect_set(F.struct("cui", "tui")).alias("found"))), [on], "left")
    none = F.array(F.struct(F.lit("none").alias("cui"), F.lit("none").alias("tui")))
    return out.select(*groups.columns, F.explode(F.coalesce("found", none)).alias("f")).select(*groups.columns, "f.cui", "f.tui")
