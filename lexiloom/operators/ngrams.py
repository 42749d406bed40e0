"""N-grams of texts: generation, frequencies, nesting, C-value and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..runtime import cut, meet, spread


def phrase_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, seg, tokens)``: token arrays of stretches without a delimiter; null texts give none."""
    texts = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    seg = texts.select("doc_id", F.posexplode(X.phrase_segments(F.col("text"))).alias("seg", "s"))
    return seg.select("doc_id", "seg", X.phrase_tokens(F.col("s")).alias("tokens")).filter(F.size("tokens") > 0)


def spans(tokens: Column, longest: int) -> Column:
    """``(start, n, w)`` of every stretch of up to ``longest`` tokens that no stop word begins or ends."""
    starts = F.sequence(F.lit(1), F.size(tokens))
    every = F.flatten(
        F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(tokens) - i + 1)), lambda n: F.struct(i.alias("start"), n.alias("n"), F.slice(tokens, i, n).alias("w"))))
    )
    return F.filter(every, lambda g: ~X.edge_stop_word(g["w"]))


def ngram_occurrences(docs: DataFrame, doc_id: str, text: str, longest: int = 3) -> DataFrame:
    """``(doc_id, seg, start, n, gram)``, one row per occurrence.

    A gram never spans a delimiter; one that begins or ends with a stop word is left out, which does
    not keep longer ones from being formed.
    """
    rows = phrase_rows(docs, doc_id, text)
    out = rows.select("doc_id", "seg", F.explode(spans(F.col("tokens"), longest)).alias("g"))
    return out.select("doc_id", "seg", "g.start", "g.n", F.array_join("g.w", " ").alias("gram"))


def ngram_frequencies(docs: DataFrame, doc_id: str, text: str, longest: int = 3) -> DataFrame:
    """``(gram, n, tf, df)``: occurrences, and documents that hold the gram."""
    per_doc = ngram_occurrences(docs, doc_id, text, longest).groupBy("gram", "n", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("gram", "n").agg(F.sum("c").alias("tf"), F.count("*").alias("df"))


def first_seen(occurrences: DataFrame) -> DataFrame:
    """``(gram, tf, df, doc_id, seg, start, tags)``: counts of a gram, its first place by document, stretch and start, its tags."""
    per = occurrences.groupBy("gram", "doc_id").agg(F.count("*").alias("c"), F.min(F.struct("seg", "start")).alias("at"))
    f = per.groupBy("gram").agg(F.sum("c").alias("tf"), F.count("*").alias("df"), F.min(F.struct("doc_id", "at")).alias("f"))
    tags = F.array_join(F.transform(F.split("gram", " "), X.pos_tag), "")
    return f.select("gram", "tf", "df", "f.doc_id", "f.at.seg", "f.at.start", tags.alias("tags"))


def tf_df(freq: DataFrame, documents: int, less_log: bool = False) -> DataFrame:
    """``freq`` with ``tfdf``, which rewards grams of many documents."""
    r = F.col("tf") / F.sqrt(F.lit(float(max(1, documents))))
    inner = r if less_log else F.log2(1 + r)
    return freq.withColumn("tfdf", F.log2(1 + F.col("df") * inner))


def nesting(freq: DataFrame) -> DataFrame:
    """``freq`` with ``nested_tf`` and ``containers``: frequency and number of longer grams that hold it.

    Each gram hands its distinct shorter sub-grams out, so containment is an equi-join.
    """
    w = F.split("gram", " ")
    subs = F.array_distinct(
        F.flatten(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("n") - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))
    )
    inside = freq.filter("n > 1").select(F.explode(subs).alias("gram"), "tf").groupBy("gram").agg(F.sum("tf").alias("nested_tf"), F.count("*").alias("containers"))
    return freq.join(inside, "gram", "left").withColumn("nested_tf", F.coalesce("nested_tf", F.lit(0))).withColumn("containers", F.coalesce("containers", F.lit(0)))


def c_value(nested: DataFrame) -> DataFrame:
    """``nested`` with ``cvalue``: log2(1+n) times the frequency not explained by containers, 0 at least."""
    own = F.when(F.col("containers") == 0, F.col("tf")).otherwise(F.col("tf") - F.expr("nested_tf div greatest(containers, 1)"))
    return nested.withColumn("cvalue", F.greatest(F.log2(1 + F.col("n")) * own, F.lit(0.0)))


def context_counts(occurrences: DataFrame, known: DataFrame, window: int = 10) -> DataFrame:
    """``(gram, places, neighbours, distance)`` of each gram near known terms in its stretch.

    A neighbour is a known term that neither lies inside the gram nor holds its start; ``neighbours``
    counts those within ``window`` tokens on either side, ``distance`` sums the nearest distance per
    place, ``window`` where there is none. ``occurrences`` are read twice and should be materialised.
    """
    terms = meet(occurrences.select("doc_id", "seg", "start", "gram"), cut(known.select("gram").distinct()), ["gram"]).select("doc_id", "seg", F.col("start").alias("t_start"))
    # what is further off than the window changes nothing, so places meet terms of their own and the next stretches of its width only
    band = lambda c: F.floor(F.col(c) / (window + 1)).cast("int")
    near = terms.withColumn("band", F.explode(F.array(band("t_start") - 1, band("t_start"), band("t_start") + 1)))
    c = occurrences.select("doc_id", "seg", "start", "n", "gram").withColumn("band", band("start"))
    met = c.join(near, ["doc_id", "seg", "band"], "left").withColumn(
        "far", F.when((F.col("t_start") < F.col("start")) | (F.col("t_start") >= F.col("start") + F.col("n")), F.abs(F.col("t_start") - F.col("start")))
    )
    place = met.groupBy("doc_id", "seg", "start", "n", "gram").agg(F.count_if(F.col("far") <= window).alias("inside"), F.least(F.coalesce(F.min("far"), F.lit(window)), F.lit(window)).alias("nearest"))
    return place.groupBy("gram").agg(F.count("*").alias("places"), F.sum("inside").alias("neighbours"), F.sum("nearest").alias("distance"))


def vocabulary(freq: DataFrame, least: int, most: int) -> DataFrame:
    """``(gram, tf, idx)`` of the most frequent grams, index from 0 by falling frequency, then text."""
    top = freq.filter(F.col("tf") >= least).orderBy(F.desc("tf"), "gram").limit(most)
    return top.select("gram", "tf", (F.row_number().over(Window.orderBy(F.desc("tf"), "gram")) - 1).cast("bigint").alias("idx"))  # at most `most` rows
