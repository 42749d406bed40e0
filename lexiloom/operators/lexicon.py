"""Dictionary of concept strings: building, lookup by four keys, scoring, and annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..runtime import cut, meet
from .ngrams import ngram_occurrences

CONSUMER = "LAY"  # part of the names of sources in consumer language
PREFERRED_SOURCES = r"^(?:CLINTERM|LABNAMES)"


def build_lexicon(rows: DataFrame, cui: str, aui: str, sab: str, descr: str) -> DataFrame:
    """Distinct ``(cui, aui, sab, descr, norm, ordered, stemmed, preferred)``.

    ``preferred`` is the string of the concept's least atom; null concepts and blank strings are out.
    """
    base = rows.select(F.col(cui).alias("cui"), F.col(aui).alias("aui"), F.col(sab).alias("sab"), F.col(descr).alias("descr")).filter("cui is not null and trim(descr) <> ''").distinct()
    best = base.groupBy("cui").agg(F.min(F.struct(F.coalesce("aui", F.lit("~")), "descr")).getField("descr").alias("preferred"))
    norm = X.normalize(F.col("descr"))
    return base.join(best, "cui").select("cui", "aui", "sab", "descr", norm.alias("norm"), X.sort_words(norm).alias("ordered"), X.stem_words(norm).alias("stemmed"), "preferred")


def phrase_keys(phrases: DataFrame, phrase: str) -> DataFrame:
    """Distinct phrases with their normalised, ordered and stemmed forms and their tags."""
    p = phrases.select(F.col(phrase).alias("phrase")).filter("trim(phrase) <> ''").distinct()
    norm = X.normalize(F.col("phrase"))
    return p.select("phrase", norm.alias("p_norm"), X.sort_words(norm).alias("p_ordered"), X.stem_words(norm).alias("p_stemmed"), _tags(norm).alias("p_tags"))


def _tags(norm: Column) -> Column:
    return X.pos_signature(F.transform(X.word_array(norm), X.pos_tag))


def lookup(phrases: DataFrame, lexicon: DataFrame, phrase: str = "phrase") -> DataFrame:
    """``(phrase, cui, aui, sab, descr, score, boosted)`` of every dictionary row that shares a key.

    The four equalities are four equi-joins whose union is made distinct; an OR join would compare
    every phrase with every row. Sources preferred by ``PREFERRED_SOURCES`` are boosted by a tenth.
    """
    p = phrase_keys(phrases, phrase)
    hits = None
    for a, b in (("phrase", "descr"), ("p_norm", "norm"), ("p_ordered", "ordered"), ("p_stemmed", "stemmed")):
        one = p.filter(F.col(a) != "").join(lexicon, F.col(a) == F.col(b))
        hits = one if hits is None else hits.unionByName(one)
    hits = hits.distinct()
    same = F.col("p_tags") == _tags(F.col("norm"))
    score = X.match_score(F.col("descr"), F.col("phrase"), F.col("p_norm"), F.col("p_stemmed"), F.col("p_ordered"), F.col("preferred"), same)
    out = hits.withColumn("score", score)
    boost = F.when(F.col("sab").rlike(PREFERRED_SOURCES), 1.1).otherwise(1.0)
    return out.select("phrase", "cui", "aui", "sab", "descr", "score", (F.col("score") * boost).alias("boosted"))


def best_per_concept(matches: DataFrame) -> DataFrame:
    """The best match of each concept of a phrase by boosted score, then source, atom and string."""
    w = Window.partitionBy("phrase", "cui").orderBy(F.desc("boosted"), F.asc_nulls_last("sab"), F.asc_nulls_last("aui"), "descr")
    return matches.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def best_pair(matches: DataFrame) -> DataFrame:
    """``(phrase, umls_score, chv_score)``: unboosted scores of the best match in any source and in
    consumer sources, 0 where there is none."""
    key = F.struct("boosted", "score")
    lay = F.coalesce(F.col("sab").contains(CONSUMER), F.lit(False))
    got = matches.groupBy("phrase").agg(F.max(key).alias("a"), F.max(F.when(lay, key)).alias("b"))
    return got.select("phrase", F.coalesce("a.score", F.lit(0.0)).alias("umls_score"), F.coalesce("b.score", F.lit(0.0)).alias("chv_score"))


def annotate(docs: DataFrame, doc_id: str, text: str, lexicon: DataFrame, longest: int = 5) -> DataFrame:
    """``(doc_id, start, n, gram, cui)`` of every gram of a text that a dictionary string normalises to.

    The dictionary is counted before it is broadcast: by the size of the scan the grams look smaller than it, and
    the driver would hold them all.
    """
    grams = ngram_occurrences(docs, doc_id, text, longest)
    known = cut(lexicon.select(F.col("norm").alias("gram"), "cui").distinct())
    return meet(grams, known, ["gram"]).select("doc_id", "seg", "start", "n", "gram", "cui")


def annotate_scored(docs: DataFrame, doc_id: str, text: str, lexicon: DataFrame, least: float, longest: int = 5) -> DataFrame:
    """``(doc_id, hit, gram, score, codes)`` of every gram of a text whose best match by any of the four
    keys scores more than ``least``; ``codes`` are the concepts beyond it, ``hit`` numbers the hits of a text.

    Each distinct gram is looked up once.
    """
    grams = cut(ngram_occurrences(docs, doc_id, text, longest))
    found = lookup(grams.select("gram").distinct(), lexicon, "gram").filter(F.col("score") > least)
    good = cut(found.groupBy(F.col("phrase").alias("gram")).agg(F.max(F.round("score", 4)).alias("score"), F.array_join(F.array_sort(F.collect_set("cui")), ":").alias("codes")))
    w = Window.partitionBy("doc_id").orderBy("seg", "start", "n")  # hits of one text
    return meet(grams, good, ["gram"]).select("doc_id", F.row_number().over(w).cast("bigint").alias("hit"), "gram", "score", "codes")
