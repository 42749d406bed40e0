"""Sets of output files written from one materialised plan, and the jobs that make them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import criteria as C
from ..operators import graph as G
from ..operators import ngrams as N
from ..operators import suggestions as S
from ..runtime import cut
from .files import write_quoted, write_tabbed

JOBS = ("parse", "quantity", "keyword", "pattern", "split")


def write_criteria(rows: DataFrame, lexicon: DataFrame, folder: str) -> dict[str, str]:
    """Five tab-separated outputs of criteria sentences: patterns, concepts, outside concepts, normalised
    sentences and terms without a concept. The sentences are materialised once. Returns their folders."""
    rows = cut(rows)
    parts = rows.select("doc_id", "sent", F.posexplode(F.split("s", "[,.:;]")).alias("part", "p"))  # each part is a phrase of its own
    found = cut(S.candidates(parts.select(F.concat_ws(":", "doc_id", "sent", "part").alias("key"), "p"), "key", "p"))
    inside = cut(S.resolve(found, lexicon))
    norm = X.word_array(X.normalize(F.col("s")))
    outputs = {
        "pattern": C.match_patterns(rows), "concept": inside.filter(F.col("rank") == S.FULL), "external": inside.filter(F.col("rank") != S.FULL),
        "normalized": rows.select("doc_id", "sent", F.array_join(F.transform(norm, lambda w: F.concat(w, F.lit("_"), X.pos_tag(w))), " ").alias("s")),
        "other": found.filter(F.col("rank") == S.FULL).join(inside.select("key").distinct(), "key", "left_anti").groupBy(F.lower("candidate").alias("term"), "width").agg(F.count("*").alias("freq")),
    }
    for name, df in outputs.items():
        write_tabbed(df, f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in outputs}


def write_grams(docs: DataFrame, doc_id: str, text: str, folder: str, least: int = 2) -> None:
    """Grams with their counts, first place, tags and flags, and their bag-of-words vectors, as tab-separated text."""
    occ = cut(N.ngram_occurrences(docs, doc_id, text))
    f = cut(N.first_seen(occ).filter(F.col("tf") >= least).withColumn("n", F.size(F.split("gram", " "))))
    n = docs.filter(F.col(text).isNotNull()).count()
    full = N.c_value(N.nesting(N.tf_df(f, n)))
    flags = {"nn": ".*N.*N.*", "an": ".*A.*N.*", "pn": ".*P.*N.*", "anpn": "((A|N)+|((A|N)*(NP)?)(A|N)*)N"}
    for k, p in flags.items():
        full = full.withColumn(k, F.when(F.col("tags").rlike(f"^(?:{p})$"), "T").otherwise("F"))
    capital = X.capital_class(F.col("gram"))
    write_tabbed(full.withColumn("capital", capital), f"{folder}/grams")
    places = occ.join(f.select("gram"), "gram").select("doc_id", "seg", "gram").distinct()
    words = places.filter(~F.col("gram").contains(" ")).withColumnRenamed("gram", "word")
    vectors = places.join(words, ["doc_id", "seg"]).filter("gram <> word").groupBy("gram", "word").agg(F.count("*").alias("n"))
    write_tabbed(vectors, f"{folder}/vectors")


def write_tokens(docs: DataFrame, text: str, folder: str) -> None:
    """Tokens and their lemmas as running text, one line per sentence, and their frequencies."""
    s = docs.filter(F.col(text).isNotNull()).select(F.explode(X.sentences(F.col(text))).alias("s"))
    w = cut(s.select(X.phrase_tokens(F.lower("s")).alias("w")).filter(F.size("w") > 0))
    w.select(F.array_join("w", " ").alias("value")).write.mode("overwrite").text(f"{folder}/tokens")
    w.select(F.array_join(F.transform("w", X.lemma), " ").alias("value")).write.mode("overwrite").text(f"{folder}/norms")
    per = w.select(F.explode("w").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    write_tabbed(per.select("token", X.lemma(F.col("token")).alias("norm"), X.pos_tag(F.col("token")).alias("tag"), "n"), f"{folder}/statistics")


def write_groups(edges: DataFrame, folder: str) -> None:
    """Members of the is-a groups and the groups themselves as quoted text."""
    grouped = cut(G.group_numbers(G.group_under_roots(edges)))
    write_quoted(grouped, f"{folder}/members")
    write_quoted(G.group_kinds(grouped), f"{folder}/groups")


def run_job(name: str, spark: SparkSession, trials: DataFrame, lexicon: DataFrame, keywords: DataFrame, folder: str) -> None:
    """One of ``JOBS`` over trial texts ``(doc_id, text)``; another name is an error before anything is read."""
    if name not in JOBS:
        raise ValueError(f"{name} is none of {', '.join(JOBS)}")
    if name == "split":
        write_quoted(trials.select("doc_id", F.posexplode(C.split_pieces(F.col("text"))).alias("part", "piece")), f"{folder}/split")
        return
    rows = C.criteria_rows(trials, "doc_id", "text")
    if name == "parse":
        write_criteria(rows, lexicon, folder)
    elif name == "quantity":
        write_quoted(rows.select("doc_id", "sent", C.first_quantity(F.col("s")).alias("quantity"), C.all_quantities(F.col("s")).alias("all"), "s"), f"{folder}/quantity")
    elif name == "keyword":
        write_quoted(C.keyword_hits(rows, keywords), f"{folder}/keyword")
    else:
        write_quoted(C.match_patterns(rows), f"{folder}/patterns")
