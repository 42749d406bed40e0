"""Concept dictionary, fuzzy lookup, annotation and tagger comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import lexicon as L
from ..operators.ordering import prefix_sums, with_previous
from ..runtime import table
from .registry import query
from .terms import _NORM, _POS, _STOP, _WORD

_W = lambda c: f"list_filter(string_split({c}, ' '), lambda w: w <> '')"
_LEMMA = (
    "case when length(w) > 4 and ends_with(w, 'ies') then substr(w, 1, length(w) - 3) || 'y' when length(w) > 4 and regexp_matches(w, '(ss|sh|ch|x|z)es$') then substr(w, 1, length(w) - 2) "
    "when length(w) > 3 and ends_with(w, 's') and not regexp_matches(w, '(ss|us|is)$') then substr(w, 1, length(w) - 1) when length(w) > 5 and ends_with(w, 'ing') then substr(w, 1, length(w) - 3) "
    "when length(w) > 4 and ends_with(w, 'ed') then substr(w, 1, length(w) - 2) else w end"
)
_SORTED = lambda c: f"array_to_string(list_sort({_W(c)}), ' ')"
_STEMMED = lambda c: f"array_to_string(list_transform(list_filter({_W(c)}, lambda w: w not in ({_STOP})), lambda w: {_LEMMA}), ' ')"
_TAGS = lambda c: f"array_to_string(list_sort(list_transform({_W(c)}, lambda w: {_POS})), '+')"
_LEX = f"""
base as (select distinct cui, aui, sab, umlsstr as descr from content_tag where cui is not null and trim(umlsstr) <> ''),
pref as (select cui, arg_min(descr, coalesce(aui, '~') || chr(1) || descr) as preferred from base group by cui),
lex0 as (select b.*, preferred, {_NORM('descr')} as norm from base b join pref using (cui)),
lex as (select *, {_SORTED('norm')} as ordered, {_STEMMED('norm')} as stemmed, {_TAGS('norm')} as l_tags from lex0)
"""
_LOOK = f"""
ph0 as (select distinct target as phrase, {_NORM('target')} as p_norm from content_tag_compare_only_our where trim(target) <> ''),
ph as (select *, {_SORTED('p_norm')} as p_ordered, {_STEMMED('p_norm')} as p_stemmed, {_TAGS('p_norm')} as p_tags from ph0),
hit as (select distinct ph.*, lex.* from ph join lex on phrase = descr union select distinct ph.*, lex.* from ph join lex on p_norm = norm and p_norm <> ''
  union select distinct ph.*, lex.* from ph join lex on p_ordered = ordered and p_ordered <> '' union select distinct ph.*, lex.* from ph join lex on p_stemmed = stemmed and p_stemmed <> ''),
lev as (select *, """ + ", ".join(
    f"case when greatest(length(descr), length({c})) = 0 then 0.0 else (1 - (levenshtein(descr, {c}) * 0.1 + levenshtein(lower(descr), lower({c})) * 0.9) / greatest(length(descr), length({c}))) * {top} end as s_{c}"
    for c, top in (("phrase", 100), ("p_norm", 90), ("p_stemmed", 80), ("p_ordered", 80))
) + """ from hit),
sc as (select *, greatest(s_phrase, s_p_norm, s_p_stemmed, s_p_ordered) * (case when p_tags = l_tags then 1.0 else 0.7 end) * 0.9
  + 10 * (1 - levenshtein(lower(phrase), lower(preferred)) / greatest(length(phrase), length(preferred))) as score from lev),
m as (select phrase, cui, aui, sab, descr, score, score * (case when regexp_matches(sab, '^(CLINTERM|LABNAMES)') then 1.1 else 1.0 end) as boosted from sc)
"""


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    return L.build_lexicon(table(spark, d, "content_tag"), "cui", "aui", "sab", "umlsstr")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return L.lookup(table(spark, d, "content_tag_compare_only_our"), _lexicon(spark, d), "target")


@query(f"with {_LEX} select cui, aui, sab, descr, norm, ordered, stemmed, preferred from lex")
def lexicon_build(spark: SparkSession, d: str) -> DataFrame:
    return _lexicon(spark, d)


@query(f"with {_LEX}, {_LOOK} select phrase, cui, aui, sab, descr, round(score, 4) as score from m where score >= 70")
def fuzzy_lookup_score(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).filter("score >= 70").select("phrase", "cui", "aui", "sab", "descr", F.round("score", 4).alias("score"))


@query(
    f"with {_LEX}, {_LOOK}, best as (select phrase, max((boosted, score)) as a, max((boosted, score)) filter (where contains(sab, 'LAY')) as b from m group by phrase) "
    "select phrase, round(coalesce(a[2], 0), 4) as umls_score, round(coalesce(b[2], 0), 4) as chv_score from best"
)
def best_concept_pair(spark: SparkSession, d: str) -> DataFrame:
    """The match that is best when preferred sources are boosted gives its score without the boost."""
    return L.best_pair(_matches(spark, d)).select("phrase", F.round("umls_score", 4).alias("umls_score"), F.round("chv_score", 4).alias("chv_score"))


@query(f"with {_LEX}, {_LOOK}, b as (select *, row_number() over (partition by phrase, cui order by boosted desc, sab nulls last, aui nulls last, descr) as rn from m) select phrase, cui, sab, aui, descr, round(boosted, 4) as boosted from b where rn = 1")
def best_per_concept(spark: SparkSession, d: str) -> DataFrame:
    return L.best_per_concept(_matches(spark, d)).select("phrase", "cui", "sab", "aui", "descr", F.round("boosted", 4).alias("boosted"))


@query(
    f"with {_LEX}, seg as (select id as doc_id, unnest(string_split_regex(lower(sentence), '[.?!]\\s+|\\n+|[,;/:()\\[\\]{{}}\"]+')) as s from bioportal), tok as (select doc_id, regexp_extract_all(s, '{_WORD}') as w from seg), "
    "pos as (select doc_id, w, unnest(generate_series(1, len(w))) as i from tok where len(w) > 0), span as (select doc_id, w, i, unnest([1, 2, 3, 4, 5]) as n from pos), "
    f"occ as (select doc_id, n, array_to_string(w[i : i + n - 1], ' ') as gram from span where i + n - 1 <= len(w) and w[i] not in ({_STOP}) and w[i + n - 1] not in ({_STOP})) "
    "select doc_id, gram, cast(n as bigint) as n, cui from occ join (select distinct norm, cui from lex) l on l.norm = occ.gram"
)
def annotate_sentences(spark: SparkSession, d: str) -> DataFrame:
    a = L.annotate(table(spark, d, "bioportal"), "id", "sentence", _lexicon(spark, d))
    return a.select("doc_id", "gram", F.col("n").cast("bigint").alias("n"), "cui")


@query(f"with {_LEX} select lower(ngram) as term, count(*) as n from k20all where ngram is not null and {_NORM('ngram')} not in (select norm from lex) group by 1")
def non_concept_terms(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "k20all").filter("ngram is not null").withColumn("norm", X.normalize(F.col("ngram")))
    return k.join(_lexicon(spark, d).select("norm").distinct(), "norm", "left_anti").groupBy(F.lower("ngram").alias("term")).agg(F.count("*").alias("n"))


@query(
    "select distinct a.blogid, a.sentenceindex, a.target, b.target as other, (case when a.cui = b.cui then 1 else 0 end) + (case when 1 - levenshtein(lower(a.target), lower(b.target)) / greatest(length(a.target), length(b.target)) >= 0.8 then 2 else 0 end) "
    "+ (case when lower(a.target) <> lower(b.target) and contains(lower(a.target), lower(b.target)) then 4 else 0 end) as mask from content_tag a join content_tag_compare_only_our b on a.blogid = b.blogid and a.sentenceindex = b.sentenceindex where a.cui is not null and b.cui is not null and a.target <> '' and b.target <> ''"
)
def compare_taggers(spark: SparkSession, d: str) -> DataFrame:
    """Bits per pair of findings in a sentence: 1 same concept, 2 like string, 4 the first holds the second."""
    on = ["blogid", "sentenceindex"]
    a = table(spark, d, "content_tag").filter("cui is not null and target <> ''").select(*on, "target", "cui").distinct()
    b = table(spark, d, "content_tag_compare_only_our").filter("cui is not null and target <> ''").select(*on, F.col("target").alias("other"), F.col("cui").alias("cui_b")).distinct()
    x, y = F.lower("target"), F.lower("other")
    mask = F.when(F.col("cui") == F.col("cui_b"), 1).otherwise(0) + F.when(X.similarity(F.col("target"), F.col("other")) >= 0.8, 2).otherwise(0) + F.when((x != y) & F.contains(x, y), 4).otherwise(0)
    return a.join(b, on).select(*on, "target", "other", mask.alias("mask")).distinct()


@query(f"select distinct cui, target, round(score, 4) as score from content_tag where cast(score as double) >= cast(0.9 as double) and sab in ('LAYVOC', 'CLINTERM') and tui in (select distinct tui from content_tag where semname is not null) and lower(target) not in ({_STOP})")
def external_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "content_tag")
    ok = t.filter("semname is not null").select("tui").distinct()
    kept = t.filter((F.col("score").cast("double") >= 0.9) & F.col("sab").isin("LAYVOC", "CLINTERM") & ~F.lower("target").isin(*X.STOP_WORDS)).join(ok, "tui", "left_semi")
    return kept.select("cui", "target", F.round("score", 4).alias("score")).distinct()


@query("select id, blogid, row_number() over (partition by blogid order by id) as ordinal, string_agg(target, ' > ') over (partition by blogid order by id rows between 2 preceding and current row) as trail from (select id, blogid, target from content_tag where target is not null)")
def tag_ordinals(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "content_tag").filter("target is not null").select("id", "blogid", "target").withColumn("one", F.lit(1))
    t = prefix_sums(with_previous(t, "blogid", ["id"], ["target"], 2), "blogid", ["id"], ["one"])
    return t.select("id", "blogid", F.col("pre_one").alias("ordinal"), F.concat_ws(" > ", "target_2", "target_1", "target").alias("trail"))


@query("select blogid, tui, min(id) as first_id, count(*) as run from (select id, blogid, tui, row_number() over (partition by blogid order by id) - row_number() over (partition by blogid, tui order by id) as island from content_tag) group by blogid, tui, island")
def same_type_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive findings of one type in a post."""
    t = table(spark, d, "content_tag").select("id", "blogid", "tui").withColumn("one", F.lit(1))
    t = with_previous(t, "blogid", ["id"], ["one", "tui"], 1)
    starts = F.when(F.col("one_1").isNull() | ~F.col("tui").eqNullSafe(F.col("tui_1")), 1).otherwise(0)
    t = prefix_sums(t.withColumn("start", starts), "blogid", ["id"], ["start"])
    return t.groupBy("blogid", "tui", "pre_start").agg(F.min("id").alias("first_id"), F.count("*").alias("run")).drop("pre_start")


@query("with s as (select blogid, sentence from content_tag where sentence is not null) select sentence, count(*) as n from s group by sentence having count(*) > 1")
def repeated_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "content_tag").filter("sentence is not null").select("blogid", "sentence")
    return s.groupBy("sentence").agg(F.count("*").alias("n")).filter("n > 1")


