"""Term sequences, vectors, clean-ups and small graph and sampling idioms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from ..operators import ngrams as N
from ..operators import relational as R
from ..operators.ordering import with_previous
from ..runtime import cut, meet, table
from .registry import query
from .terms import _GRAMS, _POS, _STOP, _WORD

_SYN = "regexp_replace(regexp_replace(regexp_replace(lower(subject), '\\(family\\)', '', 'g'), '\\b(synonyms?|also called|aka)\\b', '', 'g'), '[/;,()]| and | or ', '|', 'g')"


@query(f"select id, pos, part from (select id, cast(generate_subscripts(l, 1) as bigint) as pos, unnest(l) as part from (select id, list_filter(list_transform(string_split({_SYN}, '|'), lambda x: trim(x)), lambda x: x <> '') as l from (select distinct id, subject from tmp_org_yahoo where subject is not null)))")
def synonym_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Alternatives of a title, one per row with its position; the family marker goes, alternates in parentheses are rows."""
    t = table(spark, d, "tmp_org_yahoo").filter("subject is not null").select("id", "subject").distinct()
    s = F.regexp_replace(F.regexp_replace(F.lower("subject"), r"\(family\)", ""), r"\b(synonyms?|also called|aka)\b", "")
    s = F.regexp_replace(s, "[/;,()]| and | or ", "|")
    parts = F.filter(F.transform(F.split(s, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return t.select("id", F.posexplode(parts).alias("p", "part")).select("id", (F.col("p") + 1).cast("bigint").alias("pos"), "part")


@query(
    "select id, 0 as place, org_str as term from bioportal where org_str is not null union all select id, cast(generate_subscripts(l, 1) as int), unnest(l) from "
    "(select id, list_filter(list_transform(string_split(sentence, ','), lambda x: trim(x)), lambda x: x <> '') as l from bioportal where org_str is not null and sentence is not null)"
)
def align_explode(spark: SparkSession, d: str) -> DataFrame:
    """The base term of a record, then the other terms of its comma list, a row each in order."""
    t = table(spark, d, "bioportal").filter("org_str is not null")
    others = F.filter(F.transform(F.split("sentence", ","), lambda x: F.trim(x)), lambda x: x != "")
    return t.select("id", F.posexplode(F.concat(F.array("org_str"), F.coalesce(others, F.array().cast("array<string>")))).alias("place", "term"))


@query(
    f"with {_GRAMS}, tot as (select gram, sum(tf) as tf from freq group by gram), voc as (select gram from tot where tf >= 10 order by tf desc, gram limit 10000), o as (select distinct doc_id, sid, gram from occ), "
    "v as (select o.* from o join voc using (gram)), n as (select a.gram as gram, v.gram as word, count(*) as n from o a join v on a.doc_id = v.doc_id and a.sid = v.sid and a.gram <> v.gram group by 1, 2) "
    "select n.gram, word, n, round(cast(n as double) / tf, 6) as per_place from n join tot on tot.gram = n.gram"
)
def bow_cooccur_vector(spark: SparkSession, d: str) -> DataFrame:
    """Every place that is not zero of every gram's bag-of-words vector, as a count and over the gram's frequency; the vocabulary
    is the reference's: the 10,000 most frequent grams that occur ten times or more.

    Only tokens move before grams meet words, which they do inside their stretch, and words are numbers until the
    end. The counts are merged, as Spark sizes what is made of exploded grams by the scan and would broadcast it; no
    gram has more places than the vocabulary, so none is hot.
    """
    docs = table(spark, d, "documents").select("doc_id", "text")
    freq = cut(N.ngram_occurrences(docs, "doc_id", "text").groupBy("gram").agg(F.count("*").alias("tf")))
    voc = cut(N.vocabulary(freq, 10, 10_000).select("gram", F.col("idx").cast("int").alias("own")))
    rows = N.phrase_rows(docs.filter("doc_id is not null"), "doc_id", "text").groupBy("doc_id", "seg").agg(F.collect_list("tokens").alias("parts"))
    grams = F.array_distinct(F.flatten(F.transform("parts", lambda t: F.transform(N.spans(t, 3), lambda g: F.array_join(g["w"], " ")))))
    held = meet(rows.select("doc_id", "seg", F.explode(grams).alias("gram")), voc, ["gram"], "left")
    held = held.groupBy("doc_id", "seg").agg(F.collect_list(F.struct("gram", "own")).alias("grams"), F.collect_list("own").alias("words"))
    pairs = held.select(F.explode("grams").alias("g"), "words").select("g.gram", "g.own", F.explode("words").alias("place")).filter("own is null or own <> place")
    n = pairs.groupBy("gram", "place").agg(F.count("*").alias("n")).join(freq.hint("merge"), "gram")
    n = meet(n, voc.select(F.col("own").alias("place"), F.col("gram").alias("word")), ["place"])
    return n.select("gram", "word", "n", F.round(F.col("n").cast("double") / F.col("tf"), 6).alias("per_place"))


@query(
    "with p as (select distinct blogid, sab, lower(target) as k, target as parent from content_tag where target <> '') "
    "select distinct c.id, p.parent from content_tag c left join p on c.blogid = p.blogid and c.sab = p.sab and c.target <> p.parent and ends_with(lower(c.target), p.k) where c.target <> ''"
)
def suffix_parents(spark: SparkSession, d: str) -> DataFrame:
    """Findings with the strings of their post and source that theirs ends with, null where there is none.

    A string meets its own suffixes by equality, so no pair of findings is formed. The two sides are merged: Spark
    sizes the suffixes, which are exploded, by the scan and would broadcast them.
    """
    t = table(spark, d, "content_tag").filter("target <> ''").select("id", "blogid", "sab", "target")
    p = t.select("blogid", "sab", F.lower("target").alias("suffix"), F.col("target").alias("parent")).distinct()
    ends = F.transform(F.sequence(F.lit(1), F.length("target")), lambda i: F.substring(F.lower("target"), i, F.length("target")))
    held = t.select("id", "blogid", "sab", "target", F.explode(ends).alias("suffix")).join(p.hint("merge"), ["blogid", "sab", "suffix"]).filter("target <> parent").select("id", "parent").distinct()
    return t.select("id").distinct().join(held, "id", "left")


@query(f"with {_GRAMS} select doc_id, n, gram, row_number() over (partition by doc_id order by sid, i, n) as ordinal from occ")
def ngram_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Every gram of every document in the order of the text, numbered."""
    return _sequence(table(spark, d, "documents"))


def _sequence(docs: DataFrame) -> DataFrame:
    o = N.ngram_occurrences(docs, "doc_id", "text")
    w = Window.partitionBy("doc_id").orderBy("seg", "start", "n")
    return o.select("doc_id", F.col("n").cast("bigint").alias("n"), "gram", F.row_number().over(w).cast("bigint").alias("ordinal"))


@query("select postid, userid, coalesce(n1, n2, n3) as amount from (select postid, userid, num as n1, lag(num, 1) over w as n2, lag(num, 2) over w as n3 from (select distinct postid, userid, try_cast(nullif(regexp_extract(content, '([0-9]+) (days|weeks|months|years)', 1), '') as int) as num from dataset_deaf where userid is not null) window w as (partition by userid order by postid, num nulls first))")
def duration_repair(spark: SparkSession, d: str) -> DataFrame:
    """An amount from the own text, else the post before, else the one before that."""
    t = table(spark, d, "dataset_deaf").filter("userid is not null")
    got = F.regexp_extract("content", "([0-9]+) (days|weeks|months|years)", 1)
    t = t.select("postid", "userid", got.try_cast("int").alias("num")).distinct()
    t = with_previous(t, "userid", ["postid", "num"], ["num"], 2)
    return t.select("postid", "userid", F.coalesce("num", "num_1", "num_2").alias("amount"))


# The features of a term with their weights; counters are per occurrence.
FEATURES = {
    "n": ("n", 1.0), "log_tf": ("ln(1 + tf)", 1.0), "log_df": ("ln(1 + df)", 1.0), "tfdf": ("cast(tfdf as double)", 0.5), "nest": ("coalesce(nest, 0)", 1.0), "nested": ("coalesce(nest_tf, 0) / cast(tf as double)", 1.0),
    "umls": ("coalesce(umls_score, 0) / 100.0", 1.0), "chv": ("coalesce(chv_score, 0) / 10.0", 1.0), "contain_umls": ("case when contain_umls = 'true' then 1 else 0 end", 1.0), "contain_chv": ("case when contain_chv = 'true' then 1 else 0 end", 1.0),
    "win_umls": ("coalesce(win_umls, 0) / cast(tf as double)", 2.0), "win_chv": ("coalesce(win_chv, 0) / cast(tf as double)", 2.0), "sent_umls": ("coalesce(sent_umls, 0) / cast(tf as double)", 1.0), "sent_chv": ("coalesce(sent_chv, 0) / cast(tf as double)", 1.0),
    "umls_dist": ("coalesce(umls_dist, 0) / cast(tf as double)", 1.0), "chv_dist": ("coalesce(chv_dist, 0) / cast(tf as double)", 1.0), "nn": ("case when nn = 'true' then 1 else 0 end", 1.0), "an": ("case when an = 'true' then 1 else 0 end", 1.0),
    "pn": ("case when pn = 'true' then 1 else 0 end", 1.0), "anpn": ("case when anpn = 'true' then 1 else 0 end", 1.0), "tag_n": ("length(sytax) - length(replace(sytax, 'N', ''))", 0.5), "tag_a": ("length(sytax) - length(replace(sytax, 'A', ''))", 0.5),
    "tag_p": ("length(sytax) - length(replace(sytax, 'P', ''))", 0.5), "prefix": ("case when starts(lower(ngram), 'h') or starts(lower(ngram), 'an') then 1 else 0 end", 1.0), "suffix": ("case when ends(lower(ngram), 's') or ends(lower(ngram), 'ia') then 1 else 0 end", 1.0),
}


def _features(starts: str, ends: str) -> list[str]:
    return [f"round(max(({e.replace('starts(', starts + '(').replace('ends(', ends + '(')}) * {w}), 5) as {k}" for k, (e, w) in FEATURES.items()]


@query(f"select ngram, {', '.join(_features('starts_with', 'ends_with'))} from (select distinct * from k20all) where ngram is not null and tf > 0 and sytax is not null group by ngram")
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    """The 25 weighted features of a term."""
    t = table(spark, d, "k20all").filter("ngram is not null and tf > 0 and sytax is not null")
    return t.groupBy("ngram").agg(*map(F.expr, _features("startswith", "endswith")))


@query("select distinct c.cui, o.cui2 as related, o.rel from content_tag c join content_tag_compare_only_our o on o.cui1 = c.cui where o.rel in ('SY', 'SIB') and o.cui2 is not null and o.cui2 <> c.cui")
def synonym_expansion(spark: SparkSession, d: str) -> DataFrame:
    """One level of synonyms and siblings of every concept found."""
    o = table(spark, d, "content_tag_compare_only_our").filter("rel in ('SY', 'SIB') and cui2 is not null").select(F.col("cui1").alias("cui"), F.col("cui2").alias("related"), "rel").distinct()
    c = table(spark, d, "content_tag").filter("cui is not null").select("cui").distinct()
    return c.join(o, "cui").filter("cui <> related")


@query(f"select id, array_to_string(list_transform(list_filter(regexp_extract_all(lower(sentence), '{_WORD}'), lambda w: w not in ({_STOP})), lambda w: w || '_' || ({_POS})), ' ') as s from bioportal where sentence is not null")
def normalized_sentence(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as words with their tags, without stop words."""
    t = table(spark, d, "bioportal").filter("sentence is not null")
    w = F.filter(X.phrase_tokens(F.lower("sentence")), lambda x: ~x.isin(*X.STOP_WORDS))
    return t.select("id", F.array_join(F.transform(w, lambda x: F.concat(x, F.lit("_"), X.pos_tag(x))), " ").alias("s"))


@query("with e as (select distinct cui1 as a, cui2 as b from content_tag_compare_only_our where rel = 'PAR' and cui1 is not null and cui2 is not null and cui1 <> cui2), n as (select distinct cui from content_tag where cui is not null) select cui, (cui in (select a from e union select b from e)) as linked from n")
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Concepts found, and whether the graph links them."""
    e = table(spark, d, "content_tag_compare_only_our").filter("rel = 'PAR' and cui1 <> cui2").select(F.explode(F.array("cui1", "cui2")).alias("cui")).distinct().withColumn("linked", F.lit(True))
    n = table(spark, d, "content_tag").filter("cui is not null").select("cui").distinct()
    return n.join(e, "cui", "left").select("cui", F.coalesce("linked", F.lit(False)).alias("linked"))


@query("select o.blogid, o.blog_name, c.tags, count(*) as findings, count(distinct c.sentenceindex) as sentences from tmp_org o join content_tag c on c.blogid = cast(o.blogid as varchar) where o.text_content is not null group by 1, 2, 3")
def document_annotation_join(spark: SparkSession, d: str) -> DataFrame:
    """Posts with their findings and sentences: document, annotation and sentence in one view."""
    o = table(spark, d, "tmp_org").filter("text_content is not null").select("blogid", "blog_name")
    c = table(spark, d, "content_tag").select(F.col("blogid").try_cast("bigint").alias("blogid"), "tags", "sentenceindex")
    return o.join(c, "blogid").groupBy("blogid", "blog_name", "tags").agg(F.count("*").alias("findings"), F.count_distinct("sentenceindex").alias("sentences"))


@query("select z.zone, count(*) as n, count(distinct y.userid) as askers, min(y.day) as first_day, max(y.day) as last_day from tmp_org_yahoo y join source_zones z on z.tbl = 'tmp_org_yahoo' and z.scope = y.category where y.chosenanswer is not null group by z.zone")
def answers_by_zone(spark: SparkSession, d: str) -> DataFrame:
    """Chosen answers by the zone of their category."""
    z = table(spark, d, "source_zones").filter("tbl = 'tmp_org_yahoo'").select(F.col("scope").alias("category"), "zone")
    y = table(spark, d, "tmp_org_yahoo").filter("chosenanswer is not null").select("category", "userid", "day")
    return y.join(z, "category").groupBy("zone").agg(F.count("*").alias("n"), F.count_distinct("userid").alias("askers"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("select ngram from (select distinct ngram from k20all where ngram is not null) order by md5('7' || ngram), ngram limit 400")
def sampled_terms(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 400 terms, the same at every run."""
    t = table(spark, d, "k20all").filter("ngram is not null").select("ngram").distinct()
    return t.orderBy(F.md5(F.concat(F.lit("7"), "ngram")), "ngram").limit(400)


@query("select ngram, tf, case when n > 1 and tf >= 2 * 0.5 or tf >= 2 then true else false end as kept from (select ngram, max(n) as n, max(tf) as tf from k20all where ngram is not null and tf is not null group by ngram)")
def long_term_filter(spark: SparkSession, d: str) -> DataFrame:
    """Frequency filter that lets longer terms pass at a part of the threshold."""
    t = table(spark, d, "k20all").filter("ngram is not null and tf is not null").groupBy("ngram").agg(F.max("n").alias("n"), F.max("tf").alias("tf"))
    return t.select("ngram", "tf", ((F.col("tf") >= 2) | ((F.col("n") > 1) & (F.col("tf") >= 2 * 0.5))).alias("kept"))


@query("select event_type, user_id, ts, json_extract_string(props, '$.device') as device, lag(value) over (partition by user_id order by ts, event_id) as before, round(value, 4) as value from events")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """A field of the packed properties, and the value of the user's event before."""
    e = table(spark, d, "events").select("event_type", "user_id", "ts", "event_id", F.get_json_object("props", "$.device").alias("device"), "value")
    e = with_previous(e, "user_id", ["ts", "event_id"], ["value"], 1)
    return e.select("event_type", "user_id", "ts", "device", F.col("value_1").alias("before"), F.round("value", 4).alias("value"))


@query("select c_mktsegment, n_name, count(*) as n, round(sum(c_acctbal), 2) as balance, grouping(c_mktsegment) as g_segment, grouping(n_name) as g_nation from customer join nation on n_nationkey = c_nationkey group by rollup (c_mktsegment, n_name)")
def segment_rollup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, d, "customer").join(n, "c_nationkey")
    r = c.rollup("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.grouping("c_mktsegment").cast("bigint").alias("g_segment"), F.grouping("n_name").cast("bigint").alias("g_nation"))
    return r.select("c_mktsegment", "n_name", "n", "balance", "g_segment", "g_nation")
