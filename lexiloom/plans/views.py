"""Views over several tables, scored terms, candidates, contexts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from ..operators import lexicon as L
from ..operators import ngrams as N
from ..operators import relational as R
from ..operators import suggestions as S
from ..runtime import cut, meet, table
from .concepts import _LEMMA, _LEX, _lexicon
from .mining import _OWN
from .registry import query
from .terms import _GRAMS, _NEST, _NORM, _POS, _STOP, _WORD, _WORDS, _texts
from .trials import _SENT, _rows


@query("with i as (select distinct doc_id from documents where text is not null order by doc_id limit 500) select doc_id, trim(regexp_replace(regexp_replace(any_value(text), '([!-/:-@\\[-`{-~])', ' \\1 ', 'g'), '\\s+', ' ', 'g')) as text from documents join i using (doc_id) group by doc_id")
def id_text_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first ids, and the text of each with its punctuation set off."""
    docs = table(spark, d, "documents").filter("text is not null")
    ids = docs.select("doc_id").distinct().orderBy("doc_id").limit(500)
    return docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", X.pad_punctuation(F.col("text")).alias("text"))


@query(
    "select o.blogid, c.sentenceindex, count(distinct c.id) as findings, count(distinct n.id) as others, count(distinct s.sentence) as sentences from tmp_org o join content_tag c on c.blogid = cast(o.blogid as varchar) join content_tag_compare_only_our n on n.blogid = c.blogid and n.sentenceindex = c.sentenceindex "
    "join (select distinct blogid, sentenceindex, sentence from content_tag where sentence is not null) s on s.blogid = c.blogid and s.sentenceindex = c.sentenceindex group by 1, 2"
)
def annotation_view(spark: SparkSession, d: str) -> DataFrame:
    """Posts, findings of both taggers and sentences in one view of four tables."""
    on = ["blogid", "sentenceindex"]
    o = table(spark, d, "tmp_org").select(F.col("blogid").cast("string").alias("blogid")).distinct()
    t = table(spark, d, "content_tag")
    c, s = t.select(*on, "id").join(o, "blogid", "left_semi"), t.filter("sentence is not null")
    # counts are taken before the join, so that no finding meets another
    c = c.groupBy(*on).agg(F.count_distinct("id").alias("findings"))
    n = table(spark, d, "content_tag_compare_only_our").groupBy(*on).agg(F.count_distinct("id").alias("others"))
    s = s.groupBy(*on).agg(F.count_distinct("sentence").alias("sentences"))
    out = c.join(n, on).join(s, on)
    return out.select(F.col("blogid").cast("bigint").alias("blogid"), "sentenceindex", "findings", "others", "sentences")


@query("select distinct a.blogid, a.sentenceindex, a.target, a.sab, a.tui as tui_a, b.tui as tui_b from content_tag a join content_tag b on a.blogid = b.blogid and a.sentenceindex = b.sentenceindex and split_part(a.target, ' ', 1) = split_part(b.target, ' ', 1) and a.sab = b.sab and a.tui > b.tui")
def type_conflicts_four_keys(spark: SparkSession, d: str) -> DataFrame:
    """Types that findings of one post, sentence, first word and source do not agree on."""
    t = table(spark, d, "content_tag").select("blogid", "sentenceindex", F.split("target", " ")[0].alias("first"), "sab", "target", "tui").distinct()
    b = t.select("blogid", "sentenceindex", "first", "sab", F.col("tui").alias("tui_b")).distinct()
    return t.join(b, ["blogid", "sentenceindex", "first", "sab"]).filter("tui > tui_b").select("blogid", "sentenceindex", "target", "sab", F.col("tui").alias("tui_a"), "tui_b").distinct()


@query("with p as (select id from tmp_org_yahoo where id > 100 order by id limit 500) select min(id) as first_id, max(id) as last_id, count(*) as n from p")
def page_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The page that follows a key, and the key that the next one follows."""
    return R.page_after(table(spark, d, "tmp_org_yahoo").select("id"), "id", 100, 500).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))


_LABELS = {"pain": "pain", "cough": "cough", "liver": "liver", "skin": "skin", "test": "test", "aid": "aid", "device": "pump", "joint": "knee", "sleep": "sleep"}


@query(" union ".join(f"select blogid, '{k}' as label from content_tag where lower(target) like '%{v}%'" for k, v in _LABELS.items()))
def nine_labels(spark: SparkSession, d: str) -> DataFrame:
    """A union of nine labelled filters from one scan, each row once."""
    t = table(spark, d, "content_tag").select("blogid", "target")
    return R.labelled_union(t, {k: F.lower("target").contains(v) for k, v in _LABELS.items()}).select("blogid", "label").distinct()


_NUMBERS = ("n", "tfdf", "tf", "df", "nest", "nest_tf", "umls_score", "chv_score", "win_umls", "win_chv", "sent_umls", "sent_chv", "umls_dist", "chv_dist")


@query("select k, " + ", ".join(f"round(avg(cast({c} as double)), 5) as {c}" for c in _NUMBERS) + " from k20all group by k")
def group_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean of every number per cluster."""
    return table(spark, d, "k20all").groupBy("k").agg(*[F.round(F.avg(F.col(c).cast("double")), 5).alias(c) for c in _NUMBERS])


_WEEKS = "case unit when 'day' then n / 7.0 when 'week' then n when 'month' then n * 4.345 when 'year' then n * 52.18 else n / 168.0 end"


@query(
    "with b as (select cui, try_cast(regexp_extract(lower(sentence), '([0-9]+) (hour|day|week|month|year)', 1) as double) as n, regexp_extract(lower(sentence), '([0-9]+) (hour|day|week|month|year)', 2) as unit from bioportal where cui is not null), "
    f"w as (select cui, case when {_WEEKS} < 4 then 'under 4 weeks' when {_WEEKS} < 26 then 'under 26 weeks' when {_WEEKS} < 52 then 'under 52 weeks' else 'longer' end as span from b where n is not null), "
    "top as (select cui, row_number() over (order by n desc, cui) as place from (select cui, count(*) as n from w group by cui) order by n desc, cui limit 50) "
    "select span, " + ", ".join(f"cast(count(*) filter (where place = {i}) as bigint) as c{i}" for i in range(1, 51)) + " from w join top using (cui) group by span"
)
def duration_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Durations by the fifty concepts that have most of them, one column per place."""
    low = F.lower("sentence")
    b = table(spark, d, "bioportal").filter("cui is not null").select("cui", F.regexp_extract(low, "([0-9]+) (hour|day|week|month|year)", 1).try_cast("double").alias("n"), F.regexp_extract(low, "([0-9]+) (hour|day|week|month|year)", 2).alias("unit"))
    weeks = F.expr(_WEEKS)
    w = b.filter("n is not null").select("cui", F.when(weeks < 4, "under 4 weeks").when(weeks < 26, "under 26 weeks").when(weeks < 52, "under 52 weeks").otherwise("longer").alias("span"))
    top = w.groupBy("cui").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cui").limit(50)
    top = top.select("cui", F.row_number().over(Window.orderBy(F.desc("n"), "cui")).alias("place"))  # fifty rows
    p = w.join(F.broadcast(top), "cui").groupBy("span").pivot("place", list(range(1, 51))).agg(F.count(F.lit(1)))
    return p.select("span", *[F.coalesce(str(i), F.lit(0)).alias(f"c{i}") for i in range(1, 51)])


@query(
    f"with {_GRAMS}, {_NEST}, {_LEX}, top as (select * from cval order by cvalue desc, gram limit 300), asked as (select gram from top), {_OWN}, best as (select phrase, max((boosted, score)) as a, max((boosted, score)) filter (where contains(sab, 'LAY')) as b from m group by phrase) "
    "select gram, tf, df, round(log2(1 + df * log2(1 + tf / sqrt((select count(*) from documents where text is not null)))), 6) as tfdf, round(cvalue, 6) as cvalue, round(coalesce(a[2], 0), 4) as umls_score, round(coalesce(b[2], 0), 4) as chv_score from top left join best on best.phrase = top.gram"
)
def ngram_scored(spark: SparkSession, d: str) -> DataFrame:
    """The grams of highest C-value with all that is computed once they are counted: tf-df, C-value and concept scores."""
    docs = _texts(spark, d)
    f = N.c_value(N.nesting(N.ngram_frequencies(docs, "doc_id", "text").filter("tf >= 2")))
    top = cut(N.tf_df(f.orderBy(F.desc("cvalue"), "gram").limit(300), docs.count()))
    best = cut(L.best_pair(L.lookup(top, _lexicon(spark, d), "gram")).withColumnRenamed("phrase", "gram"))
    out = meet(top, best, ["gram"], "left")
    score = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c)
    return out.select("gram", "tf", "df", F.round("tfdf", 6).alias("tfdf"), F.round("cvalue", 6).alias("cvalue"), score("umls_score"), score("chv_score"))


_ORDERS = {"tf": "tf", "tfdf": "log2(1 + df * log2(1 + tf / sqrt((select count(*) from documents where text is not null))))", "cvalue": "cvalue"}


@query(f"with {_GRAMS}, {_NEST} " + " union all ".join(f"select * from (select '{k}' as by_, gram, round(v, 6) as v from (select gram, cast({e} as double) as v from cval) order by v desc, gram limit 100)" for k, e in _ORDERS.items()))
def ngram_top_by(spark: SparkSession, d: str) -> DataFrame:
    """The hundred grams that lead by frequency, by tf-df and by C-value."""
    docs = _texts(spark, d)
    f = cut(N.tf_df(N.c_value(N.nesting(N.ngram_frequencies(docs, "doc_id", "text").filter("tf >= 2"))), docs.count()))
    out = None
    for k in _ORDERS:
        one = f.select(F.lit(k).alias("by_"), "gram", F.round(F.col(k).cast("double"), 6).alias("v"), F.col(k).cast("double").alias("full")).orderBy(F.desc("full"), "gram").limit(100).drop("full")
        out = one if out is None else out.unionByName(one)
    return out


_CAND = f"""
p0 as (select id as key, unnest(string_split(org_str, ';')) as p from bioportal where org_str is not null), p1 as (select key, {_NORM('p')} as low from p0 where trim(p) <> ''),
p2 as (select key, low as p from p1 union all select key, case when i = len(l) then l[i] else l[i] || ' ' || string_split(low, ' ')[-1] end from (select key, low, l, unnest(generate_series(1, len(l))) as i from (select key, low, string_split_regex(low, ' (and|or) ') as l from p1) where len(l) > 1)),
p3 as (select key, {_WORDS('p')} as w from p2), p4 as (select key, w, array_to_string(list_transform(w, lambda w: {_POS}), '') as t from p3),
p5 as (select distinct key, w[greatest(len(w) - 6, 1) :] as w from (select key, w[length(regexp_extract(t, '^([TD]*)', 1)) + 1 : len(w) - length(regexp_extract(t, '([^NG]*)$', 1))] as w from p4) where len(w) > 0),
st as (select key, w, len(w) as n, i, unnest(generate_series(i, len(w))) as j from (select key, w, unnest(generate_series(1, len(w))) as i from p5)),
c0 as (select key, array_to_string(w[i : j], ' ') as candidate, case when i = 1 and j = n then 0 when j = n then 1 else 2 end as rank, j - i + 1 as width, 0 as skipped from st where j > i or n = 1
  union all select key, w[i] || ' ' || w[-1], 3, 2, len(w) - i - 1 from (select key, w, unnest(generate_series(1, len(w))) as i from p5) where i < len(w) - 1),
cand as (select key, candidate, min((rank, width, skipped)) as b from c0 group by key, candidate)
"""


@query(f"with {_CAND} select key, candidate, cast(b[1] as int) as rank, cast(b[2] as int) as width, cast(b[3] as int) as skipped from cand")
def concept_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What to look up for each term: the whole, its suffixes, stretches, modifiers with the head, conjuncts."""
    return S.candidates(table(spark, d, "bioportal"), "id", "org_str")


@query(
    f"with {_LEX}, {_CAND}, held as (select key, candidate, b[1] as rank, b[2] as width, cui from cand join (select distinct norm, cui from lex) l on l.norm = candidate), best as (select key, min((rank, -width)) as m from held group by key), "
    "res as (select distinct held.key, cui from held join best on best.key = held.key and (rank, -width) = m), ty as (select distinct cui, tui from content_tag where tui is not null and cui is not null), f as (select distinct key, res.cui, coalesce(tui, '-') as tui from res left join ty on ty.cui = res.cui) "
    "select b.id, coalesce(f.cui, 'none') as cui, coalesce(f.tui, 'none') as tui from bioportal b left join f on f.key = b.id"
)
def criteria_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts and types of each term by its nearest candidate, a placeholder for terms without any."""
    b = table(spark, d, "bioportal")
    found = S.resolve(S.candidates(b, "id", "org_str"), _lexicon(spark, d)).select("key", "cui").distinct()
    types = table(spark, d, "content_tag").filter("tui is not null and cui is not null").select("cui", "tui").distinct()
    typed = found.join(types, "cui", "left").select(F.col("key").alias("id"), "cui", F.coalesce("tui", F.lit("-")).alias("tui"))
    return S.fan_out(b.select("id"), typed, "id")


@query(
    f"with {_GRAMS}, known as (select gram from freq where tf >= 50), o as (select occ.gram, w, i from occ join known using (gram) join tok on tok.doc_id = occ.doc_id and tok.sid = occ.sid), t as (select gram, unnest(w[greatest(i - 10, 1) : i + 10]) as w from o) "
    f"select gram, {_POS} as tag, count(*) as n from t group by 1, 2"
)
def context_tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the ten words on either side of the places of frequent grams, their own included."""
    docs = _texts(spark, d)
    occ = cut(N.ngram_occurrences(docs, "doc_id", "text"))
    known = cut(occ.groupBy("gram").agg(F.count("*").alias("tf")).filter("tf >= 50").select("gram"))
    at = meet(occ, known, ["gram"]).select("doc_id", "seg", "start", "gram").join(N.phrase_rows(docs, "doc_id", "text"), ["doc_id", "seg"])
    first = F.greatest(F.col("start") - 10, F.lit(1))
    near = at.select("gram", F.explode(F.slice("tokens", first, F.col("start") + 11 - first)).alias("w"))
    return near.groupBy("gram", "w").agg(F.count("*").alias("c")).groupBy("gram", X.pos_tag(F.col("w")).alias("tag")).agg(F.sum("c").alias("n"))


_PAIR = f"(select w, unnest(generate_series(1, len(w) - 1)) as i from (select regexp_extract_all(lower(text), '{_WORD}') as w from documents where text is not null) where len(w) > 1)"
_TAG = lambda c: _POS.replace("when w in", f"when {c} in").replace("regexp_matches(w,", f"regexp_matches({c},")


@query(
    f"with p as (select w[i] as a, w[i + 1] as b from {_PAIR}), v as (select w, count(*) as n from (select unnest(regexp_extract_all(lower(text), '{_WORD}')) as w from documents where text is not null) group by w having count(*) >= 50), "
    f"r as (select a, b, {_TAG('a')} || {_TAG('b')} as rel from p where a in (select w from v) and b in (select w from v)) select head, dependent, rel, count(*) as n from (select b as head, a as dependent, rel from r where rel in ('AN', 'NN', 'GN') union all select a, b, rel || 'I' from r where rel in ('AN', 'NN', 'GN')) group by 1, 2, 3"
)
def dependency_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Modifier and head by neighbouring words, of listed relations and a vocabulary, in both directions."""
    t = _texts(spark, d).select(X.phrase_tokens(F.lower("text")).alias("w")).filter(F.size("w") > 1)
    v = cut(t.select(F.explode("w").alias("a")).groupBy("a").agg(F.count("*").alias("n")).filter("n >= 50").select("a"))
    pairs = t.select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).select("p.*")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("rel", F.concat(X.pos_tag(F.col("a")), X.pos_tag(F.col("b")))).filter(F.col("rel").isin("AN", "NN", "GN"))
    held = meet(meet(pairs, v, ["a"]), v.withColumnRenamed("a", "b"), ["b"])
    both = F.array(F.struct(F.col("b").alias("head"), F.col("a").alias("dependent"), F.col("rel").alias("rel")), F.struct(F.col("a").alias("head"), F.col("b").alias("dependent"), F.concat("rel", F.lit("I")).alias("rel")))
    return held.select(F.explode(both).alias("x"), "n").select("x.*", "n")


@query(f"select w as token, {_LEMMA} as norm, count(*) as n from (select unnest(regexp_extract_all(lower(text), '{_WORD}')) as w from documents where text is not null) group by 1, 2")
def token_norm_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Words with their lemma, as embeddings are trained on."""
    t = _texts(spark, d).select(F.explode(X.phrase_tokens(F.lower("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.select("token", X.lemma(F.col("token")).alias("norm"), "n")


@query(f"with recursive {_SENT} select doc_id, sent, array_to_string(list_transform(list_filter({_WORDS('s')}, lambda w: w not in ({_STOP})), lambda w: case when {_POS} = 'N' then {_LEMMA} else w end || '_' || {_POS}), ' ') as s from rows")
def criteria_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the trials as words with tags, nouns as lemmas, stop words and punctuation dropped."""
    w = F.filter(X.word_array(X.normalize(F.col("s"))), lambda x: ~x.isin(*X.STOP_WORDS))
    return _rows(spark, d).select("doc_id", "sent", F.array_join(F.transform(w, lambda x: F.concat(F.when(X.pos_tag(x) == "N", X.lemma(x)).otherwise(x), F.lit("_"), X.pos_tag(x))), " ").alias("s"))
