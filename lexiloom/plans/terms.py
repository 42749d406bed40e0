"""Text functions and n-gram statistics over the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import ngrams as N
from ..runtime import cut, table
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_PUNCT = "[!-/:-@\\[-`{-~]"
_NORM = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '{_PUNCT}', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = lambda c: f"list_filter(string_split({_NORM(c)}, ' '), lambda w: w <> '')"
_WORD = "[\\p{L}\\p{N}][\\p{L}\\p{N}''-]*"
_GRAMS = f"""
seg as (select doc_id, unnest(l) as s, generate_subscripts(l, 1) as sid from (select doc_id, string_split_regex(lower(text), '[.?!]\\s+|\\n+|[,;/:()\\[\\]{{}}"]+') as l from documents where text is not null)),
tok as (select doc_id, regexp_extract_all(s, '{_WORD}') as w, sid from seg),
pos as (select doc_id, sid, w, unnest(generate_series(1, len(w))) as i from tok where len(w) > 0),
span as (select doc_id, sid, w, i, unnest([1, 2, 3]) as n from pos),
occ as (select doc_id, sid, i, n, array_to_string(w[i : i + n - 1], ' ') as gram from span where i + n - 1 <= len(w) and w[i] not in ({_STOP}) and w[i + n - 1] not in ({_STOP})),
freq as (select gram, n, count(*) as tf, count(distinct doc_id) as df from occ group by gram, n)
"""
_NEST = """
g2 as (select gram, n, tf, df from freq where tf >= 2),
sp as (select gram, n, tf, string_split(gram, ' ') as w from g2 where n > 1),
s1 as (select gram, n, tf, w, unnest(generate_series(1, n - 1)) as k from sp),
s2 as (select gram, n, tf, w, k, unnest(generate_series(1, n - k + 1)) as i from s1),
subs as (select distinct gram as holder, tf, array_to_string(w[i : i + k - 1], ' ') as gram from s2),
inside as (select gram, sum(tf) as nested_tf, count(*) as containers from subs group by gram),
nest as (select g2.*, coalesce(nested_tf, 0) as nested_tf, coalesce(containers, 0) as containers from g2 left join inside using (gram)),
cval as (select gram, n, tf, df, cast(nested_tf as bigint) as nested_tf, containers, greatest(log2(1 + n) * (case when containers = 0 then tf else tf - nested_tf // greatest(containers, 1) end), 0.0) as cvalue from nest)
"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", "text")


@query(f"select doc_id, {_NORM('text')} as norm, length(regexp_replace(text, '[^\\x20-\\x7e\\t\\r\\n]', '', 'g')) as printable, length(regexp_replace(text, '[^\\x00-\\x7f]+', ' ', 'g')) as plain from documents where text is not null")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", X.normalize(F.col("text")).alias("norm"), F.length(X.printable(F.col("text"))).cast("bigint").alias("printable"), F.length(X.ascii_runs(F.col("text"))).cast("bigint").alias("plain"))


@query(f"select id, array_to_string(list_sort({_WORDS('org_str')}), ' ') as ordered from bioportal where org_str is not null")
def text_sort_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bioportal").filter("org_str is not null").select("id", X.sort_words(X.normalize(F.col("org_str"))).alias("ordered"))


@query("select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as bigint) as sent, s from (select doc_id, unnest(l) as s, generate_subscripts(l, 1) as i from (select doc_id, list_filter(string_split_regex(text, '[.?!]\\s+|\\n+'), lambda x: trim(x) <> '') as l from documents where text is not null))")
def sentence_explode(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sent", "s"))
    return t.select("doc_id", F.col("sent").cast("bigint").alias("sent"), "s")


@query(f"with {_GRAMS} select gram, cast(n as bigint) as n, tf, df from freq where tf >= 5")
def ngram_tf_df(spark: SparkSession, d: str) -> DataFrame:
    return N.ngram_frequencies(_texts(spark, d), "doc_id", "text").filter("tf >= 5").select("gram", F.col("n").cast("bigint").alias("n"), "tf", "df")


@query(f"with {_GRAMS} select gram, round(log2(1 + df * log2(1 + tf / sqrt((select count(*) from documents where text is not null)))), 6) as tfdf from freq where tf >= 5")
def ngram_tfdf(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d)
    f = N.ngram_frequencies(docs, "doc_id", "text").filter("tf >= 5")
    return N.tf_df(f, docs.count()).select("gram", F.round("tfdf", 6).alias("tfdf"))


@query(f"with {_GRAMS}, {_NEST} select gram, tf, df, nested_tf, containers, round(cvalue, 6) as cvalue from cval order by cvalue desc, gram limit 200")
def ngram_cvalue_topk(spark: SparkSession, d: str) -> DataFrame:
    f = cut(N.ngram_frequencies(_texts(spark, d), "doc_id", "text").filter("tf >= 2"))
    c = N.c_value(N.nesting(f)).orderBy(F.desc("cvalue"), "gram").limit(200)
    return c.select("gram", "tf", "df", "nested_tf", "containers", F.round("cvalue", 6).alias("cvalue"))


@query(f"with {_GRAMS} select gram, tf, row_number() over (order by tf desc, gram) - 1 as idx from freq where tf >= 10 order by tf desc, gram limit 10000")
def bow_vocab_index(spark: SparkSession, d: str) -> DataFrame:
    return N.vocabulary(N.ngram_frequencies(_texts(spark, d), "doc_id", "text"), 10, 10_000)


@query(
    f"with {_GRAMS}, known as (select gram from freq where df >= 30 and n = 1), term as (select doc_id, sid, i as t_start from occ join known using (gram)), "
    "place as (select o.doc_id, o.sid, o.i, o.n, o.gram, count(*) filter (where abs(t_start - o.i) <= 10 and (t_start < o.i or t_start >= o.i + o.n)) as inside, "
    "least(coalesce(min(case when t_start < o.i or t_start >= o.i + o.n then abs(t_start - o.i) end), 10), 10) as nearest from occ o left join term t on t.doc_id = o.doc_id and t.sid = o.sid group by 1, 2, 3, 4, 5) "
    "select gram, count(*) as places, cast(sum(inside) as bigint) as neighbours, cast(sum(nearest) as bigint) as distance from place group by gram having count(*) >= 3"
)
def context_window_counts(spark: SparkSession, d: str) -> DataFrame:
    occ = cut(N.ngram_occurrences(_texts(spark, d), "doc_id", "text"))
    known = occ.filter("n = 1").groupBy("gram").agg(F.count_distinct("doc_id").alias("df")).filter("df >= 30")
    return N.context_counts(occ, known).filter("places >= 3")


@query("select w[1:1] as first, count(*) as n from (select string_split(ngram, ' ') as w from k20all where ngram is not null) group by 1".replace("w[1:1]", "w[1]"))
def first_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "k20all").filter("ngram is not null").select(F.split("ngram", " ")[0].alias("first")).groupBy("first").agg(F.count("*").alias("n"))


@query(
    "select capital, count(*) as n from (select case when regexp_matches(org_str, '^[A-Z0-9 -]*[A-Z][A-Z0-9 -]*$') then 'all' when regexp_matches(org_str, '^([A-Z][^ ]*)( [A-Z][^ ]*)*$') then 'term' when regexp_matches(org_str, '^[A-Z]') then 'first' else 'none' end as capital from bioportal where org_str is not null) group by 1"
)
def capitalization_profile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bioportal").filter("org_str is not null").select(X.capital_class(F.col("org_str")).alias("capital")).groupBy("capital").agg(F.count("*").alias("n"))


def _affix_sql(word: str, affixes: tuple[str, ...], suffix: bool) -> str:
    ordered = sorted(affixes, key=lambda a: (-len(a), a))
    f = "ends_with" if suffix else "starts_with"
    return "coalesce(" + ", ".join(f"case when {f}({word}, '{a}') then '{a}' end" for a in ordered) + ")"


@query(
    f"select kind, affix, count(*) as n from (select 'prefix' as kind, {_affix_sql('w', X.PREFIXES, False)} as affix from (select unnest({_WORDS('ngram')}) as w from (select distinct ngram from k20all where ngram is not null)) "
    f"union all select 'suffix', {_affix_sql('w', X.SUFFIXES, True)} from (select unnest({_WORDS('ngram')}) as w from (select distinct ngram from k20all where ngram is not null))) where affix is not null group by 1, 2"
)
def affix_histogram(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "k20all").filter("ngram is not null").select("ngram").distinct().select(F.explode(X.word_array(X.normalize(F.col("ngram")))).alias("w"))
    both = w.select(F.explode(F.array(F.struct(F.lit("prefix").alias("kind"), X.affix(F.col("w"), X.PREFIXES, False).alias("affix")), F.struct(F.lit("suffix").alias("kind"), X.affix(F.col("w"), X.SUFFIXES, True).alias("affix")))).alias("x"))
    return both.select("x.*").filter("affix is not null").groupBy("kind", "affix").agg(F.count("*").alias("n"))


@query(
    f"select doc_id, len(w) as words, len(list_filter(w, lambda x: x in ({_STOP}))) as stops, len(list_distinct(w)) as kinds from (select doc_id, {_WORDS('text')} as w from documents where text is not null)"
)
def delimiter_stop_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", X.word_array(X.normalize(F.col("text"))).alias("w"))
    return t.select("doc_id", F.size("w").cast("bigint").alias("words"), F.size(F.filter("w", lambda x: x.isin(*X.STOP_WORDS))).cast("bigint").alias("stops"), F.size(F.array_distinct("w")).cast("bigint").alias("kinds"))


_POS = (
    "case when w in ('of','in','on','at','by','for','with','from','to','into','over','under','about') then 'P' when w in ('the','a','an','this','that','these','those') then 'T' "
    "when w in ('i','you','he','she','it','we','they','me','him','her','us','them','my','your','his','its','our','their') then 'U' when w in ('and','or','but','nor','yet') then 'E' "
    "when w in ('can','could','will','would','should','may','might','must','shall') then 'M' when w in ('is','are','was','were','be','been','am','has','have','had','do','does','did') then 'V' "
    "when regexp_matches(w, '^[0-9]+$') then 'D' when regexp_matches(w, 'ly$') then 'R' when regexp_matches(w, 'ing$') then 'G' when regexp_matches(w, 'ed$') then 'V' "
    "when regexp_matches(w, '(ous|ful|ive|able|ible|al|ic|ish|less)$') then 'A' else 'N' end"
)


@query(f"select pos, count(*) as n from (select {_POS} as pos from (select unnest({_WORDS('text')}) as w from documents where text is not null)) group by pos")
def pos_collapse_counts(spark: SparkSession, d: str) -> DataFrame:
    w = _texts(spark, d).select(F.explode(X.word_array(X.normalize(F.col("text")))).alias("w"))
    return w.select(X.pos_tag(F.col("w")).alias("pos")).groupBy("pos").agg(F.count("*").alias("n"))


@query(
    "select p, cast(s as bigint) as seconds, cast(case when s < 0 then -1 else floor(s / (30.58333 * 86400) + 0.5) end as bigint) as months from (values ('P1Y', 366 * 86400), ('P1M', 31 * 86400), ('P6M', 182 * 86400), ('P2W', 14 * 86400), ('P10D', 10 * 86400), ('PT12H', 43200), ('PXD', -1), ('soon', -1)) v(p, s)"
)
def duration_parse(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(p,) for p in ("P1Y", "P1M", "P6M", "P2W", "P10D", "PT12H", "PXD", "soon")], "p string")
    s = X.period_seconds(F.col("p"))
    return t.select("p", s.alias("seconds"), X.to_months(s).alias("months"))


@query(
    "select rel, count(*) as n from (select w[i] || '>' || w[i + 1] as rel from (select w, unnest(generate_series(1, len(w) - 1)) as i from (select regexp_extract_all(lower(text), '" + _WORD + "') as w from documents where text is not null) where len(w) > 1) "
    "union all select w[i + 1] || '<' || w[i] from (select w, unnest(generate_series(1, len(w) - 1)) as i from (select regexp_extract_all(lower(text), '" + _WORD + "') as w from documents where text is not null) where len(w) > 1)) group by rel having count(*) >= 20"
)
def pair_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Word contexts in both directions for embeddings, from neighbouring words in place of parses."""
    t = _texts(spark, d).select(X.phrase_tokens(F.lower("text")).alias("w")).filter(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.array(F.concat(F.get("w", i), F.lit(">"), F.get("w", i + 1)), F.concat(F.get("w", i + 1), F.lit("<"), F.get("w", i))))
    return t.select(F.explode(F.flatten(pairs)).alias("rel")).groupBy("rel").agg(F.count("*").alias("n")).filter("n >= 20")


@query("select tok, count(*) as n from (select unnest(regexp_extract_all(lower(text), '" + _WORD + "')) as tok from documents where text is not null) group by tok having count(*) >= 10")
def token_norm_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null").select(F.explode(X.phrase_tokens(F.lower("text"))).alias("tok"))
    return t.groupBy("tok").agg(F.count("*").alias("n")).filter("n >= 10")
