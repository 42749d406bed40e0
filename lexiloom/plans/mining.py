"""Predicates, small functions, windows and sets of the concept, criteria and term tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import lexicon as L
from ..operators import ngrams as N
from ..operators import relational as R
from ..operators import suggestions as S
from ..operators.criteria import BULLET
from ..operators.ordering import prefix_sums, running_number
from ..runtime import cut, meet, table
from .concepts import _LEX, _LOOK, _LEMMA, _W, _lexicon, _matches
from .registry import query
from .terms import _GRAMS, _NEST, _NORM, _POS, _STOP, _WORD, _WORDS, _texts
from .trials import _EDGES, _edges

_NUMBER = r"^[+-]?[0-9]+([.][0-9]+)?$"


@query("select count(*) as n, count(*) filter (where cui = null) as equal, count(*) filter (where cui is null) as missing from content_tag")
def null_probe(spark: SparkSession, d: str) -> DataFrame:
    """A comparison with null is never true."""
    none = F.lit(None).cast("string")
    return table(spark, d, "content_tag").agg(F.count("*").alias("n"), F.count_if(F.col("cui") == none).alias("equal"), F.count_if(F.col("cui").isNull()).alias("missing"))


_TEMPLATES = {"all": {}, "source": {"sab": "LAY%"}, "both": {"sab": "LAY%", "styname": "%en%"}, "any text": {"sab": "%%"}}


@query(" union all ".join(f"select '{k}' as template, count(*) as n from content_tag where 1 = 1" + "".join(f" and {c} like '{p}'" for c, p in v.items()) for k, v in _TEMPLATES.items()))
def template_filter(spark: SparkSession, d: str) -> DataFrame:
    """Parameterised filters: a predicate that is not given is left out, one that matches any text still drops nulls."""
    t, out = table(spark, d, "content_tag"), None
    for name, given in _TEMPLATES.items():
        one = R.where_given(t, given).agg(F.lit(name).alias("template"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select cui, count(*) as n from content_tag where sab = 'LAYVOC' and score >= cast(0.9 as float) group by cui")
def session_variable(spark: SparkSession, d: str) -> DataFrame:
    """A statement with named parameters in place of session variables."""
    return spark.sql("select cui, count(*) as n from {t} where sab = :source and score >= cast(:least as float) group by cui", args={"source": "LAYVOC", "least": 0.9}, t=table(spark, d, "content_tag"))


@query(
    f"select ngram, case when max(chv_score) > 5 then 'chv' when max(umls_score) > 40 then 'umls' else 'other' end as kind from k20all where regexp_matches(trim(cvalue), '{_NUMBER}') and try_cast(cvalue as double) > 5 and umls_score > 20 and chv_score > 2 "
    "and not coalesce(regexp_full_match(sytax, 'N?P.*|.*P'), false) group by ngram"
)
def stage_score_filter(spark: SparkSession, d: str) -> DataFrame:
    """Terms beyond three scores, each strictly, whose tags no reject pattern matches whole, labelled by what they pass."""
    t = table(spark, d, "k20all").filter(F.trim("cvalue").rlike(_NUMBER) & (F.col("cvalue").try_cast("double") > 5) & (F.col("umls_score") > 20) & (F.col("chv_score") > 2) & ~F.coalesce(F.col("sytax").rlike("^(?:N?P.*|.*P)$"), F.lit(False)))
    return t.groupBy("ngram").agg(F.when(F.max("chv_score") > 5, "chv").when(F.max("umls_score") > 40, "umls").otherwise("other").alias("kind"))


@query(f"with {_LEX}, {_LOOK} select phrase, cui, sab, descr, round(score, 4) as score from m where regexp_full_match(sab, 'LAYVOC|CLIN.*') and not regexp_full_match(array_to_string(list_sort({_W(_NORM('descr'))}), ' '), '(cough|liver).*')")
def match_filter(spark: SparkSession, d: str) -> DataFrame:
    """Matches of sources that a pattern matches whole, but for sorted strings that another one does."""
    ordered = X.sort_words(X.normalize(F.col("descr")))
    return _matches(spark, d).filter(F.col("sab").rlike("^(?:LAYVOC|CLIN.*)$") & ~ordered.rlike("^(?:(?:cough|liver).*)$")).select("phrase", "cui", "sab", "descr", F.round("score", 4).alias("score"))


@query(f"select distinct cui, lower(target) as phrase, tui from content_tag where cui is not null and score >= cast(0.9 as float) and lower(target) not in ({_STOP}) and semname in ('Ill Health', 'Care')")
def concept_filter(spark: SparkSession, d: str) -> DataFrame:
    """Findings of a least score, no stop words, of one of the allowed groups of types."""
    t = table(spark, d, "content_tag").filter(F.col("cui").isNotNull() & (F.col("score") >= F.lit(0.9).cast("float")) & ~F.lower("target").isin(*X.STOP_WORDS) & F.col("semname").isin("Ill Health", "Care"))
    return t.select("cui", F.lower("target").alias("phrase"), "tui").distinct()


@query("select id, pos, part from (select id, cast(generate_subscripts(l, 1) as bigint) as pos, unnest(l) as part from (select id, list_transform(string_split(sentence, ';'), lambda x: trim(x)) as l from bioportal where sentence is not null)) where length(part) - length(replace(part, ' ', '')) between 1 and 12")
def short_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of sentences between semicolons, of few spaces."""
    t = table(spark, d, "bioportal").filter("sentence is not null").select("id", F.posexplode(F.split("sentence", ";")).alias("p", "part"))
    t = t.select("id", (F.col("p") + 1).cast("bigint").alias("pos"), F.trim("part").alias("part"))
    return t.filter((F.length("part") - F.length(F.replace("part", F.lit(" "), F.lit("")))).between(1, 12))


_SUGGEST = "sg as (select lower(target) as phrase, cui, tui, max(cast(score as double) * 100) as score from content_tag where target is not null and cui is not null and tui is not null group by 1, 2, 3)"


def _suggestions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "content_tag").filter("target is not null and cui is not null and tui is not null")
    return t.groupBy(F.lower("target").alias("phrase"), "cui", "tui").agg(F.max(F.col("score").cast("double") * 100).alias("score"))


@query(f"with {_SUGGEST}, r as (select *, row_number() over (partition by phrase, tui order by score desc, cui) as rn from sg) select phrase, tui, cui, round(score, 4) as score from r where rn = 1")
def best_per_type(spark: SparkSession, d: str) -> DataFrame:
    """The best concept of each type that a phrase is taken for."""
    return S.best_per_type(_suggestions(spark, d)).select("phrase", "tui", "cui", F.round("score", 4).alias("score"))


_RULES = "ty as (select distinct tui, semname from content_tag where tui is not null and semname is not null), ru as (select distinct a.tui as tui, b.tui as over_ from ty a join ty b on a.semname = b.semname and b.tui < a.tui union select distinct a.tui, 'T901' from ty a where a.tui in ('T902', 'T931', 'T932'))"


@query(
    f"with {_SUGGEST.replace('lower(target) as phrase', 'split_part(lower(target), chr(32), 1) as phrase')}, {_RULES}, one as (select *, exists (select 1 from sg o join ru on ru.over_ = o.tui where o.phrase = sg.phrase and o.cui = sg.cui and ru.tui = sg.tui) as m1 from sg), "
    "two as (select *, not m1 and tui <> min(tui) filter (where not m1) over (partition by phrase, cui) as m4 from one), lf as (select * from two where not m1 and not m4), "
    "three as (select *, not m1 and not m4 and exists (select 1 from lf o join ru on ru.over_ = o.tui where o.phrase = two.phrase and o.cui <> two.cui and ru.tui = two.tui) as m2 from two), "
    "win as (select phrase, arg_min(cui, (-floor(score), cui)) as winner from three where not m1 and not m4 and not m2 group by phrase) "
    "select t.phrase, cui, tui, case when m1 then 1 else 0 end + case when m4 then 4 else 0 end + case when m2 then 2 else 0 end + case when not m1 and not m4 and not m2 and cui <> winner then 8 else 0 end as mask from three t left join win w on w.phrase = t.phrase"
)
def type_preference_mask(spark: SparkSession, d: str) -> DataFrame:
    """Concepts suggested for a first word, and why rules of type, order and score put each aside; 0 remains."""
    t = table(spark, d, "content_tag").filter("target is not null and cui is not null and tui is not null")
    s = t.groupBy(F.split(F.lower("target"), " ")[0].alias("phrase"), "cui", "tui").agg(F.max(F.col("score").cast("double") * 100).alias("score"))
    types = cut(table(spark, d, "content_tag").filter("tui is not null and semname is not null").select("tui", "semname").distinct())
    other = types.select(F.col("tui").alias("b"), "semname")
    rules = types.join(other, "semname").filter("b < tui").select(F.col("tui").alias("a"), "b", F.col("b").alias("preferred"))
    more = types.filter(F.col("tui").isin("T902", "T931", "T932")).select(F.col("tui").alias("a"), F.lit("T901").alias("b"), F.lit("T901").alias("preferred"))
    return S.preference_masks(s, rules.unionByName(more)).select("phrase", "cui", "tui", "mask")


@query("select blogid, cast((rn - 1) // 100 as bigint) as block, string_agg(target, '|' order by id) as tags from (select blogid, id, target, row_number() over (partition by blogid order by id) as rn from content_tag where target is not null and blogid is not null) group by 1, 2")
def blog_tag_collection(spark: SparkSession, d: str) -> DataFrame:
    """The findings of a post in order, a hundred in a row, so that a large post makes many rows."""
    t = table(spark, d, "content_tag").filter("target is not null and blogid is not null").select("blogid", "id", "target", F.lit(1).alias("one"))
    t = prefix_sums(t, "blogid", ["id"], ["one"]).withColumn("block", F.floor((F.col("pre_one") - 1) / 100))
    tags = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "target"))), lambda x: x["target"]), "|")
    return t.groupBy("blogid", "block").agg(tags.alias("tags"))


@query("select distinct ngram from k20all where type = 'train' and ngram is not null order by ngram limit 300")
def take_grams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "k20all").filter("type = 'train' and ngram is not null").select("ngram").distinct().orderBy("ngram").limit(300)


@query(
    "with u as (select cui, sab, umlsflag from content_tag union all select cui, sab, umlsflag from content_tag_compare_only_our) select cui, array_to_string(list_sort(list_distinct(list(sab))), '|') as sources, bool_or(coalesce(umlsflag = 'Y', false)) as known from u where cui is not null group by cui"
)
def source_union(spark: SparkSession, d: str) -> DataFrame:
    """Sources of a concept in both tables as one set, flags by OR."""
    u = None
    for t in ("content_tag", "content_tag_compare_only_our"):
        one = table(spark, d, t).filter("cui is not null").groupBy("cui").agg(F.collect_set("sab").alias("s"), F.bool_or(F.coalesce(F.col("umlsflag") == "Y", F.lit(False))).alias("k"))
        u = one if u is None else u.join(one.select("cui", F.col("s").alias("s2"), F.col("k").alias("k2")), "cui", "full")
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("s", none), F.coalesce("s2", none)))
    return u.select("cui", F.array_join(both, "|").alias("sources"), (F.coalesce("k", F.lit(False)) | F.coalesce("k2", F.lit(False))).alias("known"))


@query("select distinct ngram, regexp_matches(sytax, '[AP]') as held, case when nn = 'true' then 'T' else 'F' end as letter, case when nn = 'true' then 1 else 0 end as number, case when nn = 'true' then 1.0 else 0.0 end as real from k20all where ngram is not null and sytax is not null")
def tag_inclusion(spark: SparkSession, d: str) -> DataFrame:
    """Whether any of the listed tags stands in a term, and a flag as letter, number and real."""
    t = table(spark, d, "k20all").filter("ngram is not null and sytax is not null")
    yes = F.coalesce(F.col("nn") == "true", F.lit(False))
    held = F.arrays_overlap(F.filter(F.split("sytax", ""), lambda x: x != ""), F.array(F.lit("A"), F.lit("P")))
    return t.select("ngram", held.alias("held"), F.when(yes, "T").otherwise("F").alias("letter"), yes.cast("int").alias("number"), yes.cast("double").alias("real")).distinct()


@query(
    f"select ngram, tags, regexp_full_match(tags, '.*N.*N.*') as nn, regexp_full_match(tags, '.*A.*N.*') as an, regexp_full_match(tags, '.*P.*N.*') as pn, regexp_full_match(tags, '((A|N)+|((A|N)*(NP)?)(A|N)*)N') as anpn "
    f"from (select ngram, array_to_string(list_transform({_WORDS('ngram')}, lambda w: {_POS}), '') as tags from (select distinct ngram from k20all where ngram is not null))"
)
def tag_pattern_flags(spark: SparkSession, d: str) -> DataFrame:
    """Patterns that the tags of a term follow."""
    t = table(spark, d, "k20all").filter("ngram is not null").select("ngram").distinct()
    t = t.withColumn("tags", F.array_join(F.transform(X.word_array(X.normalize(F.col("ngram"))), X.pos_tag), ""))
    flags = {"nn": ".*N.*N.*", "an": ".*A.*N.*", "pn": ".*P.*N.*", "anpn": "((A|N)+|((A|N)*(NP)?)(A|N)*)N"}
    return t.select("ngram", "tags", *[F.col("tags").rlike(f"^(?:{p})$").alias(k) for k, p in flags.items()])


@query("select a.target, b.org_str from (select distinct target from content_tag where target is not null) a join (select distinct org_str from bioportal where org_str is not null) b on strip_accents(lower(a.target)) = strip_accents(lower(b.org_str))")
def collation_join(spark: SparkSession, d: str) -> DataFrame:
    """Strings that are equal but for case and accents."""
    fold = lambda c: F.collate(c, "UNICODE_CI_AI")
    a = table(spark, d, "content_tag").filter("target is not null").select("target").distinct().withColumn("k", fold("target"))
    b = table(spark, d, "bioportal").filter("org_str is not null").select("org_str").distinct().withColumn("k", fold("org_str"))
    return a.join(b, "k").select("target", "org_str")


@query(f"with {_LEX}, {_LOOK}, n as (select *, levenshtein(lower(phrase), lower(descr)) as dist, row_number() over (partition by phrase order by levenshtein(lower(phrase), lower(descr)), cui, descr) as rn from m) select phrase, cui, descr, cast(dist as bigint) as distance from n where rn = 1")
def nearest_concept(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest_concept(_matches(spark, d)).select("phrase", "cui", "descr", F.col("distance").cast("bigint").alias("distance"))


_SPAN = "select distinct blogid, sentenceindex, target, wordindexinsentence as b, wordindexinsentence + len(string_split(target, ' ')) - 1 as e from {t} where target <> '' and wordindexinsentence is not null"


@query(
    f"with x as ({_SPAN.format(t='content_tag')}), y as ({_SPAN.format(t='content_tag_compare_only_our')}) select distinct x.blogid, x.sentenceindex, x.target, y.target as other, x.b <= y.e and y.b <= x.e as overlap, x.b <= y.b and y.e <= x.e as holds, least(x.b, y.b) as b, greatest(x.e, y.e) as e, "
    "cast(greatest(x.e, y.e) - least(x.b, y.b) + 1 - len(string_split(x.target, ' ')) - len(string_split(y.target, ' ')) as bigint) as skipped from x join y on x.blogid = y.blogid and x.sentenceindex = y.sentenceindex"
)
def span_relations(spark: SparkSession, d: str) -> DataFrame:
    """Spans of two taggers in a sentence: whether they overlap, whether the first holds the second, the merged span and what it skips."""

    def spans(t: str) -> DataFrame:
        df = table(spark, d, t).filter("target <> '' and wordindexinsentence is not null")
        n = F.size(F.split("target", " "))
        return df.select("blogid", "sentenceindex", F.col("target"), F.col("wordindexinsentence").alias("b"), (F.col("wordindexinsentence") + n - 1).alias("e")).distinct()

    x, y = spans("content_tag"), spans("content_tag_compare_only_our").select("blogid", "sentenceindex", F.col("target").alias("other"), F.col("b").alias("b2"), F.col("e").alias("e2"))
    j = x.join(y, ["blogid", "sentenceindex"])
    overlap, holds, b, e = X.spans_overlap("b", "e", "b2", "e2"), X.span_holds("b", "e", "b2", "e2"), *X.merge_spans("b", "e", "b2", "e2")
    skipped = X.skip_count(b, e, F.size(F.split("target", " ")) + F.size(F.split("other", " ")))
    return j.select("blogid", "sentenceindex", "target", "other", overlap.alias("overlap"), holds.alias("holds"), b.alias("b"), e.alias("e"), skipped.cast("bigint").alias("skipped")).distinct()


_TOKEN = "[\\p{L}\\p{N}][\\p{L}\\p{N}''-]*|[^\\s\\p{L}\\p{N}]"


@query(
    f"with s as (select id, unnest(l) as s, cast(generate_subscripts(l, 1) as bigint) as sent from (select id, list_filter(string_split_regex(sentence, '[.?!]\\s+|\\n+'), lambda x: trim(x) <> '') as l from bioportal where sentence is not null)), "
    f"t as (select id, sent, unnest(l) as tok, cast(generate_subscripts(l, 1) as bigint) as place from (select id, sent, regexp_extract_all(s, '{_TOKEN}') as l from s)), w as (select *, lower(tok) as w from t) select id, sent, place, tok, {_POS} as tag, {_LEMMA} as lemma, regexp_matches(tok, '^[!-/:-@\\[-`{{-~]$') as delimiter from w"
)
def token_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each sentence with tag, lemma and whether nothing but a delimiter is left of them."""
    s = table(spark, d, "bioportal").filter("sentence is not null").select("id", F.posexplode(X.sentences(F.col("sentence"))).alias("p", "s"))
    t = s.select("id", (F.col("p") + 1).cast("bigint").alias("sent"), F.posexplode(F.regexp_extract_all("s", F.lit("(" + _TOKEN.replace("''", "'") + ")"), F.lit(1))).alias("q", "tok"))
    low = F.lower("tok")
    return t.select("id", "sent", (F.col("q") + 1).cast("bigint").alias("place"), "tok", X.pos_tag(low).alias("tag"), X.lemma(low).alias("lemma"), X.is_delimiter(F.col("tok")).alias("delimiter"))


@query(
    "select doc_id, line, regexp_matches(trim(s), '^(?:[-*]\\s.*|[0-9]+\\.?\\s.*)$') as item, regexp_replace(trim(s), '^[!-/:-@\\[-`{-~\\s]*', '') as bare from (select doc_id, unnest(l) as s, cast(generate_subscripts(l, 1) as bigint) as line from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)) where trim(s) <> ''"
)
def line_marks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents: whether they are list items, and what is left without leading punctuation."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "s")).filter("trim(s) <> ''")
    return t.select("doc_id", (F.col("p") + 1).cast("bigint").alias("line"), F.trim("s").rlike(BULLET).alias("item"), F.regexp_replace(F.trim("s"), r"^[!-/:-@\[-`{-~\s]*", "").alias("bare"))


@query("select doc_id, policy, md5(case policy when 'space' then replace(text, chr(10), ' ') when 'period' then replace(text, chr(10), '. ') else text end) as h from documents, (select unnest(['space', 'period', 'none']) as policy) where text is not null")
def newline_policy(spark: SparkSession, d: str) -> DataFrame:
    """Documents under the three ways to take line ends."""
    t = table(spark, d, "documents").filter("text is not null")
    forms = F.array(*[F.struct(F.lit(k).alias("policy"), F.md5(X.newlines(F.col("text"), k)).alias("h")) for k in ("space", "period", "none")])
    return t.select("doc_id", F.explode(forms).alias("x")).select("doc_id", "x.*")


_ST = f"array_to_string(list_transform(list_filter({_W('norm')}, lambda w: w not in ({_STOP})), lambda w: {_LEMMA}), ' ')"


@query(f"select id, norm, {_ST} as stem, array_to_string(list_sort({_W(_ST)}), ' ') as ordered, norm = '' and term <> '' as only_signs from (select id, org_str as term, {_NORM('org_str')} as norm from bioportal where org_str is not null union all select -id, ', ; -', {_NORM(chr(39) + ', ; -' + chr(39))} from bioportal)")
def normalize_stages(spark: SparkSession, d: str) -> DataFrame:
    """A term normalised, stemmed and sorted, and whether it was nothing but delimiters."""
    b = table(spark, d, "bioportal")
    t = b.filter("org_str is not null").select("id", F.col("org_str").alias("term")).unionByName(b.select((-F.col("id")).alias("id"), F.lit(", ; -").alias("term")))
    norm = X.normalize(F.col("term"))
    return t.select("id", norm.alias("norm"), X.stem_words(norm).alias("stem"), X.sort_words(X.stem_words(norm)).alias("ordered"), ((norm == "") & (F.col("term") != "")).alias("only_signs"))


@query(
    f"select ngram, lower(ngram) in ({_STOP}) as whole, len(list_filter(w, lambda x: x in ({_STOP}))) > 0 as held, coalesce(w[1] in ({_STOP}) or w[-1] in ({_STOP}), false) as edge, regexp_full_match(lower(ngram), '[0-9 ]+|.{{1,2}}') as pattern from (select ngram, {_WORDS('ngram')} as w from (select distinct ngram from k20all where ngram is not null))"
)
def stop_modes(spark: SparkSession, d: str) -> DataFrame:
    """The modes of the stop-word test, and the pattern beside them."""
    t = table(spark, d, "k20all").filter("ngram is not null").select("ngram").distinct().withColumn("w", X.word_array(X.normalize(F.col("ngram"))))
    return t.select(
        "ngram", F.lower("ngram").isin(*X.STOP_WORDS).alias("whole"), F.exists("w", lambda x: x.isin(*X.STOP_WORDS)).alias("held"),
        F.when(F.size("w") > 0, F.element_at("w", 1).isin(*X.STOP_WORDS) | F.element_at("w", -1).isin(*X.STOP_WORDS)).otherwise(False).alias("edge"), F.lower("ngram").rlike("^(?:[0-9 ]+|.{1,2})$").alias("pattern"),
    )


@query("select distinct cui1 as child, cui2 as parent from content_tag_compare_only_our where cui1 is not null union select distinct aui1, aui2 from content_tag_compare_only_our where aui1 is not null")
def edges_unpacked(spark: SparkSession, d: str) -> DataFrame:
    """Edges read from strings of packed pairs, vertices without an edge too."""
    none = F.lit("null")
    packed = F.concat_ws(";", F.concat("cui1", F.lit(","), F.coalesce("cui2", none)), F.concat("aui1", F.lit(","), F.coalesce("aui2", none)))
    return G.unpack_edges(table(spark, d, "content_tag_compare_only_our").select(packed.alias("p")), "p")


_GROUPED = (
    "nodes as (select child as node from e union select parent from e), up as (select child as node, count(*) as parents from e group by 1), "
    "kinds as (select node, case when coalesce(parents, 0) = 0 then 'root' when parents = 1 then 'child' else 'new_root' end as kind from nodes left join up using (node)), "
    "w(node, pos, steps) as (select node, node, 0 from kinds where kind = 'child' union all select w.node, e.parent, w.steps + 1 from w join e on e.child = w.pos join kinds k on k.node = w.pos where k.kind = 'child' and w.steps <= (select count(*) from nodes)), "
    "got as (select w.node, w.pos as head from w join kinds k on k.node = w.pos where k.kind <> 'child'), num as (select node as head, kind, row_number() over (order by node) as group_id from kinds where kind <> 'child'), "
    "mem as (select head, count(*) as n from got group by head) select group_id, 1 + coalesce(n, 0) as members, coalesce(n, 0) as children, case when n is null and kind = 'root' then 'single' else kind end as kind from num left join mem using (head)"
)


@query(f"with recursive {_EDGES}, {_GROUPED}")
def isa_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the is-a graph by number, with their size and kind."""
    return G.group_kinds(G.group_numbers(G.group_under_roots(_edges(spark, d))))


_TYPED = "e as (select distinct coalesce(rela, '-') || '|' || cui1 as child, coalesce(rela, '-') || '|' || cui2 as parent from content_tag_compare_only_our where rel in ('PAR', 'RB') and cui1 is not null and cui2 is not null and cui1 <> cui2)"


@query(f"with recursive {_TYPED}, {_GROUPED}")
def isa_groups_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The same with one graph per kind of relation, all of them in one run."""
    t = table(spark, d, "content_tag_compare_only_our").filter("rel in ('PAR', 'RB') and cui1 <> cui2")
    name = lambda c: F.concat(F.coalesce("rela", F.lit("-")), F.lit("|"), c)
    return G.group_kinds(G.group_numbers(G.group_under_roots(t.select(name(F.col("cui1")).alias("child"), name(F.col("cui2")).alias("parent")))))


@query(f"with {_EDGES}, n as (select child, count(*) as n from e group by child) select 'cut' as form, e.child, parent from e join n using (child) where n = 1 union all select 'copy', case when n > 1 then child || '@' || parent else child end, parent from e join n using (child)")
def new_roots_split(spark: SparkSession, d: str) -> DataFrame:
    """Edges once nodes with several parents are cut off, or copied for each parent."""
    e = _edges(spark, d)
    return G.split_new_roots(e).select(F.lit("cut").alias("form"), "child", "parent").unionByName(G.split_new_roots(e, copies=True).select(F.lit("copy").alias("form"), "child", "parent"))


@query(
    f"with {_GRAMS}, first as (select gram, count(*) as tf, count(distinct doc_id) as df, min((doc_id, sid, i)) as f from occ group by gram having count(*) >= 5) "
    f"select gram, tf, df, f[1] as doc_id, cast(f[2] - 1 as bigint) as seg, cast(f[3] as bigint) as start, array_to_string(list_transform({_W('gram')}, lambda w: {_POS}), '') as tags from first"
)
def ngram_attributes(spark: SparkSession, d: str) -> DataFrame:
    """What a gram gets when it is first seen: its place and its tags."""
    f = N.first_seen(N.ngram_occurrences(_texts(spark, d), "doc_id", "text")).filter("tf >= 5")
    return f.select("gram", "tf", "df", "doc_id", F.col("seg").cast("bigint").alias("seg"), F.col("start").cast("bigint").alias("start"), "tags")


@query(
    f"with {_GRAMS}, known as (select gram, row_number() over (order by gram) as gram_id from freq where tf >= 20), o as (select occ.doc_id, sid, i, occ.n, gram, gram_id from occ join known using (gram)) "
    "select gram, cast(any_value(n) as bigint) as n, any_value(gram_id) as gram_id, count(*) as places, count(distinct doc_id) as df, cast(sum(i) as bigint) as starts from o group by gram"
)
def ngram_stage_two(spark: SparkSession, d: str) -> DataFrame:
    """Grams of the second stage: places of the grams that the first stage's dictionary holds."""
    occ = cut(N.ngram_occurrences(_texts(spark, d), "doc_id", "text"))
    known = occ.groupBy("gram").agg(F.count("*").alias("tf")).filter("tf >= 20")
    known = cut(running_number(known, [F.asc("gram")], "gram_id").select("gram", "gram_id"))
    o = meet(occ, known, ["gram"])
    return o.groupBy("gram").agg(F.max("n").cast("bigint").alias("n"), F.max("gram_id").alias("gram_id"), F.count("*").alias("places"), F.count_distinct("doc_id").alias("df"), F.sum("start").cast("bigint").alias("starts"))


_OWN = _LOOK.replace(f"ph0 as (select distinct target as phrase, {_NORM('target')} as p_norm from content_tag_compare_only_our where trim(target) <> '')", f"ph0 as (select distinct gram as phrase, {_NORM('gram')} as p_norm from asked)")
_BIO = f"seg as (select id, unnest(l) as s, generate_subscripts(l, 1) as sid from (select id, string_split_regex(lower(org_str), '[.?!]\\s+|\\n+|[,;/:()\\[\\]{{}}\"]+') as l from bioportal where org_str is not null)), tok as (select id, sid, regexp_extract_all(s, '{_WORD}') as w from seg), pos as (select id, sid, w, unnest(generate_series(1, len(w))) as i from tok where len(w) > 0), span as (select id, sid, w, i, unnest([1, 2, 3, 4, 5]) as n from pos), occ as (select id, sid, i, n, array_to_string(w[i : i + n - 1], ' ') as gram from span where i + n - 1 <= len(w) and w[i] not in ({_STOP}) and w[i + n - 1] not in ({_STOP}))"


@query(
    f"with {_LEX}, {_BIO}, asked as (select distinct gram from occ), {_OWN}, good as (select phrase, max(round(score, 4)) as score, string_agg(distinct cui, ':' order by cui) as codes from m where score > 75 group by phrase) "
    "select id, cast(row_number() over (partition by id order by sid, i, n) as bigint) as hit, gram, score, codes from occ join good on good.phrase = occ.gram"
)
def annotate_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every gram of a term that scores beyond the limit against any of the four keys, with its codes and the number of the hit."""
    a = L.annotate_scored(table(spark, d, "bioportal"), "id", "org_str", _lexicon(spark, d), 75.0)
    return a.select(F.col("doc_id").alias("id"), "hit", "gram", "score", "codes")
