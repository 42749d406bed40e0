"""Relational analytics over the concept, tag, thread and trial tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import relational as R
from ..operators.ordering import prefix_sums, running_number
from ..runtime import table
from .registry import query


@query("select sab, count(*) as n, count(cui) as n_cui, count(distinct cui) as concepts, count(distinct blogid) as blogs from content_tag group by sab")
def tag_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_tag").groupBy("sab").agg(F.count("*").alias("n"), F.count("cui").alias("n_cui"), F.count_distinct("cui").alias("concepts"), F.count_distinct("blogid").alias("blogs"))


@query("select count(*) as n from (select distinct cui, tui, sab from content_tag where cui is not null and tui is not null and sab is not null)")
def distinct_tuple_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_tag").agg(F.count_distinct("cui", "tui", "sab").alias("n"))


@query(
    "select sab, cast(count(*) filter (where cast(score as double) >= cast(0.9 as double)) as bigint) as high, cast(count(*) filter (where umlsflag = 'Y') as bigint) as known, "
    "round(count(*) filter (where cast(score as double) >= cast(0.9 as double)) / count(*), 6) as share from content_tag where sab is not null group by sab"
)
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "content_tag").filter("sab is not null")
    return t.groupBy("sab").agg(F.count_if(F.col("score").cast("double") >= 0.9).alias("high"), F.count_if(F.col("umlsflag") == "Y").alias("known"), F.round(F.count_if(F.col("score").cast("double") >= 0.9) / F.count("*"), 6).alias("share"))


@query("select (cast(score as double) > cast(0.8 as double)) as good, count(*) as n from content_tag group by 1")
def group_by_condition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_tag").groupBy((F.col("score").cast("double") > 0.8).alias("good")).agg(F.count("*").alias("n"))


@query("select sab, count(distinct case when cast(score as double) > cast(0.8 as double) then cui end) as good_concepts from content_tag group by sab")
def conditional_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_tag").groupBy("sab").agg(F.count_distinct(F.when(F.col("score").cast("double") > 0.8, F.col("cui"))).alias("good_concepts"))


@query("select cui, n from (select cui, count(*) as n from content_tag where cui is not null group by cui) where n >= 20")
def having_derived(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_tag").filter("cui is not null").groupBy("cui").agg(F.count("*").alias("n")).filter("n >= 20")


@query(
    "select sab, cast(max(n) as bigint) as most, cast(sum(n) as bigint) as total, round(avg(n), 6) as mean from (select sab, cui, count(*) as n from content_tag where cui is not null group by sab, cui) group by sab"
)
def two_level_counts(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "content_tag").filter("cui is not null").groupBy("sab", "cui").agg(F.count("*").alias("n"))
    return per.groupBy("sab").agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"))


@query(
    "select cui, string_agg(v, '|' order by v) as codes from (select distinct cui, coalesce(sab, 'null') || ' ' || coalesce(tui, 'null') as v from content_tag where cui is not null) group by cui"
)
def code_list_by_term(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "content_tag").filter("cui is not null")
    return t.groupBy("cui").agg(R.ordered_concat(F.concat(F.coalesce("sab", F.lit("null")), F.lit(" "), F.coalesce("tui", F.lit("null"))), "|").alias("codes"))


@query("select blogid, target, id from (select *, row_number() over (partition by blogid, lower(target) order by score desc nulls last, id) as rn from content_tag) where rn = 1")
def preferred_row_dedupe(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "content_tag").withColumn("k", F.lower("target"))
    return R.keep_preferred(t, ["blogid", "k"], [F.col("score").desc_nulls_last(), F.col("id")]).select("blogid", "target", "id")


@query("select tui, arg_min(styname, id) as styname, arg_min(coalesce(cui, '-'), id) as cui, count(*) as n from content_tag group by tui")
def loose_groupby_repr(spark: SparkSession, d: str) -> DataFrame:
    """What a loose GROUP BY shows of a group comes from one of its rows, the one of least id."""
    t = table(spark, d, "content_tag").groupBy("tui").agg(F.min_by(F.struct("styname", "cui"), "id").alias("row"), F.count("*").alias("n"))
    return t.select("tui", "row.styname", F.coalesce("row.cui", F.lit("-")).alias("cui"), "n")


@query("select id, row_number() over (order by score desc nulls last, id) as rid from bio_rank" .replace("bio_rank", "(select id, length(org_str) as score from bioportal)"))
def surrogate_key(spark: SparkSession, d: str) -> DataFrame:
    """Running number over a total order: parts are range-partitioned and lifted by the parts before."""
    t = table(spark, d, "bioportal").select("id", F.coalesce(F.length("org_str"), F.lit(-1)).alias("score"))
    return running_number(t, [F.col("score").desc(), F.col("id")], "rid").select("id", "rid")


@query("select i.blogid, count(*) as n from content_tag i where exists (select 1 from tmp_org o where cast(o.blogid as varchar) = i.blogid and o.text_content is not null) group by 1")
def semi_in(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "tmp_org").filter("text_content is not null").select(F.col("blogid").cast("string").alias("blogid"))
    return table(spark, d, "content_tag").join(o, "blogid", "left_semi").groupBy("blogid").agg(F.count("*").alias("n"))


@query("select distinct o.blogid from tmp_org o left join (select * from content_tag where sab = 'LAYVOC') c on c.blogid = cast(o.blogid as varchar) where c.blogid is null")
def anti_left_null(spark: SparkSession, d: str) -> DataFrame:
    """Posts without a finding of one source."""
    c = table(spark, d, "content_tag").filter("sab = 'LAYVOC'").select(F.col("blogid").alias("tagged")).distinct()
    return table(spark, d, "tmp_org").select("blogid").distinct().join(c, F.col("blogid").cast("string") == F.col("tagged"), "left_anti")


@query("select distinct cui from content_tag where cui is not null and cui not in (select cui from content_tag_compare_only_our where cui is not null)")
def anti_not_in(spark: SparkSession, d: str) -> DataFrame:
    other = table(spark, d, "content_tag_compare_only_our").filter("cui is not null").select("cui").distinct()
    return table(spark, d, "content_tag").filter("cui is not null").select("cui").distinct().join(other, "cui", "left_anti")


@query("select c.category, c.id, c.numanswers from tmp_org_yahoo c join (select category, max(numanswers) as m from tmp_org_yahoo group by category) t on c.category = t.category and c.numanswers = t.m")
def argmax_join_back(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tmp_org_yahoo").filter("category is not null")
    return R.argmax_rows(t, ["category"], "numanswers").select("category", "id", "numanswers")


@query("select l.l_orderkey, l.l_linenumber, c.n as lines from lineitem l join (select l_orderkey, count(*) as n from lineitem group by 1) c on c.l_orderkey = l.l_orderkey where c.n > 6")
def fact_by_group_count(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    n = t.groupBy("l_orderkey").agg(F.count("*").alias("lines")).filter("lines > 6")
    return t.join(n, "l_orderkey")


@query("select c.c_custkey, coalesce(n.n_name, 'none') as place from customer c left join nation n on n.n_nationkey = c.c_nationkey and n.n_regionkey < 3")
def update_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.lit("none").alias("place"))
    n = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("place"))
    return R.update_from(c, n, ["k"], "place").select("c_custkey", "place")


@query("select c_custkey, (c_nationkey in (select n_nationkey from nation where n_regionkey = 1) or c_mktsegment = 'BUILDING') as flag from customer")
def update_flag_or(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("hit"))
    c = table(spark, d, "customer").join(n, "c_nationkey", "left")
    return c.select("c_custkey", (F.coalesce("hit", F.lit(False)) | (F.col("c_mktsegment") == "BUILDING")).alias("flag"))


@query("select cui1, cui2, x1, x2 from (select a.cui1, a.cui2, b.cui1 as x1, b.cui2 as x2 from (select distinct cui1, cui2 from content_tag_compare_only_our where cui1 is not null and cui2 is not null) a join (select distinct cui1, cui2 from content_tag_compare_only_our where cui1 is not null and cui2 is not null) b on (a.cui1 = b.cui2 and a.cui2 = b.cui1) or (a.cui1 = b.cui1 and a.cui2 = b.cui2))")
def undirected_edge_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "content_tag_compare_only_our").filter("cui1 is not null and cui2 is not null").select("cui1", "cui2").distinct()
    f = e.select(F.col("cui1").alias("x1"), F.col("cui2").alias("x2"))
    return R.undirected_join(e, f, ("cui1", "cui2"), ("x1", "x2")).select("cui1", "cui2", "x1", "x2")


@query("select count(*) as n from bioportal where not coalesce(cui is null and length(org_str) < 30, false)")
def delete_filter_nulls(spark: SparkSession, d: str) -> DataFrame:
    return R.delete_where(table(spark, d, "bioportal"), F.col("cui").isNull() & (F.length("org_str") < 30)).agg(F.count("*").alias("n"))


@query("select * from (select blogid, count(*) as n, 'compare' as label from content_tag where lower(target) like '%pain%' group by blogid union all select blogid, count(*), 'long' from content_tag where length(target) > 25 group by blogid) u")
def union_labels(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "content_tag").select("blogid", "target")
    return R.labelled_union(t, {"compare": F.lower("target").contains("pain"), "long": F.length("target") > 25}).groupBy("blogid", "label").agg(F.count("*").alias("n"))


@query("select distinct cui1 as cui, cui2 as related from content_tag_compare_only_our where cui1 is not null and cui2 is not null union select distinct cui2, cui1 from content_tag_compare_only_our where cui1 is not null and cui2 is not null")
def direct_or_related(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "content_tag_compare_only_our").filter("cui1 is not null and cui2 is not null").select("cui1", "cui2").distinct()
    both = e.select(F.explode(F.array(F.struct(F.col("cui1").alias("cui"), F.col("cui2").alias("related")), F.struct(F.col("cui2").alias("cui"), F.col("cui1").alias("related")))).alias("p"))
    return both.select("p.*").distinct()


@query("select id, numanswers from tmp_org_yahoo where id > 100 order by id, numanswers limit 50")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tmp_org_yahoo").filter("id > 100").select("id", "numanswers").orderBy("id", "numanswers").limit(50)  # the page is the feature


@query("select quarter, count(*) as n, min(o_orderkey) as low, max(o_orderkey) as high from (select o_orderkey, cast(floor((o_orderkey - lo) * 4.0 / (hi - lo + 1)) as bigint) as quarter from orders cross join (select min(o_orderkey) as lo, max(o_orderkey) as hi from orders)) group by quarter")
def quartile_split(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    lo, hi = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    q = o.withColumn("quarter", F.floor((F.col("o_orderkey") - F.lit(lo or 0)) * F.lit(4.0) / ((hi or 0) - (lo or 0) + 1)))
    return q.groupBy("quarter").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("select o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M') as stamp, cast(epoch(o_orderdate) as bigint) as seconds from orders where o_orderdate >= timestamp '1995-03-01' and o_orderdate < timestamp '1995-06-01'")
def month_year_range(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter((F.col("o_orderdate") >= F.to_timestamp(F.to_date(F.lit("March 1995"), "MMMM yyyy"))) & (F.col("o_orderdate") < F.to_timestamp(F.to_date(F.lit("June 1995"), "MMMM yyyy"))))
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMddHHmm").alias("stamp"), F.unix_timestamp("o_orderdate").alias("seconds"))


@query("select c.id, c.cui, o.cui as other from content_tag c join content_tag_compare_only_our o on o.blogid = c.blogid and o.sentenceindex = c.sentenceindex and o.wordindexinsentence = c.wordindexinsentence where c.cui <> o.cui")
def theta_mismatch(spark: SparkSession, d: str) -> DataFrame:
    on = ["blogid", "sentenceindex", "wordindexinsentence"]
    c = table(spark, d, "content_tag").select("id", "cui", *on)
    o = table(spark, d, "content_tag_compare_only_our").select(F.col("cui").alias("other"), *on)
    return c.join(o, on).filter(F.col("cui") != F.col("other")).select("id", "cui", "other")


@query("with h as (select distinct blogid, cui from content_tag where cui is not null) select a.cui as cui_a, b.cui as cui_b, count(*) as n from h a join h b on a.blogid = b.blogid and a.cui < b.cui group by 1, 2")
def concept_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of one post, pair by pair; a post of very many concepts is spread over tasks."""
    h = table(spark, d, "content_tag").filter("cui is not null").select("blogid", "cui").distinct()
    met = R.meet_within(h.withColumnRenamed("cui", "cui_a"), ["blogid"], {"cui_a": "cui_b"})
    return met.filter("cui_a < cui_b").groupBy("cui_a", "cui_b").agg(F.count("*").alias("n"))


@query("select distinct a.blogid, a.sentenceindex, a.tui as tui_a, b.tui as tui_b from content_tag a join content_tag b on a.blogid = b.blogid and a.sentenceindex = b.sentenceindex and a.tui > b.tui")
def type_conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    on = ["blogid", "sentenceindex"]
    t = table(spark, d, "content_tag").select(*on, "tui").distinct()
    return R.meet_within(t.withColumnRenamed("tui", "tui_a"), on, {"tui_a": "tui_b"}).filter("tui_a > tui_b").select("blogid", "sentenceindex", "tui_a", "tui_b").distinct()


@query("select * from (select target, min(cui) as cui, count(distinct cui) as n from content_tag where cui is not null and tui in (select tui from content_tag group by tui having count(*) > 10) group by target) order by target")
def value_to_concept(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "content_tag")
    usual = t.groupBy("tui").count().filter("count > 10").select("tui")
    return t.filter("cui is not null").join(usual, "tui", "left_semi").groupBy("target").agg(F.min("cui").alias("cui"), F.count_distinct("cui").alias("n"))


@query("select category, count(*) as n, round(sum(case when chosenanswer is null then 1 else 0 end) / count(*), 6) as unanswered, count(distinct userid) as askers from tmp_org_yahoo group by category")
def answer_ratio(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tmp_org_yahoo")
    return t.groupBy("category").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("chosenanswer").isNull()) / F.count("*"), 6).alias("unanswered"), F.count_distinct("userid").alias("askers"))


@query("select t.id, t.org_str, (select count(*) from content_tag c where lower(c.target) = lower(t.org_str)) as tagged from bioportal t where t.cui is not null")
def correlated_count(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "content_tag").groupBy(F.lower("target").alias("k")).agg(F.count("*").alias("tagged"))
    b = table(spark, d, "bioportal").filter("cui is not null").withColumn("k", F.lower("org_str"))
    return b.join(n, "k", "left").select("id", "org_str", F.coalesce("tagged", F.lit(0)).alias("tagged"))


@query("select id, instr(sentence, org_str) > 0 as held, ends_with(sentence, org_str || '.') as at_end, length(org_str) - length(replace(org_str, ' ', '')) as spaces from bioportal where org_str is not null")
def string_predicates(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bioportal").filter("org_str is not null")
    return b.select("id", (F.expr("instr(sentence, org_str)") > 0).alias("held"), F.endswith("sentence", F.concat("org_str", F.lit("."))).alias("at_end"), (F.length("org_str") - F.length(F.replace("org_str", F.lit(" "), F.lit("")))).cast("bigint").alias("spaces"))


@query("select o.o_orderpriority, year(l.l_shipdate) as y, cast(sum(case when l.l_returnflag = 'R' then 1 else 0 end) as bigint) as r, cast(sum(case when l.l_returnflag = 'A' then 1 else 0 end) as bigint) as a, cast(sum(case when l.l_returnflag = 'N' then 1 else 0 end) as bigint) as n from lineitem l join orders o on o.o_orderkey = l.l_orderkey group by 1, 2")
def flag_pivot(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.year("l_shipdate").cast("bigint").alias("y"))  # noqa: E741
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    p = l.join(o, "l_orderkey").groupBy("o_orderpriority", "y").pivot("l_returnflag", ["R", "A", "N"]).agg(F.count(F.lit(1)))
    return p.select("o_orderpriority", "y", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("R", "A", "N")])


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem where (l_returnflag = 'R' and l_discount > 0.05) or (l_returnflag <> 'R' and l_discount = 0)")
def polarity_filter(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").filter(((c("l_returnflag") == "R") & (c("l_discount") > 0.05)) | ((c("l_returnflag") != "R") & (c("l_discount") == 0))).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("select userid, postid, rn, round(cast(run as double) / total, 6) as share from (select userid, postid, row_number() over (partition by userid order by postid) as rn, sum(cast(length(content) as bigint)) over (partition by userid order by postid) as run, sum(cast(length(content) as bigint)) over (partition by userid) as total from (select distinct userid, postid, content from dataset_deaf where content is not null and userid is not null)) where total > 0")
def running_share(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dataset_deaf").filter("content is not null and userid is not null").select("userid", "postid", "content").distinct()
    t = t.select("userid", "postid", F.lit(1).alias("one"), F.length("content").cast("bigint").alias("size"))
    total = t.groupBy("userid").agg(F.sum("size").alias("total"))
    run = prefix_sums(t, "userid", ["postid"], ["one", "size"]).join(total, "userid")
    return run.filter("total > 0").select("userid", "postid", F.col("pre_one").alias("rn"), F.round(F.col("pre_size").cast("double") / F.col("total"), 6).alias("share"))


@query("select cui from content_tag where cui is not null intersect select cui from content_tag_compare_only_our where cui is not null")
def overlap_concepts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_tag").filter("cui is not null").select("cui").intersect(table(spark, d, "content_tag_compare_only_our").filter("cui is not null").select("cui"))
