"""Queries of the text and algorithm operators over their whole tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import table
from .cooccur import pair_lift
from .leaks import find_leaks
from .markup import strip_markup, suffix_runs
from .mixing import mix_sources
from .outranking import Score, outranking_flows, rank_items
from .pairs import find_defects
from .templates import find_residue, residue_evidence, template_slots
from .truncation import cut_sentences, cut_terms, length_limits

SHORT_RUN = 3  # tokens of a repeated run of titles, which are short
SCORES = [Score("tfdf"), Score("cvalue"), Score("umls_score", 0, 100), Score("chv_score", 0, 10)]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = find_defects(table(spark, d, "qa_data"), "id", "question_content", "answer_content")
    return out.select(F.col("key").alias("id"), "defect")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    org, yahoo = table(spark, d, "tmp_org"), table(spark, d, "tmp_org_yahoo")
    parts = [(org, "tmp_org", "blogid", "blog_name", "text_content", "text_content"), (org, "tmp_org", "blogid", "blog_name", "text_link_title", "text_link_title"), (yahoo, "tmp_org_yahoo", "id", "category", "content", "content")]
    out = None
    for df, tbl, key, host, column, field in parts:
        one = df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("bigint").alias("row_id"), F.lit(field).alias("field"), F.concat_ws("/", F.lit(tbl), F.lit(field), F.col(host)).alias("host"), F.col(column).alias("raw"))
        out = one if out is None else out.unionByName(one)
    return out


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return strip_markup(_fields(spark, d), "host", ["tbl", "row_id", "field"], "raw")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("tbl", "row_id", "field", F.explode("kinds").alias("kind")).distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).filter("clean is not null").select("tbl", "row_id", "field", "clean", "boilerplate")


def p3_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of titles that three posts of a blog share, three tokens at a time."""
    t = table(spark, d, "tmp_org").filter("text_link_title is not null and blog_name is not null").select("blog_name", "text_link_title").distinct()
    t = t.withColumn("page", F.xxhash64("blog_name", "text_link_title"))
    runs = suffix_runs(t, "blog_name", "page", "text_link_title", run=SHORT_RUN)
    return runs.groupBy(F.col("host").alias("blog_name"), F.col("prefix").alias("run")).agg(F.count_distinct("page").alias("pages"), F.count("*").alias("places"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    cols = ["sab", "id", "sentence", "blogid", "sentenceindex"]
    both = [table(spark, d, t).select(F.lit(t).alias("tbl"), *cols) for t in ("content_tag", "content_tag_compare_only_our")]
    return both[0].unionByName(both[1])


def _cut(spark: SparkSession, d: str) -> DataFrame:
    text = cut_sentences(_sentences(spark, d), ["tbl", "sab"], "id", "sentence", ["blogid", "sentenceindex"])
    bio = table(spark, d, "bioportal").select(F.lit("bioportal").alias("tbl"), F.lit(None).cast("string").alias("sab"), "id", "org_str", "sentence")
    return text.unionByName(cut_terms(bio, ["tbl", "sab"], "id", "org_str", "sentence"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).select("tbl", F.col("key").alias("id")).distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rows, cut rows and their share per source."""
    rows = _sentences(spark, d).select("tbl", "sab").unionByName(table(spark, d, "bioportal").select(F.lit("bioportal").alias("tbl"), F.lit(None).cast("string").alias("sab")))
    all_ = rows.withColumn("sab", F.coalesce("sab", F.lit("-"))).groupBy("tbl", "sab").agg(F.count("*").alias("n_rows"))
    cut = _cut(spark, d).withColumn("sab", F.coalesce("sab", F.lit("-"))).groupBy("tbl", "sab").agg(F.count("*").alias("n_cut"), F.count_if("at_limit").alias("n_at_limit"))
    return all_.join(cut, ["tbl", "sab"], "left").select("tbl", "sab", "n_rows", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.coalesce("n_at_limit", F.lit(0)).alias("n_at_limit"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_rows")).alias("rate"))


def p5_limits(spark: SparkSession, d: str) -> DataFrame:
    """Lengths at which a source cuts, with their hazard."""
    rows = _sentences(spark, d).select("tbl", F.coalesce("sab", F.lit("-")).alias("sab"), F.length("sentence").alias("len")).filter("len > 0")
    return length_limits(rows, ["tbl", "sab"], "len").filter("limit").select("tbl", "sab", "len", "n", "at_risk", "hazard")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = pair_lift(table(spark, d, "content_tag_ytex"), "instance_id", "code", min_together=5, min_share=1 / 500)
    return pairs.filter("500 * n_ab >= n and n_ab * n >= 4 * n_a * n_b").select(F.col("a").alias("code_a"), F.col("b").alias("code_b"))


def p6_lift(spark: SparkSession, d: str) -> DataFrame:
    """Counts and lift of every pair of codes that is together at all."""
    pairs = pair_lift(table(spark, d, "content_tag_ytex"), "instance_id", "code")
    return pairs.select(F.col("a").alias("code_a"), F.col("b").alias("code_b"), "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"))


def p7_rank(spark: SparkSession, d: str) -> DataFrame:
    flows = rank_items(outranking_flows(table(spark, d, "k20all"), "ngram", SCORES))
    return flows.select(F.col("key").alias("ngram"), *[F.round(f"flow_{s.column}", 9).alias(f"flow_{s.column}") for s in SCORES], F.round("net_flow", 9).alias("net_flow"), "place")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents and the most words that one of them holds."""
    found = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words_held").alias("most_words"), F.max("item_words").alias("item_words"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents"))


def p10_slots(spark: SparkSession, d: str) -> DataFrame:
    """What stands in slots, with the records that hold it and how many of them alignment shows to be slots."""
    slots = template_slots(table(spark, d, "documents"), "doc_id", "text")
    return slots.groupBy("mark").agg(F.count("*").alias("documents"), F.count_if("induced").alias("induced"), F.max("fillers").alias("fillers"))


def p10_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each kind a slot, a notation or a page template has found."""
    return residue_evidence(table(spark, d, "documents")).groupBy("kind", "evidence").agg(F.count("*").alias("documents"))


def queries() -> dict:
    names = [p2_found, p3_found, p3_clean, p3_boilerplate, p5_found, p5_rates, p5_limits, p6_found, p6_lift, p7_rank, p8_found, p8_items, p9_mix, p9_shares, p10_found, p10_slots, p10_evidence]
    return {f.__name__: f for f in names}


_PAIRS = """
with held as (select distinct instance_id as i, upper(trim(code)) as c from content_tag_ytex where instance_id is not null and trim(code) <> ''),
per as (select c, count(*) as n_item from held group by c), total as (select count(distinct i) as n from held),
pairs as (select x.c as code_a, y.c as code_b, count(*) as n_ab from held x join held y on x.i = y.i and x.c < y.c group by 1, 2)
"""


def _flow_sql(i: int, s: Score) -> str:
    value = f"try_cast(regexp_replace(trim(cast({s.column} as varchar)), '([0-9]),([0-9][0-9][0-9])', '\\1\\2', 'g') as double)"
    number = f"case when regexp_matches(regexp_replace(trim(cast({s.column} as varchar)), '([0-9]),([0-9][0-9][0-9])', '\\1\\2', 'g'), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') then {value} end"
    low = f" and x >= {s.low}" if s.low is not None else ""
    high = f" and x <= {s.high}" if s.high is not None else ""
    return f"""v{i} as (select ngram, max(x) as v from (select ngram, {number} as x from k20all where ngram is not null) where x is not null{low}{high} group by ngram),
d{i} as (select v, count(*) as cnt from v{i} group by v),
r{i} as (select v, cnt, 2 * sum(cnt) over (order by v) - cnt as p, sum(cnt) over () as n from d{i}),
m{i} as (select v, cnt, p, n, cast(floor(n * 2 * 0.02) as bigint) as q, greatest(cast(floor(n * 2 * 0.25) as bigint), cast(floor(n * 2 * 0.02) as bigint) + 1) as t from r{i}),
f{i} as (select a.v, case when any_value(a.n) > 1 then cast(sum(b.cnt * case when abs(a.p - b.p) <= a.q then 0 else sign(a.p - b.p) * least(abs(a.p - b.p) - a.q, a.t - a.q) end) as double) / cast(any_value((a.t - a.q) * (a.n - 1)) as double) else 0.0 end as flow
  from m{i} a cross join m{i} b group by a.v)"""


_RUNS = f"""
with t as (select distinct blog_name, text_link_title from tmp_org where text_link_title is not null and blog_name is not null),
w as (select blog_name, text_link_title, string_split_regex(trim(text_link_title), '\\s+') as w from t),
s as (select blog_name, text_link_title, unnest(list_transform(range(1, len(w) - {SHORT_RUN} + 2), lambda i: array_to_string(w[i : i + {SHORT_RUN} - 1], ' '))) as run from w where len(w) >= {SHORT_RUN})
select blog_name, run, count(distinct text_link_title) as pages, count(*) as places from s group by blog_name, run having count(distinct text_link_title) >= 3
"""
_LIMITS = """
with rows as (select 'content_tag' as tbl, coalesce(sab, '-') as sab, length(sentence) as len from content_tag union all select 'content_tag_compare_only_our', coalesce(sab, '-'), length(sentence) from content_tag_compare_only_our),
hist as (select tbl, sab, len, count(*) as n from rows where len > 0 group by tbl, sab, len),
risk as (select *, sum(n) over (partition by tbl, sab order by len desc rows between unbounded preceding and current row) as at_risk from hist),
pool as (select *, sum(n) over w - n as pool_n, sum(at_risk) over w - at_risk as pool_risk from risk window w as (partition by tbl, sab order by len range between 5 preceding and 5 following)),
ex as (select *, at_risk * case when pool_risk > 0 then pool_n / pool_risk else 0.0 end as expected from pool),
zz as (select *, 2 * (sqrt(n) - sqrt(expected + 1)) as z from ex),
pp as (select *, case when z <= 0.5 then 1.0 else least(1.0, exp(-z * z / 2) / (z * 2.5066282746310002)) end as p from zz),
rk as (select *, row_number() over (order by p, tbl, sab, len) as r, count(*) over () as m from pp),
bar as (select coalesce(max(p), -1.0) as b from rk where p <= r * 0.01 / m)
select tbl, sab, len, n, cast(at_risk as bigint) as at_risk, cast(n as double) / at_risk as hazard from pp cross join bar where p <= b and n > 2 * expected
"""


def oracle_sql() -> dict[str, str]:
    flows = ",\n".join(_flow_sql(i, s) for i, s in enumerate(SCORES))
    joins = " ".join(f"left join v{i} on v{i}.ngram = k.ngram left join f{i} on f{i}.v = v{i}.v" for i in range(len(SCORES)))
    cols = ", ".join(f"coalesce(f{i}.flow, 0.0) as flow_{s.column}" for i, s in enumerate(SCORES))
    net = " + ".join(f"flow_{s.column} * 1.0" for s in SCORES)
    rounded = ", ".join(f"round(flow_{s.column}, 9) as flow_{s.column}" for s in SCORES)
    return {
        "p3_boilerplate": _RUNS,
        "p5_limits": _LIMITS,
        "p6_found": _PAIRS + "select code_a, code_b from pairs join per a on a.c = code_a join per b on b.c = code_b cross join total where n_ab >= 5 and 500 * n_ab >= n and n_ab * n >= 4 * a.n_item * b.n_item",
        "p6_lift": _PAIRS + "select code_a, code_b, a.n_item as n_a, b.n_item as n_b, n_ab, round(cast(n_ab as double) * n / (cast(a.n_item as double) * b.n_item), 6) as lift from pairs join per a on a.c = code_a join per b on b.c = code_b cross join total",
        "p7_rank": f"with {flows}, w as (select k.ngram, {cols} from (select distinct ngram from k20all where ngram is not null) k {joins}), "
        f"x as (select *, (0.0 + {net}) / 4.0 as nf from w) select ngram, {rounded}, round(nf, 9) as net_flow, rank() over (order by nf desc) as place from x",
    }
