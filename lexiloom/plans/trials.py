"""Criteria mining over the trial documents, is-a graphs, corpora and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import criteria as C
from ..operators import graph as G
from ..runtime import table
from ..sources import files as S
from ..streaming import windows as W
from .registry import query
from .terms import _NORM, _WORDS

_P = "^[!-/:-@\\[-`{-~\\s]*"
_HEAD = lambda k: "regexp_matches(upper(s), '" + "|".join(f"^{h}|\\b{h}\\b:|\\b{h}\\b.*:$" for h in C.HEADS[k]) + "')"
_SENT = (
    "cutup as (select doc_id, unnest(l) as raw, generate_subscripts(l, 1) as i from (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.?!])\\s+', '\\1' || chr(10), 'g'), '[\\n#]+'), lambda x: trim(x)), lambda x: length(x) > 2) as l from documents where source = 'trial' and text is not null)), "
    f"sent as (select doc_id, cast(i - 1 as bigint) as sent, raw, regexp_replace(raw, '{_P}', '') as s from cutup), "
    + "heads as (select *, " + ", ".join(f"{_HEAD(k)} as h_{k}" for k in C.HEADS) + ", regexp_matches(raw, '" + C.BULLET + "') as item from sent), "
    + "walk(doc_id, sent, state, opened) as (select doc_id, cast(-1 as bigint), 'head', false from (select distinct doc_id from sent) union all "
    + "select doc_id, sent, coalesce(opens, state), opens is not null from (select h.doc_id, h.sent, w.state, case when state <> 'inclusion' and h_inclusion then 'inclusion' when state <> 'exclusion' and h_exclusion then 'exclusion' when state in ('inclusion', 'exclusion') then null "
    + "when state <> 'disease' and h_disease then 'disease' when state <> 'patient' and h_patient then 'patient' when state <> 'prior' and h_prior then 'prior' when state = 'head' and h_both then 'both' end as opens from walk w join heads h on h.doc_id = w.doc_id and h.sent = w.sent + 1)), "
    + "rows as (select h.doc_id, h.sent, h.s, case " + " ".join(f"when opened and state = '{k}' then '{v}'" for k, v in C.HEAD_LABELS.items()) + " " + " ".join(f"when state = '{k}' then '{v}'" for k, v in C.LABELS.items()) + " end as label, "
    + "case when item then coalesce(max(case when not item then h.sent end) over (partition by h.doc_id order by h.sent rows between unbounded preceding and 1 preceding), -1) else -1 end as sub from heads h join walk w on w.doc_id = h.doc_id and w.sent = h.sent)"
)


def _case(of: str, pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches({of}, '{p}') then '{v}'" for v, p in pairs) + f" else {otherwise} end"


_Q = [C.compile_quantity(*q) for q in C.QUANTITIES]
_FLAT = "regexp_replace(regexp_replace(regexp_replace(lower(s), '[^\\p{L}\\p{N}<>=/ -]', ' ', 'g'), '([<>=/])', ' \\1 ', 'g'), ' +', ' ', 'g')"
_SECONDS = (
    "case unit when 'hour' then {n} * 3600 when 'day' then {n} * 86400 when 'week' then {n} * 604800 when 'month' then date_diff('day', date '2000-01-01', cast(date '2000-01-01' + to_months(cast({n} as int)) as date)) * 86400 "
    "when 'year' then date_diff('day', date '2000-01-01', cast(date '2000-01-01' + to_months(cast({n} * 12 as int)) as date)) * 86400 end"
)
_MONTHS = "case when {c} < 0 then -1 else cast(floor({c} / (30.58333 * 86400) + 0.5) as bigint) end"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return C.criteria_rows(table(spark, d, "documents").filter("source = 'trial'"), "doc_id", "text")


@query(f"with recursive {_SENT} select doc_id, sent, label, sub from rows")
def criteria_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the trials with one of ten labels, and the sub-title of list items."""
    return _rows(spark, d).select("doc_id", "sent", "label", "sub")


@query(f"with recursive {_SENT} select doc_id, sent, {_case('lower(s)', _Q, chr(39) + 'None' + chr(39))} as quantity from rows")
def quantity_detect(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("doc_id", "sent", C.first_quantity(F.col("s")).alias("quantity"))


@query(f"with recursive {_SENT} select q, count(*) as n from (select concat_ws('|', " + ", ".join(f"case when regexp_matches(lower(s), '{p}') then '{v}' end" for v, p in _Q) + ") as q from rows) group by q")
def quantity_labels(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select(C.all_quantities(F.col("s")).alias("q")).groupBy("q").agg(F.count("*").alias("n"))


@query(
    f"with recursive {_SENT}, k0 as (select min(semname) as root, cui, {_NORM('target')} as keyword from content_tag where cui is not null group by all union select 'term', cui, {_NORM('org_str')} from bioportal where cui is not null), k as (select distinct root, cui, keyword from k0 where keyword <> ''), "
    f"w as (select doc_id, sent, {_WORDS('s')} as w from rows), p as (select doc_id, sent, w, unnest(generate_series(1, len(w))) as i from w where len(w) > 0), g as (select doc_id, sent, w, i, unnest([1, 2, 3, 4, 5]) as n from p), "
    "h as (select distinct doc_id, sent, root, cui, keyword from (select doc_id, sent, array_to_string(w[i : i + n - 1], ' ') as gram from g where i + n - 1 <= len(w)) join k on k.keyword = gram) select r.doc_id, r.sent, root, cui, keyword from rows r left join h on h.doc_id = r.doc_id and h.sent = r.sent"
)
def keyword_detect(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of the concept tables in the trials, a row per hit, one without keyword where there is none."""
    t = table(spark, d, "content_tag").filter("cui is not null").groupBy("cui", F.col("target").alias("keyword")).agg(F.min("semname").alias("root"))
    t = t.groupBy("cui", X.normalize(F.col("keyword")).alias("keyword")).agg(F.min("root").alias("root")).select("root", "cui", "keyword")
    b = table(spark, d, "bioportal").filter("cui is not null").select(F.lit("term").alias("root"), "cui", F.col("org_str").alias("keyword"))
    return C.keyword_hits(_rows(spark, d), t.unionByName(b))


@query(
    f"with recursive {_SENT}, f as (select doc_id, sent, label, s, {_FLAT} as flat from rows), e as (select *, trim(regexp_replace(regexp_replace(flat, '{C.DURATION}', ' dur# ', 'g'), ' +', ' ', 'g')) || ' ' as e from f), "
    f"m as (select *, {_case('e', C.compile_rules(), 'null')} as pattern, try_cast(regexp_extract(flat, '{C.DURATION}', 1) as bigint) as n1, try_cast(nullif(regexp_extract(flat, '{C.DURATION}', 2), '') as bigint) as n2, regexp_extract(flat, '{C.DURATION}', 3) as unit from e where contains(e, 'dur#')), "
    f"x as (select *, {_SECONDS.format(n='n1')} as a, case when n2 is not null then {_SECONDS.format(n='n2')} end as b, regexp_matches(pattern, '_(MT|AF)') as lower_ from m where pattern is not null), "
    "y as (select *, cast(case when b is not null or lower_ then a else -1 end as bigint) as low_s, cast(case when b is not null then b when lower_ then -1 else a end as bigint) as high_s from x) "
    f"select doc_id, sent, label, pattern, low_s, high_s, {_MONTHS.format(c='low_s')} as low_m, {_MONTHS.format(c='high_s')} as high_m, len(regexp_extract_all(e, '{C.NEGATIONS}')) as neg, len(regexp_extract_all(split_part(e, 'dur#', 1), '{C.NEGATIONS}')) as neg_ahead from y"
)
def pattern_match(spark: SparkSession, d: str) -> DataFrame:
    """The first rule of the duration grammar that each sentence of the trials meets, with its bounds."""
    return C.match_patterns(_rows(spark, d))


@query()
def criteria_split(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every trial text; the queue of the splitter is not expressible in SQL and is tested against cases."""
    t = table(spark, d, "documents").filter("source = 'trial'")
    return t.select("doc_id", F.posexplode(C.split_pieces(F.col("text"))).alias("part", "piece"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_tag_compare_only_our").filter("rel in ('PAR', 'RB')").select(F.col("cui1").alias("child"), F.col("cui2").alias("parent"))


_EDGES = "e as (select distinct cui1 as child, cui2 as parent from content_tag_compare_only_our where rel in ('PAR', 'RB') and cui1 is not null and cui2 is not null and cui1 <> cui2)"


@query(f"with recursive {_EDGES}, r as (select distinct parent as root from e ), w(root, node, depth) as (select root, root, 0 from r union select w.root, e.child, w.depth + 1 from w join e on e.parent = w.node where w.depth < 5) select root, node, min(depth) as depth from w group by root, node")
def concept_closure(spark: SparkSession, d: str) -> DataFrame:
    """Closure of every parent, five steps deep."""
    e = _edges(spark, d)
    return G.descendants(e, G.parents(e))


@query(f"with {_EDGES}, nodes as (select child as node from e union select parent from e), up as (select child as node, count(*) as parents from e group by 1) select node, coalesce(parents, 0) as parents, case when coalesce(parents, 0) = 0 then 'root' when parents = 1 then 'child' else 'new_root' end as kind from nodes left join up using (node)")
def isa_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d))


@query(
    f"with recursive {_EDGES}, nodes as (select child as node from e union select parent from e), up as (select child as node, count(*) as parents from e group by 1), "
    "kinds as (select node, case when coalesce(parents, 0) = 0 then 'root' when parents = 1 then 'child' else 'new_root' end as kind from nodes left join up using (node)), "
    "w(node, pos, steps) as (select node, node, 0 from kinds where kind = 'child' union all select w.node, e.parent, w.steps + 1 from w join e on e.child = w.pos join kinds k on k.node = w.pos where k.kind = 'child' and w.steps <= (select count(*) from nodes)), "
    "got as (select w.node, w.pos as head, w.steps from w join kinds k on k.node = w.pos where k.kind <> 'child') "
    "select node, kind, node as head, cast(0 as bigint) as steps from kinds where kind <> 'child' union all select node, 'child', head, cast(steps as bigint) from got union all select node, 'child', node, cast(-1 as bigint) from kinds where kind = 'child' and node not in (select node from got)"
)
def isa_grouping(spark: SparkSession, d: str) -> DataFrame:
    return G.group_under_roots(_edges(spark, d))


@query(
    f"with recursive {_EDGES}, nodes as (select child as node from e union select parent from e), w(node, k) as (select node, 0 from nodes union select e.child, k + 1 from w join e on e.parent = w.node where k < (select count(*) from nodes)) "
    "select node, cast(case when max(k) >= (select count(*) from nodes) then -1 else max(k) end as int) as layer from w group by node"
)
def isa_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers of the is-a graph by longest way from a root; nodes on and below cycles have none."""
    return G.layers(_edges(spark, d))


@query("select doc_id, 'page ' || doc_id as title, cast(length(trim(regexp_replace(regexp_replace(text, '<[^<>]{0,30}>', '', 'g'), '\\s+', ' ', 'g'))) as bigint) as n from documents where source = 'wiki' and text is not null")
def wiki_doc_parse(spark: SparkSession, d: str) -> DataFrame:
    """Documents laid out as a dump and read back: header, body, end mark; tags stripped."""
    t = table(spark, d, "documents").filter("source = 'wiki' and text is not null")
    dump = t.select(F.concat(F.lit('<doc id="'), "doc_id", F.lit('" title="page '), "doc_id", F.lit('">\n'), "text", F.lit("\n</doc>\n")).alias("value"))
    p = S.parse_dump(dump, "value")
    return p.select(F.col("doc_id"), "title", F.length(F.trim(F.regexp_replace("body", r"\s+", " "))).cast("bigint").alias("n"))


_PAGE = "'<html><head><title>NCT00000000</title></head><style>a {b: c}</style><p>' || coalesce(text, '') || ' <b>' || coalesce(ids, '') || '</b></p><script>var x = 1;</script></html>'"


@query(
    f"with p as (select doc_id, {_PAGE} as html from (select doc_id, text, case doc_id % 3 when 0 then 'NCT' || lpad(cast(doc_id as varchar), 8, '0') when 1 then 'see clinicaltrials.gov' end as ids from documents)), "
    "v as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|head|title)\\b(.|\\n)*?</(script|style|head|title)>', ' ', 'gi'), '<[^<>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as t from p) "
    "select doc_id, length(t) as n, case when regexp_matches(t, 'NCT[0-9]{8}') then regexp_extract(t, 'NCT[0-9]{8}', 0) when contains(lower(t), 'clinicaltrials.gov') then 'site' else 'None' end as trial from v"
)
def visible_text_trial_id(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of pages laid around the documents, and the trial they name: the first number, else a mention of the site."""
    ids = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("NCT"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))).when(F.col("doc_id") % 3 == 1, "see clinicaltrials.gov")
    head, tail = "<html><head><title>NCT00000000</title></head><style>a {b: c}</style><p>", "</b></p><script>var x = 1;</script></html>"
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit(head), F.coalesce("text", F.lit("")), F.lit(" <b>"), F.coalesce(ids, F.lit("")), F.lit(tail)).alias("html"))
    v = t.select("doc_id", S.visible_text(F.col("html")).alias("t"))
    got = F.regexp_extract("t", "NCT[0-9]{8}", 0)
    return v.select("doc_id", F.length("t").cast("bigint").alias("n"), F.when(got != "", got).when(F.lower("t").contains("clinicaltrials.gov"), "site").otherwise("None").alias("trial"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of the tumbling window stream."""
    return W.tumbling(table(spark, d, "events"), "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("select start, count(*) as n from (select unnest([date_trunc('hour', ts) + interval (15 * floor(minute(ts) / 15)) minute - interval (15 * k) minute for k in [0, 1, 2, 3]]) as start from events) group by start")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")


@query("select user_id, min(ts) as start, count(*) as n from (select *, sum(case when prev is null or ts >= prev + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) as s from (select event_id, user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as prev from events)) group by user_id, s")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")
