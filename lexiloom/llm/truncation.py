"""Texts cut by a field limit or in transfer, and how often each source cuts.

The discrete hazard of a length, the share of texts at least so long that end exactly there, is
computed by windows over the length histogram of a source and tested against the hazards of
neighbouring lengths, with the false discovery rate held over all lengths. Texts of a significant
length without a whole ending were cut by the limit; at other lengths the ending must be broken
beyond doubt, or another row must show how the text goes on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordering import running_number, with_next
from ..runtime import cut, meet, small_enough, spread
from .endings import ENDS, ending_counts, has_end, judge_open_ends

NEIGHBOURS = 5  # lengths on each side whose hazards are the measure
FALSE_DISCOVERY = 0.01
LIMIT_SHARE = 0.6  # at a limit an open ending is whole only beyond this share of ends
FOLLOWED = 3  # different terms that a frame must follow before it proves that a term is whole
CAP = 0.9  # hazard of a limit that lets hardly any text through; there an open ending is a cut one


def length_limits(texts: DataFrame, source: Sequence[str], length: str) -> DataFrame:
    """``(source.., length, n, at_risk, hazard, expected, p_value, limit)`` of every length.

    The test is one-sided: a Poisson count with the neighbours' pooled hazard as its rate, by the
    normal approximation of its square root; ``limit`` marks lengths that the step-up procedure
    accepts at ``FALSE_DISCOVERY`` and that hold twice what was expected.
    """
    hist = texts.groupBy(*source, length).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*source).orderBy(F.col(length).desc())
    near = Window.partitionBy(*source).orderBy(length).rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    h = hist.withColumn("at_risk", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("hazard", F.col("n") / F.col("at_risk"))
    h = h.withColumn("pool_n", F.sum("n").over(near) - F.col("n")).withColumn("pool_risk", F.sum("at_risk").over(near) - F.col("at_risk"))
    h = h.withColumn("expected", F.col("at_risk") * F.when(F.col("pool_risk") > 0, F.col("pool_n") / F.col("pool_risk")).otherwise(F.lit(0.0)))
    z = 2 * (F.sqrt(F.col("n")) - F.sqrt(F.col("expected") + 1))
    # upper tail of the normal law by a bound that is close in the tail
    h = h.withColumn("p_value", F.when(z <= 0.5, 1.0).otherwise(F.least(F.lit(1.0), F.exp(-z * z / 2) / (z * 2.5066282746310002))))
    h = cut(h)
    lengths = h.count()
    # only these can be accepted, and their ranks are the same among themselves
    low = h.filter(F.col("p_value") <= FALSE_DISCOVERY).select("p_value", *source, length)
    order = [F.asc("p_value"), *[F.asc_nulls_first(s) for s in source], F.asc(length)]
    ranked = low.withColumn("rank", F.row_number().over(Window.orderBy(*order))) if small_enough(low) else running_number(low, order, "rank")
    accepted = ranked.filter(F.col("p_value") <= F.col("rank") * FALSE_DISCOVERY / max(1, lengths)).agg(F.max("p_value")).first()[0]
    bar = -1.0 if accepted is None else accepted
    return h.select(
        *source, length, "n", "at_risk", "hazard", "expected", "p_value",
        ((F.col("p_value") <= bar) & (F.col("n") > 2 * F.col("expected"))).alias("limit"),
    )


def cut_sentences(rows: DataFrame, source: Sequence[str], key: str, text: str, group: Sequence[str] = ()) -> DataFrame:
    """``(source.., key, at_limit, chance)`` of rows whose ``text`` lost its end.

    ``group`` names columns that rows of one original share; a text that another row of its group
    goes on from is cut, whatever its ending. Each distinct text is judged once. Null and blank
    texts are not cut; a null source is a source of its own; other columns are ignored.
    """
    base = rows.select(*source, F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *[F.col(g).alias(f"g_{g}") for g in group]).filter(F.trim("text") != "")
    # a text is named by two hashes, so that rows meet their judgement without carrying it
    base = base.withColumn("len", F.length("text")).withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    texts = spread(cut(base.select("text", "h1", "h2").distinct()), "h1")
    counts = ending_counts(texts, "text")
    named = F.struct("h1", "h2")
    judged = judge_open_ends(texts.select(named.alias("h"), "text"), "h", "text", counts).select("key.h1", "key.h2", "chance")
    # a cap cuts numbers after their point too, which then looks like an end mark
    open_ = texts.filter(~has_end(F.col("text")) | F.col("text").rlike(r"(?:^|[^\d.])\d+\.$")).select("h1", "h2")
    told = open_.join(judged, ["h1", "h2"], "left").withColumn("continued", F.lit(False))
    if group:
        told = told.drop("continued").join(_continued(base, [f"g_{g}" for g in group]), ["h1", "h2"], "left").withColumn("continued", F.coalesce("continued", F.lit(False)))
    told = cut(told.withColumn("open", F.lit(True)))
    limits = length_limits(base.select(*source, "len"), source, "len").filter("limit").select(*[F.col(s).alias(f"s_{s}") for s in source], F.col("len").alias("s_len"), F.lit(True).alias("at_limit"), (F.col("hazard") >= CAP).alias("cap"))
    found = meet(base.select(*source, "key", "len", "h1", "h2"), told, ["h1", "h2"])
    found = _at_limits(found, limits, source)
    bar = F.when(F.col("at_limit"), LIMIT_SHARE).otherwise(ENDS)
    broken = F.coalesce(F.col("chance") < bar, F.lit(False)) | F.coalesce("cap", F.lit(False)) | F.col("continued")
    return found.filter(broken).select(*source, "key", "at_limit", "chance")


def _at_limits(rows: DataFrame, limits: DataFrame, source: Sequence[str]) -> DataFrame:
    """``rows`` with ``at_limit`` and the other columns of the limit of their source and ``len``."""
    name = lambda df, cols: df.withColumn("__at", F.to_json(F.struct(*[F.col(c).alias(str(i)) for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}))
    keyed = name(limits, [*[f"s_{s}" for s in source], "s_len"]).drop("s_len", *[f"s_{s}" for s in source])
    met = meet(name(rows, [*source, "len"]), keyed, ["__at"], "left").drop("__at")
    return met.withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))


def _continued(base: DataFrame, group: list[str]) -> DataFrame:
    """Distinct texts that another text of their group goes on from.

    Sorted within a group, a text stands right before those it begins; closing marks at its own
    end are no part of the beginning.
    """
    pairs = with_next(base.select(*group, "text").distinct(), [*group, "text"], "text", "after", group)
    held = pairs.filter(F.col("after").startswith(F.col("text")) & (F.length("after") > F.length("text") + 1) & ~has_end(F.col("text")))
    return held.select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).distinct().withColumn("continued", F.lit(True))


def cut_terms(rows: DataFrame, source: Sequence[str], key: str, term: str, sentence: str) -> DataFrame:
    """``(source.., key, at_limit, chance)`` of rows whose ``term`` lost its end against ``sentence``.

    The sentence tells what follows the term: a letter means that it stops inside a word, unless
    the rest is an English ending on a word in use. Otherwise the two words that follow
    are looked up among all rows: what follows whole terms recurs, and follows terms of all
    lengths, whereas the inside of a term follows only at a limit or once in a while. A frame proves
    wholeness when it holds a hundredth of the distinct pairs of term and sentence and follows
    ``FOLLOWED`` different terms; copies of a row are no further evidence.
    Terms that the sentence lacks, null and blank ones give no row.
    """
    base = rows.select(*source, F.col(key).alias("key"), F.col(term).cast("string").alias("term"), F.col(sentence).cast("string").alias("s")).filter(F.trim("term") != "")
    base = base.withColumn("len", F.length("term"))
    at = F.expr("instr(lower(s), lower(term))")
    rest = F.expr("substring(s, instr(lower(s), lower(term)) + length(term))")
    seen = base.filter(at > 0).withColumn("rest", rest)
    inner = F.regexp_extract("rest", r"^([\p{L}\d]+)", 1)
    seen = seen.withColumn("inner", F.when(F.col("term").rlike(r"[\p{L}\d]$"), inner).otherwise(""))
    frame = F.regexp_extract(F.regexp_replace(F.lower(F.ltrim("rest")), r"\d+", "0"), r"^([^\p{L}\d]*[\p{L}\d]*[^\p{L}\d]+[\p{L}\d]*)", 1)
    seen = seen.withColumn("frame", F.when(F.col("inner") == "", F.trim(frame)))
    limits = length_limits(seen.select(*source, "len"), source, "len").filter("limit").select(*[F.col(x).alias(f"s_{x}") for x in source], F.col("len").alias("s_len"), F.lit(True).alias("at_limit"))
    seen = cut(_at_limits(seen, limits, source).select(*source, "key", "term", "s", "rest", "inner", "frame", "at_limit"))
    whole = cut(seen.filter(F.col("frame").isNotNull() & ~F.col("at_limit")).select(F.lower("term").alias("term"), F.lower("s").alias("s"), "frame").distinct())
    n = whole.count()
    frames = whole.groupBy("frame").agg(F.count("*").alias("times"), F.count_distinct("term").alias("terms")).filter(F.col("terms") >= FOLLOWED).drop("terms")
    out = meet(seen, cut(frames), ["frame"], "left").withColumn("chance", F.when(F.col("frame").isNull(), 0.0).otherwise(F.coalesce("times", F.lit(0)) / F.lit(float(max(1, n)))))
    # the term is whole in another form where the sentence only adds an ending to a word in use
    last = F.lower(F.regexp_extract("term", r"([\p{L}\d]+)$", 1))
    asked = cut(seen.filter(_inflection(F.col("inner"))).select(last.alias("last")).distinct().withColumn("here", F.lit(True)))
    used = base.select(F.explode(F.array_distinct(F.split(F.lower("s"), r"[^\p{L}\d]+"))).alias("last")).filter("last <> ''")
    used = cut(meet(used, asked, ["last"]).select("last").distinct().withColumn("used", F.lit(True)))
    out = meet(out.withColumn("last", last), used, ["last"], "left")
    other_form = _inflection(F.col("inner")) & F.coalesce("used", F.lit(False)) & ~F.col("at_limit")
    inside = (F.col("inner") != "") & ~other_form
    between = F.col("frame").isNotNull() & (F.col("chance") < 0.01) & (F.trim("rest") != "")
    return out.filter(inside | between).select(*source, "key", "at_limit", "chance")


def _inflection(rest: Column) -> Column:
    """Whether the rest of a word is an English ending, so that the term is whole in another form."""
    return F.lower(rest).isin("s", "es", "ed", "d", "ing", "ly", "er", "ers")
