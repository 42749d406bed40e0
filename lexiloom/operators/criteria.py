"""Eligibility criteria: splitting, sections, quantities, durations, negation and a token grammar."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as X
from ..runtime import cut, meet

# Heads of the sections of a trial, the state each opens, and the labels of states and heads.
HEADS = {"inclusion": ("INCLUSION CRITERIA",), "exclusion": ("EXCLUSION CRITERIA", "NON-INCLUSION CRITERIA"), "disease": ("DISEASE CHARACTERISTICS",), "patient": ("PATIENT CHARACTERISTICS",), "prior": ("PRIOR CONCURRENT THERAPY",), "both": ("INCLUSION AND EXCLUSION CRITERIA",)}
LABELS = {"head": "Head", "inclusion": "Inclusion", "exclusion": "Exclusion", "both": "Both", "disease": "DISEASE CHARACTERISTICS", "patient": "PATIENT CHARACTERISTICS", "prior": "PRIOR CONCURRENT THERAPY"}
HEAD_LABELS = {"inclusion": "Inclusion head", "exclusion": "Exclusion head", "both": "Both head"}
# What makes a line an item of a list.
BULLET = r"^(?:[-*]\s.*|[0-9]+\.?\s.*)$"
# Words that deny.
NEGATIONS = r"\b(?:no|not|without|never|none|neither|nor|denies|absence)\b"
# Quantities in the notation of their file: a name and a pattern, where xxx stands for a number.
QUANTITIES = (
    ("age", "years (of age|old)"),
    ("dose", "xxx (mg|grams|tablets|drops|puffs|units|sips)"),
    ("lab", "(above|below|lies above|showed) xxx"),
    ("(op) comparison", "[<>]=? ?xxx"),
    ("duration", "xxx (hours?|days?|weeks?|months?|years?)"),
)
# Macros of the grammar; DUR is a duration within five words, _ stands for one to twenty words.
MACROS = {
    "$WITHIN": "within|in|less than|equals to|during|for|during and for|<|< =|< / =|< or =",
    "$MORETHAN": "greater than|more than|at least|after|>|> =|> / =|> or =",
    "$PRIOR": "(since )?(since|prior|before)( to)?( for)?",
    "$EXCEPT": "except( for)?",
    "$AFTER": "after",
}
# Rules of the grammar as stage, name and pattern; the lowest stage goes first, then the order.
RULES = (
    (45, "WITHIN", "_ $WITHIN DUR"),
    (45, "MORETHAN_MT", "_ $MORETHAN DUR"),
    (20, "HISTORY_WITHIN", "history of _ $WITHIN DUR"),
    (20, "HISTORY_MT", "history of _ $MORETHAN DUR"),
    (10, "HISTORY_WITHIN_EF", "history of _ $WITHIN DUR2 $EXCEPT _"),
    (10, "HISTORY_MT_EF", "history of _ $MORETHAN DUR2 $EXCEPT _"),
    (10, "HISTORY_WITHIN_PT", "history of _ $WITHIN DUR2 $PRIOR _"),
    (10, "HISTORY_WITHIN_AF", "history of _ $WITHIN DUR2 $AFTER _"),
    (10, "HISTORY_MT_PT", "history of _ $MORETHAN DUR2 $PRIOR _"),
    (10, "HISTORY_MT_AF", "history of _ $MORETHAN DUR2 $AFTER _"),
    (40, "WITHIN_PT", "_ $WITHIN DUR2 $PRIOR _"),
    (40, "WITHIN_AF", "_ $WITHIN DUR2 $AFTER _"),
    (40, "MORETHAN_MT_PT", "_ $MORETHAN DUR2 $PRIOR _"),
    (40, "MORETHAN_MT_AF", "_ $MORETHAN DUR2 $AFTER _"),
    (40, "PRIOR_F", "prior _ for DUR"),
    (40, "PRIOR_AF", "_ after DUR2 _"),
    (10, "PRIOR_FEF", "prior _ for DUR2 $EXCEPT _"),
    (10, "PRIOR_FI", "prior _ for DUR2 including _"),
    (10, "PRIOR_MT", "prior _ for more than DUR"),
    (10, "CONCURRENT_EF", "concurrent _ for DUR"),
    (50, "PAST", "_ in the past DUR"),
    (50, "PRIOR_TO", "_ DUR2 $PRIOR _"),
    (20, "CONFIRMED_WITHIN", "histologically confirmed _ $WITHIN DUR"),
    (20, "CONFIRMED_MT", "histologically confirmed _ $MORETHAN DUR"),
    (20, "ATLEAST_PT", "at least DUR2 $PRIOR _"),
    (20, "ATLEAST_AF", "at least DUR2 $AFTER _"),
    (50, "ATLEAST_PT", "_ at least DUR2"),
    (20, "WITHIN", "negative _ $WITHIN DUR"),
    (20, "MORETHAN_MT", "negative _ $MORETHAN DUR"),
    (10, "WITHIN_PT", "negative _ $WITHIN DUR2 $PRIOR _"),
    (10, "MORETHAN_MT_PT", "negative _ $MORETHAN DUR2 $PRIOR _"),
    (20, "REQUIRED_FOR_PERIOD", "_ required .. for period DUR2 $PRIOR _"),
    (20, "POSITIVE_WITHIN", "positive _ $WITHIN DUR"),
    (10, "HISTORY_IN", "history of _ $WITHIN DUR including _"),
)
DURATION = r"\b([0-9]+)(?: *(?:-|/|to) *([0-9]+))? (hour|day|week|month|year)s?\b"


def split_criterion(text: str | None) -> list[str]:
    """Pieces of a criterion, first in first out, each tested anew from the top:

    three colons or more part it at every colon; then three or more parts by `` - ``; then a word
    "No" that is not first, a word "At" beyond the second, a word "Or" beyond the fourth. No piece
    is dropped; null gives none.
    """
    queue, out = deque([text or ""]), []
    while queue:
        piece = queue.popleft().strip()
        if not piece:
            continue
        if piece.count(":") >= 3:
            queue.extend(piece.split(":"))
            continue
        if len(parts := piece.split(" - ")) >= 3:
            queue.extend(parts)
            continue
        words = piece.split()
        for word, least in (("No", 1), ("At", 2), ("Or", 4), ("OR", 4)):
            at = next((i for i, w in enumerate(words) if w == word and i >= least), None)
            if at is not None:
                queue.extend([" ".join(words[:at]), " ".join(words[at:] if word in ("No", "At") else words[at + 1 :])])
                break
        else:
            out.append(piece)
    return out


def split_pieces(text: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([split_criterion(x) for x in s]), T.ArrayType(T.StringType()))(text)


def compile_rule(pattern: str) -> str:
    """A rule as a regular expression over words that a space follows, durations being ``dur#``."""
    words = r"(?:\S+ )"
    parts = {"_": words + "{1,20}", "..": words + "{0,20}", "DUR": words + "{0,5}(?:dur# )+", "DUR2": words + "{0,5}(?:dur# )+" + words + "{0,5}"}
    out = []
    for p in pattern.split():
        out.append(parts[p] if p in parts else f"(?:(?:{MACROS[p].replace('(', '(?:')}) )" if p in MACROS else re.escape(p) + " ")
    return "(?:^| )" + "".join(out)


def compile_rules(rules: Sequence[tuple[int, str, str]] = RULES) -> list[tuple[str, str]]:
    """``(name, expression)`` in the order in which they are tried."""
    return [(name, compile_rule(pattern)) for name, pattern in _in_order(rules)]


def _in_order(rules: Sequence[tuple[int, str, str]]) -> list[tuple[str, str]]:
    return [(name, pattern) for _, _, name, pattern in sorted((stage, i, name, pattern) for i, (stage, name, pattern) in enumerate(rules))]


def _meets(e: Column, pattern: str) -> Column:
    """Whether an encoded sentence meets a rule; the words that the rule cannot do without are looked for first."""
    needed = {"$EXCEPT": "except", "$AFTER": "after"}
    words = [needed.get(p, p) for p in pattern.split() if p in needed or p.isalpha() and p not in ("DUR", "_")]
    out = F.lit(True)
    for w in words:
        out = out & e.contains(w + " ")
    return out & e.rlike(compile_rule(pattern))


def compile_quantity(name: str, pattern: str) -> tuple[str, str]:
    """A quantity of the file: xxx becomes a word with a digit; names with ``(op)`` need no word boundaries."""
    body = "(?:" + pattern.lower().replace("xxx", r"\S*[0-9]+\S*") + ")"
    return name, body if "(op)" in name else r"\b" + body + r"\b"


def _head(s: Column, heads: Sequence[str]) -> Column:
    up = F.upper(s)
    return up.rlike("|".join(f"^{h}|\\b{h}\\b:|\\b{h}\\b.*:$" for h in heads))


_STATES = ("head", "inclusion", "exclusion", "both", "disease", "patient", "prior")


def _walk(codes: pd.Series) -> pd.DataFrame:
    """Labels and sub-titles of the sentences of each text from the heads and bullets they show."""
    labels, subs = [], []
    for text in codes:
        state, sub, lab, of = "head", -1, [], []
        for i, c in enumerate(text):
            seen = {k: bool(c >> n & 1) for n, k in enumerate(HEADS)}
            main = state in ("inclusion", "exclusion")
            opened = next((k for k in ("inclusion", "exclusion") if seen[k] and state != k), None)
            if opened is None and not main:
                opened = next((k for k in ("disease", "patient", "prior") if seen[k] and state != k), None)
                if opened is None and seen["both"] and state == "head":
                    opened = "both"
            if opened:
                state = opened
            lab.append(HEAD_LABELS.get(opened, LABELS[state]) if opened else LABELS[state])
            if c >> len(HEADS) & 1:
                of.append(sub)
            else:
                of.append(-1)
                sub = i
        labels.append(lab)
        subs.append(of)
    return pd.DataFrame({"label": labels, "sub": subs})


def criteria_rows(trials: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, sent, s, label, sub)``: sentences of over two characters with the label of their
    section, and for items of a list the number of the sentence before the list, else -1.

    Texts are cut at ``#``, line ends and sentence ends; leading punctuation is no part of a
    sentence. Null and empty texts give no row.
    """
    d = trials.select(F.col(doc_id).alias("doc_id"), F.split(F.col(text), r"(?<=[.?!])\s+|[\n#]+").alias("all")).filter("all is not null")
    kept = F.filter(F.transform("all", lambda s: F.trim(s)), lambda s: F.length(s) > 2)
    d = d.select("doc_id", kept.alias("raw")).filter(F.size("raw") > 0)
    d = d.withColumn("s", F.transform("raw", lambda s: F.regexp_replace(s, r"^[!-/:-@\[-`{-~\s]*", "")))
    code = lambda s, r: sum((F.when(_head(s, h), F.lit(1 << n)).otherwise(F.lit(0)) for n, h in enumerate(HEADS.values())), F.when(r.rlike(BULLET), F.lit(1 << len(HEADS))).otherwise(F.lit(0)))
    d = d.withColumn("codes", F.zip_with("s", "raw", code))
    walked = F.pandas_udf(_walk, T.StructType([T.StructField("label", T.ArrayType(T.StringType())), T.StructField("sub", T.ArrayType(T.LongType()))]))
    d = d.select("doc_id", "s", walked("codes").alias("w"))
    rows = d.select("doc_id", F.posexplode(F.arrays_zip("s", F.col("w.label").alias("label"), F.col("w.sub").alias("sub"))).alias("sent", "x"))
    return rows.select("doc_id", F.col("sent").cast("bigint").alias("sent"), F.col("x.s").alias("s"), F.col("x.label").alias("label"), F.col("x.sub").alias("sub"))


def first_quantity(s: Column, quantities: Sequence[tuple[str, str]] = QUANTITIES) -> Column:
    """The first quantity whose notation occurs, ``None`` where there is none."""
    low, out = F.lower(s), None
    for name, p in (compile_quantity(*q) for q in quantities):
        out = F.when(low.rlike(p), name) if out is None else out.when(low.rlike(p), name)
    return F.lit("None") if out is None else out.otherwise("None")


def all_quantities(s: Column, quantities: Sequence[tuple[str, str]] = QUANTITIES) -> Column:
    low = F.lower(s)
    return F.array_join(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in (compile_quantity(*q) for q in quantities)])), "|")


def encode(s: Column) -> Column:
    """Words in lower case, each with a space behind it; comparison signs are words, durations ``dur#``."""
    t = F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}<>=/ -]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"([<>=/])", " $1 "), " +", " ")
    return F.concat(F.trim(F.regexp_replace(F.regexp_replace(t, DURATION, " dur# "), " +", " ")), F.lit(" "))


def match_patterns(rows: DataFrame, rules: Sequence[tuple[int, str, str]] = RULES) -> DataFrame:
    """``(doc_id, sent, label, pattern, low_s, high_s, low_m, high_m, neg, neg_ahead)`` of sentences
    with a duration that a rule matches; the first rule by stage and order counts.

    A range of the first duration gives both bounds; else names with ``_MT`` or ``_AF`` state a lower
    bound, the others an upper one, and the open side is -1. Months are rounded. ``neg`` counts words
    that deny, ``neg_ahead`` those before the duration.
    """
    e = rows.select("doc_id", "sent", "label", "s", encode(F.col("s")).alias("e")).filter(F.col("e").contains("dur#"))
    name = None
    for rule, p in _in_order(rules):
        hit = _meets(F.col("e"), p)
        name = F.when(hit, rule) if name is None else name.when(hit, rule)
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("s"), r"[^\p{L}\p{N}<>=/ -]", " "), r"([<>=/])", " $1 "), " +", " ")
    part = lambda k: F.regexp_extract("flat", DURATION, k)
    # exploded, so that no filter brings the rules into the plan a second time
    out = e.select("*", F.explode(F.array_compact(F.array(name))).alias("pattern")).withColumn("flat", flat).withColumn("unit", part(3))
    sign = F.when(F.col("unit") == "hour", "PT%H").when(F.col("unit") == "day", "P%D").when(F.col("unit") == "week", "P%W").when(F.col("unit") == "month", "P%M").otherwise("P%Y")
    span = lambda k: X.period_seconds(F.replace(sign, F.lit("%"), part(k)))
    out = out.withColumn("a", span(1)).withColumn("b", F.when(part(2) != "", span(2)))
    lower, none = F.col("pattern").rlike("_(?:MT|AF)"), F.lit(-1).cast("bigint")
    out = out.withColumn("low_s", F.when(F.col("b").isNotNull() | lower, F.col("a")).otherwise(none)).withColumn("high_s", F.when(F.col("b").isNotNull(), F.col("b")).when(lower, none).otherwise(F.col("a")))
    count = lambda t: F.regexp_count(t, F.lit(NEGATIONS)).cast("bigint")
    return out.select("doc_id", "sent", "label", "pattern", "low_s", "high_s", X.to_months(F.col("low_s")).alias("low_m"), X.to_months(F.col("high_s")).alias("high_m"), count(F.col("e")).alias("neg"), count(F.substring_index("e", "dur#", 1)).alias("neg_ahead"))


def keyword_hits(rows: DataFrame, keywords: DataFrame, longest: int = 5) -> DataFrame:
    """``(doc_id, sent, root, cui, keyword)``: a row per keyword of up to ``longest`` words that stands
    in the sentence, and one with nulls for a sentence without any.

    ``keywords`` has ``root``, ``cui`` and ``keyword``; the grams of a sentence meet it by equality,
    so its size does not matter.
    """
    k = cut(keywords.select("root", "cui", X.normalize(F.col("keyword")).alias("keyword")).filter("keyword <> ''").distinct())
    w = X.word_array(X.normalize(F.col("s")))
    r = rows.select("doc_id", "sent", w.alias("w")).filter(F.size("w") > 0)
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), " ")))))
    hits = meet(r.select("doc_id", "sent", F.explode(grams).alias("keyword")), k, ["keyword"])
    return rows.select("doc_id", "sent").join(hits, ["doc_id", "sent"], "left").select("doc_id", "sent", "root", "cui", "keyword")
