"""Markup left in text: which kinds a field holds, and the text without them.

Headings, list items, code and formulas stay, in one plain notation. What the pages of a host
repeat is found in its suffix array: the suffixes of the pages' token streams, sorted to a depth of
``RUN`` tokens. Equal neighbours in this order are repeated substrings of that length, and those of
several distinct pages are boilerplate; longer ones are the union of overlapping ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut, meet, spread

RUN = 20  # tokens from which a repeated substring is long
PAGES = 3  # distinct pages that must share it
TOKENS_HELD = 500_000  # different tokens whose hash a task remembers

# Names of HTML elements.
TAGS = (
    "a abbr b big blockquote body br center cite code dd del div dl dt em font form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins "
    "label li link meta nav ol p pre q s script section small span strike strong style sub sup table tbody td th thead title tr tt u ul video footer main article"
)

_TAG = r"(?i)</?(?:" + "|".join(TAGS.split()) + r")(?:\s[^<>]*)?/?>"
_COMMENT = r"(?s)<!--.*?-->"
_ENTITY = r"&(?:#\d{1,6}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,8}\d?);"
_HTML = (_TAG, r"<!--", _ENTITY)
_LATEX = (
    r"\\[a-zA-Z]+\*?\s*[{\[]",
    r"\\(?:item|alpha|beta|gamma|delta|mu|sigma|pm|cdot|approx|leq|geq|times|to|infty|noindent|newline|ldots|dots|par|hline|centering|maketitle)\b",
    r"\\[\[(]",
    r"\$[^$\n]*[\\^_{}=][^$\n]*\$",
)
_WIKI = (
    r"\[\[[^\[\]\n]+\]\]",
    r"\{\{[^{}\n]+\}\}",
    r"'''?[^'\n]+'''?",
    r"(?m)^={1,6}[^=\n]+={1,6}[ \t]*$",
    r"\[(?:https?|ftp)://[^\s\]]+(?: [^\]\n]*)?\](?!\()",
    r"(?m)^\{\|",
    r"(?m)^# .*\n# ",
    r"(?i)</?(?:ref|nowiki)\b[^<>]*>",
    r"__(?:TOC|NOTOC|NOEDITSECTION)__",
)
_MARKDOWN = (
    r"\*\*[^*\s](?:[^*\n]*[^*\s])?\*\*",
    r"(?<![\w*])\*[^\s*](?:[^*\n]*[^\s*])?\*(?![\w*])",
    r"(?<!\w)__[^_\s](?:[^_\n]*[^_\s])?__(?!\w)",
    r"(?<![\w^_])_[^_\s](?:[^_\n]*[^_\s])?_(?![\w^_])",
    r"~~[^~\s](?:[^~\n]*[^~\s])?~~",
    r"`[^`\n]+`",
    r"(?m)^(?:```|~~~)",
    r"!?\[[^\[\]\n]*\]\([^)\s]+\)",
    r"(?<![\w\]])\[[^\[\]\n]+\]\[[^\[\]\n]*\]",
    r"(?m)^\[[^\]\n]+\]:\s+\S",
    r"(?m)(?<!^# .{0,200}\n)^#{1,6} \S.*$(?!\n# )",
    r"(?m)^>+ ?\S",
    r"(?m)^\S.*\n(?:={4,}|-{4,})[ \t]*$",
    r"(?m)^\|[^\n]*\|[ \t]*\n\|[ \t]*:?-{3,}",
    r"(?m)^(?:-{3,}|\*{3,}|_{3,})[ \t]*$",
)
_LIST = r"(?m)^[ \t]*(?:[-+*]|\d{1,3}[.)]) \S"


# A sign that each pattern cannot do without, in the order of the patterns; it is looked for first.
_NEEDLES = {
    "html": ("<", "<!--", "&"),
    "latex": ("\\", "\\", "\\", "$"),
    "wiki": ("[[", "{{", "''", "=", "[", "{|", "# ", "<", "__"),
    "markdown": ("**", "*", "__", "_", "~~", "`", "``` ~~~ ~~~", "](", "][", "]:", "#", ">", "==== ---- ----", "|", "--- *** ___"),
}


def _any(text: Column, kind: str, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle, p in zip(_NEEDLES[kind], patterns, strict=True):
        signs = needle.split(" ") if needle.count(" ") > 1 else [needle]
        found = found | (reduce(or_, [text.contains(x) for x in signs]) & text.rlike(p))
    return found


def markup_kinds(fields: DataFrame, text: str, into: str) -> DataFrame:
    """``fields`` with ``into``: a sorted array of ``html``, ``latex``, ``markdown``, ``wiki`` found in ``text``; empty for null.

    List signs belong to the kind of the text around them: to wiki where its other signs stand,
    to Markdown where no other kind does. Each step is a column of its own, so that it is computed once.
    """
    out = fields.withColumn("__t", F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"))
    t = F.col("__t")
    for kind, patterns in (("html", _HTML), ("latex", _LATEX), ("wiki", _WIKI)):
        out = out.withColumn(f"__{kind}", _any(t, kind, patterns))
    other = F.col("__html") | F.col("__latex") | F.col("__wiki")
    out = out.withColumn("__markdown", _any(t, "markdown", _MARKDOWN) | (~other & t.rlike(_LIST)))
    kinds = F.array(*[F.when(F.col(f"__{k}"), F.lit(k)) for k in ("html", "latex", "markdown", "wiki")])
    return out.withColumn(into, F.array_compact(kinds)).drop("__t", "__html", "__latex", "__wiki", "__markdown")


_HTML_STEPS = (
    (_COMMENT, ""),
    (r"(?is)<(script|style)\b[^<>]*>.*?</\1>", ""),
    (r"(?is)<pre[^<>]*>\s*(?:<code[^<>]*>)?(.*?)(?:</code>)?\s*</pre>", "\n```\n$1\n```\n"),
    (r"(?s)\\begin\{(?:verbatim|lstlisting)\}\n?(.*?)\n?\\end\{(?:verbatim|lstlisting)\}", "\n```\n$1\n```\n"),
    (r"(?i)<h([1-6])[^<>]*>\s*", "\n# "),
    (r"(?i)<li[^<>]*>\s*", "\n- "),
    (r"(?i)</?(?:p|div|br|h[1-6]|ul|ol|blockquote|tr|table|li)\b[^<>]*/?>", "\n"),
    (r"(?i)</t[dh]>\s*<t[dh][^<>]*>", " | "),
    (r"(?i)</?(?:code|tt)\b[^<>]*>", "`"),
    (_TAG, ""),
)
_LATEX_STEPS = (
    (r"(?s)\\begin\{(?:equation|align|displaymath)\*?\}\s*(.*?)\s*\\end\{(?:equation|align|displaymath)\*?\}", "\n\\$\\$$1\\$\\$\n"),
    (r"(?s)\\\[\s*(.*?)\s*\\\]", "\\$\\$$1\\$\\$"),
    (r"(?s)\\\(\s*(.*?)\s*\\\)", "\\$$1\\$"),
    (r"\\(?:sub)*section\*?\{([^{}]*)\}", "\n# $1\n"),
    (r"\\begin\{[^{}]*\}(?:\[[^\]]*\])?\s*|\\end\{[^{}]*\}\s*", ""),
    (r"[ \t]*\\item\s+", "\n- "),
    (r"~?\\(?:cite|ref|label|footnote)\{[^{}]*\}", ""),
    (r"\\(?:textbf|textit|emph|underline|texttt|text)\{([^{}]*)\}", "$1"),
)
_WIKI_STEPS = (
    (r"(?m)^(={1,6})\s*([^=\n]+?)\s*={1,6}[ \t]*$", "# $2"),
    (r"\[\[(?:File|Image|Category):[^\[\]|\n]*(?:\|[^\[\]|\n]*)*\|([^\[\]|\n]*)\]\]", "$1"),
    (r"\[\[[^\[\]|\n]*\|([^\[\]\n]*)\]\]", "$1"),
    (r"\[\[([^\[\]\n]*)\]\]", "$1"),
    (r"\{\{[^{}|\n]*\|([^{}\n]*)\}\}", "$1"),
    (r"\{\{[^{}\n]*\}\}", ""),
    (r"\[(?:https?|ftp)://[^\s\]]+ ([^\]\n]*)\](?!\()", "$1"),
    (r"'''([^'\n]+)'''", "$1"),
    (r"''([^'\n]+)''", "$1"),
    (r"(?m)^\{\|[^\n]*\n|^\|\}[ \t]*$|^\|-[ \t]*\n", ""),
    (r"(?m)^[!|] ?(.*?) ?(?:\|\||!!) ?", "$1 | "),
)
_MARKDOWN_STEPS = (
    (r"(?m)^~~~.*$", "```"),
    (r"(?m)^(\S.*)\n(?:={4,}|-{4,})[ \t]*$", "# $1"),
    (r"(?m)^#{2,6} ", "# "),
    (r"!?\[([^\[\]\n]*)\]\([^)\s]+\)", "$1"),
    (r"(?<![\w\]])\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", "$1"),
    (r"\*{1,3}([^*\s](?:[^*\n]*[^*\s])?)\*{1,3}", "$1"),
    (r"(?<!\w)__([^_\s](?:[^_\n]*[^_\s])?)__(?!\w)", "$1"),
    (r"(?<![\w^_])_([^_\s](?:[^_\n]*[^_\s])?)_(?![\w^_])", "$1"),
    (r"~~([^~\n]+)~~", "$1"),
    (r"(?m)^>+ ?", ""),
    (r"(?m)^\|[ \t:|-]+\|[ \t]*$\n?", ""),
    (r"(?m)^[ \t]*[-+*] +", "- "),
)
_ENTITY_STEPS = (
    (r"&nbsp;|&#160;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;|&#34;", "\""), (r"&#39;|&apos;", "'"), (r"&mdash;", "\u2014"), (r"&amp;", "&"), (_ENTITY, ""),
    (r"(?i)</?(?:b|i|em|strong|u|p|br)>", ""),
)
_SPACE_STEPS = (
    (r"[ \t]{2,}", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
)


def clean_column(fields: DataFrame, text: str, kinds: str, into: str) -> DataFrame:
    """``fields`` with ``into``: ``text`` without markup, ``#`` before headings, ``-`` before list items,
    code in fences or backquotes, formulas between dollar signs. Null stays null.

    Only a text of some kind is rewritten; each notation's steps are a projection of their own that a
    text without its sign passes by.
    """
    marked = F.size(kinds) > 0
    out = fields.withColumn(into, F.regexp_replace(text, "\r\n?", "\n"))
    for sign, steps in (("<", _HTML_STEPS), ("\\\\", _LATEX_STEPS), (r"[=\[{'!|]", _WIKI_STEPS), (r"[-=~#\[*_>|+]", _MARKDOWN_STEPS), ("[&<]", _ENTITY_STEPS)):
        out = out.withColumn(into, F.when(marked & F.col(into).rlike(sign), _rewrite(F.col(into), steps)).otherwise(F.col(into)))
    return out.withColumn(into, _rewrite(F.col(into), _SPACE_STEPS))


def _rewrite(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def window_hashes(hosts: list[str], texts: list[str], run: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Page, start and hash of each ``run`` tokens of the texts, mixed with the hash of the host."""
    flat: list[int] = []
    sizes = []
    for text in texts:
        w = text.split()
        sizes.append(len(w))
        for x in w:
            h = known.get(x)
            if h is None:
                if len(known) >= TOKENS_HELD:
                    known.clear()
                h = known[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
            flat.append(h)
    size = np.array(sizes, dtype=np.int64)
    t = np.array(flat, dtype=np.uint64)
    n = len(t) - run + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    acc, power = np.zeros(n, np.uint64), 1
    for j in range(run):
        acc += t[j : j + n] * np.uint64(power)
        power = power * 0x9E3779B97F4A7C15 % 2**64
    page = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
    whole = at[:n] + run <= size[page[:n]]
    host = np.array([xxhash.xxh3_64_intdigest((h or "").encode("utf-8", "surrogatepass")) for h in hosts], dtype=np.uint64)
    page, at = page[:n][whole], at[:n][whole]
    mixed = (acc[whole] ^ host[page]) * np.uint64(0xFF51AFD7ED558CCD)
    return page, at, (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def suffix_runs(pages: DataFrame, host: str, page: str, text: str, run: int = RUN, pages_min: int = PAGES) -> DataFrame:
    """``(host, prefix, page, at)`` of the suffixes whose first ``run`` tokens ``pages_min`` distinct
    pages of their host share; ``prefix`` holds these tokens, so rows in order of host and prefix are
    the repeated part of the host's suffix array.

    Suffixes are first counted by the hash of their prefix, pre-aggregated in each task, so a run that
    a third of all pages hold is counted before it is shuffled and what is unique goes no further.
    The others are then compared token by token. Copies of a page are one page.
    """
    held = pages.select(F.col(host).cast("string").alias("host"), F.col(page).alias("page"), F.col(text).alias("t")).filter(F.col("t").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            of, _, suffix = window_hashes(b["host"].tolist(), b["t"].tolist(), run, known)
            own = np.unique(np.stack([of, suffix], axis=1), axis=0)[:, 1] if len(of) else suffix  # once per page
            u, n = np.unique(own, return_counts=True)
            yield pd.DataFrame({"suffix": u, "n": n})

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            of, at, suffix = window_hashes(b["host"].tolist(), b["t"].tolist(), run, known)
            yield pd.DataFrame({"suffix": suffix, "page": b["page"].to_numpy()[of], "at": at})

    heads = cut(held.mapInPandas(count, "suffix bigint, n bigint").groupBy("suffix").agg(F.sum("n").alias("n")).filter(F.col("n") >= pages_min).select("suffix"))
    schema = "host string, prefix string, page bigint, at bigint"
    if heads.isEmpty():
        return pages.sparkSession.createDataFrame([], schema)
    found = meet(held.select("host", "page", "t").mapInPandas(places, "suffix bigint, page bigint, at bigint"), heads, ["suffix"]).select("page", "at").distinct()
    texts = held.dropDuplicates(["page"]).withColumn("w", F.split(F.trim("t"), r"\s+"))
    tokens = cut(found.join(texts, "page").select("host", F.array_join(F.slice("w", (F.col("at") + 1).cast("int"), run), " ").alias("prefix"), "page", "at"))
    same = cut(tokens.select(F.coalesce("host", F.lit("")).alias("h"), "prefix", "page").distinct().groupBy("h", "prefix").agg(F.count("*").alias("pages")).filter(F.col("pages") >= pages_min).drop("pages"))
    return meet(tokens.withColumn("h", F.coalesce("host", F.lit(""))), same, ["h", "prefix"]).select("host", "prefix", "page", "at")


def boilerplate_spans(pages: DataFrame, host: str, page: str, text: str, run: int = RUN, pages_min: int = PAGES) -> DataFrame:
    """``(page, start, tokens)``: the maximal stretches of each page that repeated substrings cover."""
    at = suffix_runs(pages, host, page, text, run, pages_min).select("page", "at").distinct()
    starts = at.groupBy("page").agg(F.sort_array(F.collect_list("at")).alias("a"))  # places of one page
    # a stretch begins where the start before is more than a run behind, and ends a run after its last start
    gap = F.filter(F.sequence(F.lit(0), F.size("a") - 1), lambda i: (i == 0) | (F.get("a", i) - F.get("a", i - 1) > run))
    cuts = starts.withColumn("g", gap).withColumn("g2", F.concat(F.slice("g", 2, F.size("g")), F.array(F.size("a"))))
    spans = F.transform(F.arrays_zip("g", "g2"), lambda z: F.struct(F.get("a", z["g"]).alias("start"), (F.get("a", z["g2"] - 1) + run - F.get("a", z["g"])).alias("tokens")))
    return cuts.select("page", F.explode(spans).alias("s")).select("page", "s.start", "s.tokens")


def _without(text: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
    import re

    out = []
    for t, s, n in zip(text, starts, sizes, strict=True):
        words = re.split(r"(?<=\s)(?=\S)", t)
        keep = np.ones(len(words), bool)
        for a, k in zip(s, n, strict=True):
            keep[a : a + k] = False
        out.append("".join(w for w, k in zip(words, keep, strict=True) if k).strip())
    return pd.Series(out, dtype="object")


def strip_markup(fields: DataFrame, host: str, key: list[str], text: str) -> DataFrame:
    """``(key.., kinds, clean, boilerplate)`` of every distinct key and text.

    ``clean`` is without markup and without the host's boilerplate; ``boilerplate`` counts the
    tokens taken out; ``kinds`` are those of the text unless boilerplate covers all of it. Null
    texts keep null with no kinds; a null host is a host of its own; repeated rows count once.
    """
    base = fields.select(*key, F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("raw")).withColumn("slot", F.xxhash64(*key))
    base = clean_column(markup_kinds(spread(base, "slot"), "raw", "found"), "raw", "found", "clean").withColumn("page", F.xxhash64(F.coalesce("host", F.lit("")), "clean"))
    base = cut(base.select(*key, "host", "found", "clean", "page"))  # rewritten once, read for suffixes and rows
    spans = boilerplate_spans(base, "host", "page", "clean").groupBy("page").agg(F.collect_list(F.struct("start", "tokens")).alias("s"))
    spans = cut(spans.select("page", F.col("s.start").alias("starts"), F.col("s.tokens").alias("sizes")))
    if spans.isEmpty():
        rows = base.withColumn("boilerplate", F.lit(0).cast("bigint"))
    else:
        joined = meet(base, spans, ["page"], "left")
        taken = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x)
        held = joined.filter("starts is not null").withColumn("clean", F.pandas_udf(_without, "string")("clean", "starts", "sizes")).withColumn("boilerplate", taken)
        held = held.withColumn("found", F.when(F.col("clean") == "", F.array().cast("array<string>")).otherwise(F.col("found")))
        rows = joined.filter("starts is null").withColumn("boilerplate", F.lit(0).cast("bigint")).unionByName(held)
    return rows.select(*key, F.col("found").alias("kinds"), "clean", "boilerplate").distinct()
