"""Whether a text that lacks its end mark is whole, learned from the endings of the corpus itself.

Every word place of every text is counted under four contexts: the word with the opening of its
clause, the place after a word in such a clause, the word with the one before it, and the word
alone. Each count knows how often a sentence ended there and how often it went on. A text without
an end mark is then judged by the most specific context that was seen often enough; a last word
that no text uses elsewhere is a broken one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..runtime import cut, meet, spread

SEEN = 4  # places from which a context counts as known
ENDS = 0.08  # share of them that end a sentence, below which a text that stops there was cut
BREAKS = 0.1  # weight of a clause break against an end
KEYS_HELD = 200_000  # counters a task keeps before it hands them on
WORDS_HELD = 200_000  # words whose bare form a task remembers

_SENTENCE = re.compile(r"(?<=[.?!…])[\"'”’)\]]*\s+|\n+")
_CLAUSE = re.compile(r"[,;:]\s+|\s[-–—]+\s")
_OUTER = re.compile(r"^\W+|\W+$")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_END = re.compile(r"[.?!。]['\"”’)\]*_]*\s*$")
_MAY_MORE = re.compile(r"[.…\])]\s*$")
_MORE = r"(?:\s*(?:\.\.+|…|\[(?:more|read more|continued|\.\.\.|…)\]|\((?:cont\.?|cont'd|continued|more)\)))+\s*$"  # signs that text was left out
_TAIL = re.compile(r"(?:\s+(?:[^\w\s]+[\w)(]?|#\w+))+$")  # smileys, hearts, dashes, hashtags


def has_end(text: Column) -> Column:
    """Whether the text ends with an end mark, closing quotes or brackets aside; dots that stand for
    more text are none."""
    return F.regexp_replace(text, _MORE, "").rlike(r"[.?!。]['\"”’)\]*_]*\s*$")


@lru_cache(WORDS_HELD)
def _bare(word: str) -> str:
    return word if word.isalpha() else _OUTER.sub("", _NUMBER.sub("0", word))


def words(part: str) -> list[str]:
    return [w for w in map(_bare, part.lower().split()) if w]


MID, BREAK, END, OPEN = range(4)  # after a word: another word, a clause break, the sentence's end, the open end of the text


_LEFT_OUT = re.compile(_MORE)


def sentences(text: str) -> Iterator[tuple[list[list[str]], str, bool]]:
    """Clauses of each sentence, the sentence, whether it is closed."""
    if _MAY_MORE.search(text):
        text = _LEFT_OUT.sub("", text)
    parts = [p for p in _SENTENCE.split(text) if p and not p.isspace()]
    for k, sentence in enumerate(parts):
        closed = k + 1 < len(parts) or bool(_END.search(sentence))
        yield [c for c in (words(x) for x in _CLAUSE.split(_TAIL.sub("", sentence))) if c], sentence, closed


def places(text: str) -> Iterator[tuple[list[str], int, str, int]]:
    """Clause, place in it, whole last sentence, what comes after the place."""
    for clauses, sentence, closed in sentences(text):
        for j, clause in enumerate(clauses):
            for i in range(len(clause)):
                after = MID if i + 1 < len(clause) else BREAK if j + 1 < len(clauses) else END if closed else OPEN
                yield clause, i, sentence, after


def contexts(clause: list[str], i: int) -> tuple[str, str, str, str]:
    # the opening is what a text cut right here would show of it
    opening, before, w = " ".join(clause[:2] if i else clause[:1]), clause[i - 1] if i else "", clause[i]
    return f"A {opening}|{w}", f"D {opening}|{before}", f"B {before}|{w}", f"C {w}"


def open_end(text: str) -> tuple[str | None, ...] | None:
    """The contexts of the last word of a text without an end mark, those of the two words before,
    the word, its sentence, and whether the text breaks off visibly (at a comma, inside a bracket
    or quote that nothing closes, with a sign that text was left out)."""
    last = None
    for clause, i, sentence, after in places(text):
        if after == OPEN:
            last = clause, i, sentence
    if last is None:
        return None
    clause, i, sentence = last
    back = [contexts(clause, i - k) if i >= k else (None, None, None, None) for k in (1, 2)]
    tail = text.rstrip()
    stack: list[str] = []
    for ch in tail:
        if ch in "([{":
            stack.append(ch)
        elif ch in ")]}" and stack and stack[-1] == {")": "(", "]": "[", "}": "{"}[ch]:
            stack.pop()
    start = tail[:1]
    left_out = bool(_LEFT_OUT.search(text))
    unclosed = bool(stack) or (start == '"' and tail.count('"') % 2 == 1)
    return (*contexts(clause, i), back[0][0], back[0][1], back[1][0], clause[i], "S " + " ".join(words(sentence)), tail.endswith((",", ";")) or unclosed or left_out)


_COUNTS = ("mid", "brk", "end", "open")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list[int]] = {}

    def flush() -> pd.DataFrame:
        out = pd.DataFrame([(k, *v) for k, v in held.items()], columns=["ctx", *_COUNTS])
        held.clear()
        return out

    for batch in batches:
        for text, times in Counter(t for t in batch["text"].tolist() if t).items():
            for clauses, sentence, closed in sentences(text):
                last = len(clauses) - 1
                for j, clause in enumerate(clauses):
                    end = BREAK if j < last else END if closed else OPEN
                    first, before, opening = clause[0], "", clause[0]
                    for i, w in enumerate(clause):
                        after = MID if i + 1 < len(clause) else end
                        for ctx in (f"A {opening}|{w}", f"D {opening}|{before}", f"B {before}|{w}", f"C {w}"):  # as in contexts()
                            got = held.get(ctx)
                            if got is None:
                                got = held[ctx] = [0, 0, 0, 0]
                            got[after] += times
                        before = w
                        if i == 0 and len(clause) > 1:
                            opening = f"{first} {clause[1]}"
                if clauses and not closed:
                    held.setdefault("S " + " ".join(words(sentence)), [0, 0, 0, 0])[OPEN] += times
            if len(held) > KEYS_HELD:
                yield flush()
    yield flush()


def ending_counts(texts: DataFrame, column: str) -> DataFrame:
    """``(ctx, mid, brk, end, open)``: how often each context went on, broke, ended, or was left open."""
    parts = texts.select(F.col(column).cast("string").alias("text")).mapInPandas(_count, "ctx string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return cut(parts.groupBy("ctx").agg(*[F.sum(c).alias(c) for c in _COUNTS]))


_KINDS = ("A", "D", "B", "C", "P", "Q", "R")
_OPEN = T.StructType([T.StructField(c, T.StringType()) for c in (*_KINDS, "w", "S")] + [T.StructField("broken", T.BooleanType())])


def _open(text: pd.Series) -> pd.DataFrame:
    rows = [open_end(t) if t else None for t in text]
    return pd.DataFrame([(None,) * 10 if r is None else r for r in rows], columns=_OPEN.names)


def judge_open_ends(texts: DataFrame, key: str, column: str, counts: DataFrame, sure: float = ENDS) -> DataFrame:
    """``(key, broken, chance)`` of every text of ``texts`` without an end mark.

    ``broken`` is set where the text stops inside a word or a sentence; ``chance`` is the share of
    sentence ends among the places of the context that decided, for callers with more evidence.
    """
    # materialised before the texts are looked into and after, so that each is looked into once
    open_ = cut(texts.filter(~has_end(F.col(column))).select(F.col(key).alias("key"), F.col(column).cast("string").alias("t")))
    open_ = cut(spread(open_, "t").select("key", F.pandas_udf(_open, _OPEN)("t").alias("o")).filter("o.w is not null"))
    asked = open_.select("key", "o.broken", "o.w", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"o.{k}").alias("ctx")) for k in (*_KINDS, "S")])).alias("q"))
    asked = asked.select("key", "broken", "w", "q.kind", "q.ctx").filter("ctx is not null")
    # contexts are distinct when they meet their counts, and even when these come back to the texts
    known = cut(asked.select("ctx").distinct().join(counts, "ctx"))  # counted and joined
    got = meet(asked, known, ["ctx"], "left")
    per = lambda kind, c: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    wide = got.groupBy("key", "broken", "w").agg(*[per(k, c).alias(f"{k}_{c}") for k in (*_KINDS, "S") for c in _COUNTS])
    # how much longer words that begin like the last word are used: beginnings of the lengths that are asked for
    last = open_.select(F.col("o.w").alias("w")).distinct()
    lengths = sorted(r[0] for r in last.select(F.length("w")).distinct().collect())  # as many as lengths of words
    used = counts.filter(F.col("ctx").startswith("C ")).select(F.expr("substring(ctx, 3)").alias("v"), (F.col("mid") + F.col("brk") + F.col("end")).alias("n")).filter("n > 0")
    begins = used.select(F.explode(F.transform(F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda k: k < F.length("v")), lambda k: F.substring(F.col("v"), F.lit(1), k))).alias("w"), "n")
    mass = cut(meet(begins, last.withColumn("here", F.lit(True)), ["w"]).groupBy("w").agg(F.sum("n").alias("mass")))
    wide = meet(wide, mass, ["w"], "left").withColumn("mass", F.coalesce("mass", F.lit(0)))
    # a text is seldom cut right at a clause break, so breaks weigh little against ends
    n = lambda k: F.col(f"{k}_mid") + F.col(f"{k}_brk") * BREAKS + F.col(f"{k}_end")
    share = lambda k: F.when(F.col(f"{k}_mid") + F.col(f"{k}_brk") + F.col(f"{k}_end") >= SEEN, F.col(f"{k}_end") / n(k))
    uses = F.col("C_mid") + F.col("C_brk") + F.col("C_end")
    often = (F.col("C_open") >= 5) & (F.col("C_open") > F.col("mass") * 0.02)  # ends open too often to be a fragment
    stock = (F.col("S_open") >= 5) & often & (F.col("A_mid") + F.col("A_brk") == 0)  # a close that texts use again and again
    added = often & (F.col("B_mid") == 0) & ((F.col("C_open") > 4 * uses) | (F.greatest(share("P"), share("Q"), share("R")) >= ENDS))  # a word after a whole sentence
    fragment = (uses < 2) & ~often & (F.col("mass") > 0)
    chance = (
        F.when(stock | added, 1.0)
        .when(fragment, 0.0)
        .otherwise(F.coalesce(share("A"), F.least(share("D"), share("B")), share("C"), F.when(uses == 0, 0.0), F.lit(0.5)))
    )
    return wide.select("key", F.when(F.col("broken"), 0.0).otherwise(chance).alias("chance")).select("key", (F.col("chance") < sure).alias("broken"), "chance")
