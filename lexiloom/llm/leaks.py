"""Evaluation texts inside a corpus: multi-pattern search over words by block shifts.

Items of equal words are one text, and passages that several texts share are counted over all of
them before the set is cut into blocks of bounded size; one shift table, built over the word windows
of a block, goes with each pass over the corpus. What comes out does not depend on the blocks. A text position whose last two words end no window is
skipped by as much as the table allows; positions that may end one look their windows up by the
hash of these words and are compared directly. Every window counts, however many items have it:
items with too few hits to be held to a third are left out by count, and the hits of the others fix
the diagonals of text against item, along which whole pieces are compared word by word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.ordering import prefix_sums
from ..runtime import cut, meet, spread

WINDOW = 3  # words of a search pattern; a piece with one word in five changed still has so many equal in a row
PIECE = 8  # a shorter piece counts for nothing
SHARE = 3  # one item word in so many must be held
HITS = 5  # a piece of n words has a window in n / HITS places at least, whichever of its words are changed
MOSTLY = 2  # more than one item word in so many, in unchanged pieces, is the item, whoever shares it
SHARED_BY = 3  # a passage that so many different texts have is stock
PASSAGE = 4  # words of the shortest passage that is looked at; the next is twice as long, and so on
WORDS_PER_PASS = 500_000  # bound of what one pass broadcasts, in words; a longer text has a pass of its own

_LINK = re.compile(r"\]\s?\((?:https?:)?[^)\s]*\)|\[\[[^\]|\[]*\|")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>|<!--.*?-->|&[a-zA-Z]{2,8};|&#\d+;", re.S)
_INNER = re.compile(r"(?<=\w)['’.,\-‐‑–](?=\w)")  # what stripped punctuation leaves without a gap
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text without its inline markup."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _TAG.sub("", text)
    if "[" in text or "](" in text:
        text = _LINK.sub("", text)
    return _WORD.findall(_INNER.sub("", text).lower())


class BlockShifts:
    """Shift table over the ``WINDOW``-word windows of items, blocks being two words."""

    def __init__(self, items: Sequence[tuple[int, list[str], Sequence[int] | None]]):
        """Items as ``(id, words, own)`` with the words of the least passage at each place that is not stock, see ``chained``."""
        self.words = {item: w for item, w, _ in items}
        self.own = {item: own for item, _, own in items}
        self.windows: dict[tuple[str, ...], tuple[list[int], list[int]]] = {}
        for item, w, _ in items:
            for at in range(len(w) - WINDOW + 1):
                of, places = self.windows.setdefault(tuple(w[at : at + WINDOW]), ([], []))
                of.append(item)
                places.append(at)
        self.longest = WINDOW - 1
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, ...], tuple[list[int], list[int]]]] = {}
        for w, places in self.windows.items():
            for end in range(1, WINDOW):
                block = w[end - 1 : end + 1]
                self.shift[block] = min(self.shift.get(block, self.longest), WINDOW - 1 - end)
            self.bucket.setdefault(w[-2:], {})[w[:-2]] = places

    def found(self, w: list[str]) -> list[tuple[int, list[int], list[int]]]:
        """``(text position, items, item positions)`` of every window in the text."""
        out = []
        shift, longest, bucket, end, n = self.shift, self.longest, self.bucket, WINDOW - 1, len(w)
        while end < n:
            block = (w[end - 1], w[end])
            step = shift.get(block, longest)
            if step:
                end += step
                continue
            at = bucket[block].get(tuple(w[end - WINDOW + 1 : end - 1]))
            if at:
                out.append((end - WINDOW + 1, *at))
            end += 1
        return out

    def hits(self, w: list[str], least: int = 0) -> dict[int, set[int]]:
        """Item to the diagonals (text position less item position) on which it has a window.

        With ``least`` only the items that have a window in one place for each ``least`` of their words.
        """
        found = self.found(w)
        count: Counter[int] = Counter()
        for _, items, _ in found:
            count.update(items)
        out: dict[int, set[int]] = {item: set() for item, n in count.items() if n * least >= len(self.words[item]) or not least}
        for position, items, places in found if out else ():
            for item, at in zip(items, places, strict=True):
                if item in out:
                    out[item].add(position - at)
        return out


def pieces_on(w: list[str], item: list[str], diagonal: int, changed: int = 1) -> list[tuple[int, int, int]]:
    """``(item position, text position, words)`` of the pieces along a diagonal.

    Within a piece no two neighbouring words differ, none at all if ``changed`` is 0, and it begins and ends with equal words.
    """
    out, start, last = [], None, None
    for p in range(max(0, -diagonal), min(len(item), len(w) - diagonal) + 1):
        inside = p < len(item) and p + diagonal < len(w)
        if inside and item[p] == w[p + diagonal]:
            if start is None:
                start = p
            last = p
        elif start is not None and (not inside or p - last > changed):
            if last - start + 1 >= PIECE:
                out.append((start, start + diagonal, last - start + 1))
            start = None
    return out


def changed_too_much(w: list[str], item: list[str], piece: tuple[int, int, int]) -> bool:
    """Whether more than one word in five of a piece differs: then it is another text."""
    a, b, n = piece
    return 5 * sum(item[a + i] != w[b + i] for i in range(n)) > n


def is_stock(w: list[str], item: list[str], piece: tuple[int, int, int], own: Sequence[int]) -> bool:
    """Whether several texts have each passage that the piece holds word for word.

    ``own`` gives for each place of the item the words of the least passage there that is not stock, 0 for none.
    """
    a, b, n = piece
    end = 0  # of the equal words at hand
    for i in range(n):
        if item[a + i] != w[b + i]:
            continue
        if i >= end:
            end = next((j for j in range(i, n) if item[a + j] != w[b + j]), n)
        if own[a + i] and i + own[a + i] <= end:
            return False
    return True


def chained(w: list[str], item: list[str], diagonals: set[int], own: Sequence[int] | None = None, changed: int = 1) -> tuple[int, int]:
    """Most words of the item that pieces hold in the item's order, and most where one piece at least is not stock.

    Without ``own`` no piece is stock. Equal stretches of the item are taken in the order of the text, and only until one is chained as
    well as it could be anywhere: a later one serves no longer chain, nor does one that is chained no
    better than an earlier one. So a text that repeats a stretch many times costs no more than one
    that holds it once.
    """
    groups: dict[tuple[int, int, bool], list[int]] = {}
    for d in diagonals:
        for piece in pieces_on(w, item, d, changed):
            if not changed_too_much(w, item, piece):
                groups.setdefault((piece[0], piece[2], own is None or not is_stock(w, item, piece, own)), []).append(piece[1])
    chains: list[tuple[int, int, int, int, int]] = []  # item position, text position, words, most words up to here, most with a piece not stock or 0
    for (a, n, is_own), places in sorted(groups.items()):
        before = [(best - over, best_own and best_own - over) for c, _, m, best, best_own in chains if c < a for over in (max(0, c + m - a),)]
        most = _extended(n, is_own, before)
        last = (0, 0)
        for b in sorted(places):
            before = [(best - over, best_own and best_own - over) for c, d, m, best, best_own in chains if c < a and d < b for over in (max(0, c + m - a, d + m - b),)]
            got = _extended(n, is_own, before)
            if got != last:
                chains.append((a, b, n, *got))
                last = got
            if got == most:
                break
    return max((x[3] for x in chains), default=0), max((x[4] for x in chains), default=0)


def _extended(n: int, is_own: bool, before: list[tuple[int, int]]) -> tuple[int, int]:
    """Words of the best chains that end with a piece of ``n`` words, of all and of those with a piece not stock."""
    best = n + max((x for x, _ in before), default=0)
    return best, best if is_own else max((n + x for _, x in before if x), default=0)


def held(w: list[str], item: list[str], diagonals: set[int]) -> int:
    """Most words of the item that pieces hold in the item's order."""
    return chained(w, item, diagonals)[0]


def _texts(items: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """Distinct texts ``(text, w, own)`` and their items ``(item_id, text)``, a text being named by its least item.

    ``own`` maps a place to the words of the least passage there that fewer than ``SHARED_BY`` texts
    have. Passages are lengthened only where they are stock, until none is.
    """
    split = F.pandas_udf(lambda s: pd.Series([words_of(x) for x in s]), T.ArrayType(T.StringType()))
    ids = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("t")).filter("item_id is not null and t is not null").distinct()
    held = cut(ids.select("item_id", split("t").alias("w")).filter(F.size("w") >= PIECE))
    texts = cut(held.groupBy("w").agg(F.min("item_id").alias("text")))
    members = cut(held.join(texts, "w").select("item_id", "text"))
    places = texts.select("text", F.explode(F.sequence(F.lit(0), F.size("w") - PASSAGE)).alias("at"))
    out, size = None, PASSAGE
    while True:
        passages = places.join(texts, "text").filter(F.col("at") + size <= F.size("w")).select("text", "at", F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("passage"))
        stock = cut(passages.select("text", "passage").distinct().groupBy("passage").agg(F.count("*").alias("owners")).filter(F.col("owners") >= SHARED_BY).select("passage", F.lit(True).alias("stock")))
        judged = cut(meet(passages, stock, ["passage"], "left").select("text", "at", "stock"))
        own = judged.filter("stock is null").select("text", "at", F.lit(size).alias("size"))
        out = own if out is None else out.unionByName(own)
        if stock.isEmpty():
            break
        places, size = judged.filter("stock").select("text", "at"), 2 * size
    own = out.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("own"))  # places of one item
    return texts.join(own, "text", "left"), members


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, words_held, item_words)`` of every text that holds a third of an item.

    What lies in stock passages alone is no case, unless it is more than half of the item, word for word.

    Items are taken in passes of ``WORDS_PER_PASS`` words, so what a task holds does not grow with
    the item table, and the rows are the same for any size of a pass. Items of equal words are found
    together, each with its id. Null or short texts and items under eight words give no row; copies
    of a text each give theirs; other columns are ignored.
    """
    spark = docs.sparkSession
    texts, members = _texts(items, item_id, item_text)
    texts = cut(texts)
    corpus = spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("__text")).filter(F.length("__text") >= 2 * PIECE - 1), "doc_id")
    total = texts.agg(F.sum(F.size("w"))).first()[0] or 0
    if total <= WORDS_PER_PASS:
        blocks = texts.withColumn("pass", F.lit(0))
    else:
        sized = prefix_sums(texts.select("text", F.size("w").cast("bigint").alias("n"), F.lit(0).alias("all")), "all", ["text"], ["n"])
        blocks = cut(texts.join(sized.select("text", F.floor((F.col("pre_n") - F.col("n")) / WORDS_PER_PASS).alias("pass")), "text"))
    out = None
    for k in [r[0] for r in blocks.select("pass").distinct().orderBy("pass").toLocalIterator()] or [0]:
        shared = spark.sparkContext.broadcast([(r.text, list(r.w), [(r.own or {}).get(at, 0) for at in range(len(r.w))]) for r in blocks.filter(F.col("pass") == k).collect()])  # one bounded block

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton = BlockShifts(shared.value)
            for batch in batches:
                rows = []
                for d, t in zip(batch["doc_id"].tolist(), batch["__text"].tolist(), strict=True):
                    w = words_of(t)
                    for item, diagonals in automaton.hits(w, SHARE * HITS).items():
                        words = automaton.words[item]
                        n, with_own = chained(w, words, diagonals, automaton.own[item])
                        if with_own * SHARE >= len(words) or (n * MOSTLY > len(words) and chained(w, words, diagonals, changed=0)[0] * MOSTLY > len(words)):
                            rows.append((d, item, n, len(words)))
                yield pd.DataFrame(rows, columns=["doc_id", "text", "words_held", "item_words"])

        found = corpus.mapInPandas(search, "doc_id bigint, text bigint, words_held int, item_words int")
        out = found if out is None else out.unionByName(found)
    return meet(out, members, ["text"]).select("doc_id", "item_id", "words_held", "item_words")
