"""Fields that hold several values: one row per value, with its position.

The field is split on quote characters; pieces between quotes are literals, the pieces outside
are split on delimiters, and one fold over the array puts the values together again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The signs that part values; a slash only with space on both sides.
DELIMITERS = r"[,;|\t\r\n·•，、；]|\s/\s"
_HELD = "\ue000"  # stands for an escaped double quote while the field is split
_HELD_ONE = "\ue001"  # and for an escaped single quote


def _fold(pieces: Column, delimiters: Column) -> Column:
    """Values of one field from its pieces, quote characters being pieces of their own.

    State: the finished values, the value being read, the quote that is open, and whether a quote
    was just closed. A quote opens only where a value begins; the same quote again right after
    closing stands for itself.
    """
    zero = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit("").alias("open"), F.lit(False).alias("closed")
    )

    def state(done: Column, cur: Column, open_: Column, closed: Column) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"), open_.alias("open"), closed.alias("closed"))

    def step(acc: Column, piece: Column) -> Column:
        is_quote = piece.isin('"', "'")
        inside = acc["open"] != ""
        opens = is_quote & ~inside & (F.trim(acc["cur"]) == "") & ~acc["closed"]
        again = is_quote & ~inside & acc["closed"] & (piece == '"')
        parts = F.split(piece, delimiters)
        n = F.size(parts)
        more = F.concat(acc["done"], F.array(F.concat(acc["cur"], parts[0])), F.slice(parts, 2, F.greatest(n - 2, F.lit(0))))
        return (
            F.when(piece == "", acc)
            .when(is_quote & inside & (piece == acc["open"]), state(acc["done"], acc["cur"], F.lit(""), F.lit(True)))
            .when(inside, state(acc["done"], F.concat(acc["cur"], piece), acc["open"], F.lit(False)))
            .when(again, state(acc["done"], F.concat(acc["cur"], F.lit(_HELD)), piece, F.lit(False)))
            .when(opens, state(acc["done"], F.lit(""), piece, F.lit(False)))
            .when(n == 1, state(acc["done"], F.concat(acc["cur"], piece), F.lit(""), F.lit(False)))
            .otherwise(state(more, F.element_at(parts, -1), F.lit(""), F.lit(False)))
        )

    return F.aggregate(pieces, zero, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))


def unpack_values(field: Column, delimiters: str = DELIMITERS) -> Column:
    """``ARRAY<STRING>`` of the values packed in ``field``; empty where it holds none.

    Read are plain lists by any delimiter, quoted lists with doubled or escaped quotes, bracketed
    JSON or Python lists, and hashtags (a field that begins with ``#`` is also split before each
    ``#``). Outer space, quotes and a leading ``#`` are taken off, quotes inside a value stay.
    Null, blank and all-delimiter fields give an empty array.
    """
    s = F.regexp_replace(F.regexp_replace(F.coalesce(field, F.lit("")), r'\\"', _HELD), r"\\'", _HELD_ONE)
    s = F.regexp_replace(s, r"^[\s ]+|[\s ]+$", "")
    listed = s.rlike(r"(?s)^\[.*\]$")
    s = F.when(listed, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    # a single quote is one only in a bracketed list; elsewhere it is an apostrophe
    s = F.when(listed, s).otherwise(F.replace(s, F.lit("'"), F.lit(_HELD_ONE)))
    tagged = s.startswith("#")
    marks = F.when(tagged, F.lit(delimiters + "|\\s*#")).otherwise(F.lit(delimiters))
    values = _fold(F.split(s, "(?=[\"'])|(?<=[\"'])"), marks)
    clean = F.transform(
        values,
        lambda v: F.regexp_replace(F.regexp_replace(F.translate(v, _HELD + _HELD_ONE, "\"'"), r"^[\s ]+|[\s ]+$", ""), r"^#+\s*", ""),
    )
    return F.filter(clean, lambda v: v != "")


def explode_packed(rows: DataFrame, keys: Sequence[str], field: str, delimiters: str = DELIMITERS) -> DataFrame:
    """``keys`` with ``pos`` (BIGINT from 1) and ``val``, one row per packed value of ``field``.

    Each distinct field text of a key is unpacked once, so repeated rows give their values once.
    Rows without any value give none; a null key is kept as null; other columns are ignored.
    """
    once = rows.select(*[F.col(k).alias(k) for k in keys], F.col(field).cast("string").alias("__field")).filter(F.col("__field").isNotNull()).distinct()
    out = once.select(*keys, F.posexplode(unpack_values(F.col("__field"), delimiters)).alias("__p", "val"))
    return out.select(*keys, (F.col("__p") + 1).cast("bigint").alias("pos"), "val")
