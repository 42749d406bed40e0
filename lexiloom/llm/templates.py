"""Unfilled templates, filler, error pages and demands for scripts among documents.

One pass over the texts cuts each into segments and finds the places that may be slots: template
variables, default values, blanks. A second pass aligns the records: what all texts hold between
the same words as such a place are the values of one slot of one template, and a slot whose records
differ there is unfilled where it keeps its variable, default or blank. Whole pages are judged by
their segments: segments that repeat over pages with a message are the template around it, and
unknown segments that pages of any length hold with nothing but such a template are a message of
their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from operator import eq

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut, meet, small_enough, spread

MESSAGE_WORDS = 120  # a longer segment must hold a message for each so many words
COMPANION = 0.8  # share of a segment's pages that hold a message
PAGES = 3  # distinct pages from which a segment is part of a template
FILLER_SHARE = 0.7  # share of filler words that makes a text filler
VALUES = 2  # different values that induce a slot around a variable
VALUES_PLAIN = 3  # and around a default or blank, which plain texts hold too
FRAMES_PER_PASS = 500_000  # bound of what one pass of the alignment broadcasts
VALUES_HELD = 200_000  # slot values a task keeps before it hands them on

# Notations of template variables; these leave no doubt.
SURE_MARKS = (
    r"\{\{\s*[#/^>&]?\s*[\w.\-]+(?:\s+[\w.\-]+){0,3}\s*\}\}",
    r"\{%-?\s*\w[^{}%]*%\}",
    r"<%[=-]?\s*[\w.\[\]()]+\s*%>",
    r"[$#]\{\s*[\w.]+\s*\}",
    r"%\(\w+\)[sdif]",
    r"%%\w+%%",
    r"%[A-Z][A-Z_]{2,}%",
    r"@@\w+@@",
    r"\b__[A-Z][A-Z_]+__\b",
    r"\bXX_[A-Z_]+_XX\b",
    r"<<\s*\w+\s*>>",
    r"(?:<|&lt;)[A-Z][A-Z_]{2,}(?:>|&gt;)",
    r"\[(?:INSERT|ENTER|YOUR|ADD)\b[A-Z0-9 _]*\]",
    r"(?i)\[(?:insert|enter|your|add)\s[\w ]{1,40}\]",
    r"(?i)\[[\w ]{1,40} (?:goes )?here\]",
)
# Notations that are also used otherwise; the alignment must show a slot.
WEAK_MARKS = (r"\{[a-z]+(?:_[a-z]+)+\}", r"\{\d{1,2}\}", r"\[\[[a-z]+(?:_[a-z]+)+\]\]", r"\[[A-Z][A-Z_ ]{2,30}\]", r"\{[A-Za-z]{3,20}\}", r"(?<!\w)_{3,}(?!\w)")

# Words of the usual dummy text.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum sapien porta turpis vitae vestibulum "
    "pellentesque mauris cras nunc vivamus suspendisse praesent curabitur aenean maecenas etiam"
).split()
# Values that a slot keeps when nothing filled it in.
DEFAULTS = ("undefined", "NULL", "NaN", "N/A", "TBD", "TODO", "XXX", "XXXX")
# Phrases of dummy copy.
DUMMY = (
    r"\b(?:sample|dummy|placeholder|filler|example|body) (?:text|copy|content|paragraph)\b|\btext to follow\b|\bcontent (?:goes|to come|coming)\b|\blayout only\b|\bwill appear in this\b"
    r"|\b(?:asdf|qwer|qwerty|hjkl|zxcv)\w*|\breplace before (?:launch|publication)|\btext goes here\b|\b(\w+)(?:[ ,]+\1\b){2,}+|\b(\w+ \w+)(?: \2\b){2,}+"  # possessive, as long texts overflow the stack else
)
# What error pages say, in five languages.
ERRORS = (
    r"\b(?:error:? )?(?:400|401|403|404|405|408|410|429|500|501|502|503|504)\b.{0,40}\b(?:error|not found|forbidden|gateway|unavailable|unauthorized|timeout|denied|gone|requests?|page)\b"
    r"|\berror (?:code )?[345]\d\d\b|\b[345]\d\d (?:error|not found|forbidden|bad gateway|internal|gateway|service)\b|\bpage (?:not found|you asked for|you requested|does not exist|cannot be found|can't be found)"
    r"|\b(?:can't|cannot|could not|couldn't|unable to) (?:find|connect|load|display|open|reach|be found|process)\b|\baccess (?:is |was )?denied\b|\bno permission\b|\bnot authorized\b|\binternal server error\b|\bbad gateway\b"
    r"|\bgateway time-?out\b|\brequest timed out\b|\btoo many requests\b|\bservice (?:is )?(?:temporarily )?unavailable\b|\bsession has expired\b|\bsomething went wrong\b|\b(?:fatal|parse|syntax|uncaught|undefined|database|connection|server|proxy) error\b"
    r"|\bfatal:|\bwarning: |\bundefined (?:index|variable|offset)\b|\bon line \d+|\bhas been (?:moved|removed|deleted)\b|\bmoved or removed\b|\bnot writable\b|\bunder maintenance\b|\bdown for (?:upkeep|maintenance)\b"
    r"|\bseite (?:wurde )?nicht gefunden\b|\bpage introuvable\b|\bno se encuentra la página|\bpágina não encontrada|\bpágina no encontrada|\bacceso denegado\b|\bzugriff verweigert\b|\baccès refusé\b|\bacesso negado\b|\berreur\b|\bfehler \d|\boops\b"
)
# What demands for scripts say.
SCRIPTS = (
    r"\bjavascript\b|\b(?:turn|switch) (?:on )?script\w*|\bscript(?:s|ing)? (?:is|are|must be|support|allowed|blocked|disabled|off)\b|\b(?:run|allow|enable|activate|without|loaded by an?|requires?) scripts?\b|\bscripting on\b|\bscripts are\b|\bnoscript\b"
    r"|\bsupported browsers\b|\boutdated browser\b|\benable cookies\b"
)
_SHELL = r"(?i)^(?:\s|<[^<>]*>|#{1,6} )++"
# What stands around a message.
_NAV = (
    r"(?i)^(?:home|forum|search|help|sign in|log ?in|register|menu|contact|about|imprint|skip to content|back|top|login|faq|members|news|next|previous|logout|\s|[|·»>/-])++[.!]?$"
    r"|(?i)^(?:(?:please )?(?:go back|return) to\b.{0,40}|check the (?:address|url)\b.{0,40}|(?:please )?try again\b.{0,30}|(?:then |please )?(?:reload|refresh)\b.{0,30}|thank you|reference (?:id|number)? ?\d+"
    r"|(?:please )?contact the (?:site )?(?:owner|admin\w*)\b.{0,50}|learn how\b.{0,30})[.!]?$"
    r"|(?i)^(?:at [\w.$<>/]+\s?\(.*\)|file \"[^\"]*\", line \d+.*|traceback \(most recent call last\):|caused by: \w+(?:\.\w+)+.*|#\d+ .*\(\d+\).*|\.\.\. \d+ more)$"  # frames of a stack trace
)

# What the phrases above cannot do without; a text or segment that holds none of these is not searched for them.
TRIGGERS = (
    *"400 401 403 404 405 408 410 429 500 501 502 503 504 error forbidden denied erreur fehler oops asdf qwer hjkl zxcv javascript noscript scripts scripting gateway unavailable introuvable verweigert".split(),
    "not found", "page you", "page does not", "page cannot be", "page can't be", "no permission", "not authorized", "timed out", "too many request", "session has", "went wrong", "fatal:", "warning: ",
    "undefined ", "on line ", "has been moved", "has been removed", "has been deleted", "moved or removed", "not writable", "under maintenance", "down for ", "nicht gefunden", "no se encuentra", "não encontrada",
    "no encontrada", "acceso denegado", "accès refusé", "acesso negado", "script ", "supported browsers", "outdated browser", "enable cookies",
    "sample ", "dummy ", "placeholder ", "filler ", "example ", "body ", "text to follow", "content goes", "content to come", "content coming", "layout only", "will appear in this", "replace before", "text goes here",
    *(f"{digit} {word}" for digit in range(10) for word in ("internal", "service")),
    *(f"{word} script" for word in ("turn", "turn on", "switch", "switch on", "run", "allow", "enable", "activate", "without", "loaded by a", "loaded by an", "require", "requires")),
    *(f"{cannot} {do}" for cannot in ("can't", "cannot", "could not", "couldn't", "unable to") for do in ("find", "connect", "load", "display", "open", "reach", "be found", "process")),
)

_MARKS = re.compile("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in (*SURE_MARKS, *WEAK_MARKS)))
_SURE = re.compile("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in SURE_MARKS))
_MAY_MARK = re.compile(r"[{}%@\[<&]|__|XX_")
_PIECES = re.compile(r"(?<=[.!?])\s+|\n+|(?<= board) - |</?(?:html|body|h[1-6]|p|div|br|title|head)\b[^<>]*>", re.I)
_SHELL_OF = re.compile(_SHELL)
_NAV_OF = re.compile("(?i)" + _NAV.replace("(?i)", "") + r"|^[\w.-]+ board$")
_DIGITS, _OTHER = re.compile(r"\d+"), re.compile(r"[\W_]+")
_WORDS = re.compile(r"[^\W\d_]+")
_KINDS = (("script_notice", re.compile(SCRIPTS)), ("error_page", re.compile(ERRORS)), ("filler", re.compile(DUMMY)))
_LOREM = frozenset(LOREM)
_PLAIN_NAMES = {",": "(blank)", ".": "(blank)"} | {d + sign: d for d in DEFAULTS for sign in ("", ",", ".", ";", ":", "!", "?")}
_PLAIN = frozenset(_PLAIN_NAMES)
_FLAT = str.maketrans({chr(c): "0" if chr(c).isdigit() else chr(c) if chr(c).isalpha() else " " for c in range(128)})
_JOIN = "\u0002"  # stands for the spaces inside a mark


@cache
def _triggers():
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in TRIGGERS:
        a.add_word(t, 1)
    a.make_automaton()
    return a


def _triggered(low: str) -> bool:
    return next(_triggers().iter(low), None) is not None


def tokens_of(text: str) -> list[str]:
    """Words of a text, a template variable being one word."""
    if _MAY_MARK.search(text):
        text = _MARKS.sub(lambda m: re.sub(r"\s", _JOIN, m[0]), text)
    return text.split()


def slots_of(text: str, w: list[str]) -> Iterator[tuple[str, str, bool, str, bool]]:
    """``(mark, frame, sure, value, plain)`` of the places of ``w`` that may be unfilled slots.

    Around a variable the frame is the word on either side, around a default or blank two words, as
    plain texts hold these too. The edges of a text stand for words.
    """
    if _MAY_MARK.search(text):
        for i, x in enumerate(w):
            for m in _MARKS.finditer(x.replace(_JOIN, " ")):
                yield m[0], _frame(w, i, 1), bool(_SURE.fullmatch(m[0])), x, False
    if not _PLAIN.isdisjoint(w):
        for i in range(2, len(w) - 2):
            if w[i] in _PLAIN:
                yield _PLAIN_NAMES[w[i]], _frame(w, i, 2), False, w[i], True


def _frame(w: list[str], i: int, n: int) -> str:
    at = lambda j: "^" if j < 0 else "$" if j >= len(w) else w[j]
    return " ".join((*(at(i - k) for k in range(n, 0, -1)), "_", *(at(i + k) for k in range(1, n + 1))))


def skeleton(low: str) -> str:
    """Words of a segment in lower case, without punctuation, numbers being alike."""
    if low.isascii():
        flat = " ".join(low.translate(_FLAT).split())
        while "00" in flat:
            flat = flat.replace("00", "0")
        return flat
    return _OTHER.sub(" ", _DIGITS.sub("0", low)).strip()


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def hash_of(keys: list[int]) -> int:
    return _key(" ".join(map(str, keys)))


def _said(low: str) -> str | None:
    if not _triggered(low) and not _repeats(_WORDS.findall(low)):
        return None
    size = len(low.split())
    for kind, pattern in _KINDS:
        if pattern.search(low) and (size <= MESSAGE_WORDS or sum(1 for _ in pattern.finditer(low)) * MESSAGE_WORDS >= size):
            return kind
    return None


def _repeats(w: list[str]) -> bool:
    """Whether a word, or a pair of words, stands three times in a row."""
    for step in (1, 2):
        same = list(map(eq, w, w[step:]))  # each word with the one a step on
        need = 2 if step == 1 else 4  # neighbouring places that must agree
        if True in same and any(all(same[i : i + need]) for i in range(len(same) - need + 1) if same[i]):
            return True
    return False


_SCANNED = (
    "doc_id bigint, same bigint, latin boolean, message boolean, keys array<bigint>, said array<string>, plain array<boolean>, "
    "marks array<string>, frames array<string>, sures array<boolean>, weaks array<boolean>"
)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments and slots of each text. ``plain`` is set where a segment is neither navigation nor a
    title before the message."""
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"].tolist(), batch["t"].tolist(), strict=True):
            low = text.lower()
            words = _WORDS.findall(low)
            latin = len(words) >= 4 and sum(map(_LOREM.__contains__, words)) >= FILLER_SHARE * len(words)
            message = not latin and bool(words) and (_triggered(low) or _repeats(words))
            keys: list[int] = []
            said: list[str | None] = []
            plain: list[bool] = []
            if not latin and words:
                for piece in _PIECES.split(low):
                    s = _SHELL_OF.sub("", piece).strip() if piece else ""
                    if not s:
                        continue
                    k = skeleton(s)
                    says = _said(s) if message else None
                    # a title line before the message names the site
                    title = not keys and says is None and s[0].isalnum() and 2 <= k.count(" ") + 1 + (not s[-1].isalnum()) <= 6
                    keys.append(_key(k))
                    said.append(says)
                    plain.append(not title and not _NAV_OF.search(s) and any(map(str.isalpha, k)))
                message = any(said)
            w = tokens_of(text)
            slots = list(slots_of(text, w))
            rows.append((
                doc, hash_of(keys), latin, message, keys, said if message else [], plain,
                [x[0] for x in slots], [x[1] for x in slots], [x[2] for x in slots], [x[4] for x in slots],
            ))
        yield pd.DataFrame(rows, columns=["doc_id", "same", "latin", "message", "keys", "said", "plain", "marks", "frames", "sures", "weaks"])


def scan_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per text with its segments and slots, materialised: the texts are cut up once."""
    d = spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t")).filter("t is not null and doc_id is not null"), "doc_id")
    return cut(d.mapInPandas(_scan, _SCANNED))


def _align(frames: dict[str, int]):
    """Values that texts hold in the place of each frame, pre-aggregated in the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ones = {tuple(f.split(" _ ", 1)): k for f, k in frames.items() if f.count(" ") == 2}
        twos = {tuple(f.split(" ")[:2] + f.split(" ")[3:]): k for f, k in frames.items() if f.count(" ") == 4}
        inner = {(b, c) for _, b, c, _ in twos}
        held: set[tuple[int, str]] = set()
        for batch in batches:
            for text in batch["t"].tolist():
                w = tokens_of(text)
                for i, pair in enumerate(zip(["^", *w[:-1]], [*w[1:], "$"], strict=True) if w else ()):
                    if pair in ones:
                        held.add((ones[pair], w[i]))
                    if pair in inner:
                        four = (w[i - 2] if i > 1 else "^", *pair, w[i + 2] if i + 2 < len(w) else "$")
                        if four in twos:
                            held.add((twos[four], w[i]))
            if len(held) > VALUES_HELD:
                yield pd.DataFrame(list(held), columns=["frame_id", "value"])
                held.clear()
        yield pd.DataFrame(list(held), columns=["frame_id", "value"])

    return run


def slot_values(docs: DataFrame, text: str, frames: DataFrame) -> DataFrame:
    """``(frame, values)``: in how many different ways the records of a template fill the slot of each
    distinct ``frame``; frames are taken in blocks of bounded size against all texts."""
    spark = docs.sparkSession
    d = docs.select(F.col(text).cast("string").alias("t")).filter("t is not null and t <> ''")
    n = frames.count()
    passes = max(1, -(-n // FRAMES_PER_PASS))
    out = None
    for k in range(passes):
        part = frames if passes == 1 else frames.filter(F.pmod(F.xxhash64("frame"), F.lit(passes)) == k)
        ids = {r.frame: _key(r.frame) for r in part.collect()}  # one bounded block
        if not ids:
            continue
        found = d.mapInPandas(_align(ids), "frame_id bigint, value string")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return frames.select("frame", F.lit(0).cast("bigint").alias("values"))
    counted = out.distinct().groupBy("frame_id").agg(F.count("*").alias("values"))
    key = F.pandas_udf(lambda s: s.map(_key), "bigint")
    return frames.withColumn("frame_id", key("frame")).join(counted, "frame_id").select("frame", "values")


def template_slots(docs: DataFrame, doc_id: str, text: str, scanned: DataFrame | None = None) -> DataFrame:
    """``(doc_id, mark, sure, plain, fillers, unfilled)`` of each place that may be an unfilled slot.

    ``fillers`` counts the different values that all records hold in its place, its own included.
    ``unfilled`` is set where the records differ there, and where the notation leaves no doubt.
    """
    scanned = scan_texts(docs, doc_id, text) if scanned is None else scanned
    cols = [F.col("x")[c].alias(n) for c, n in (("marks", "mark"), ("frames", "frame"), ("sures", "sure"), ("weaks", "plain"))]
    held = scanned.filter(F.size("marks") > 0).select("doc_id", F.explode(F.arrays_zip("marks", "frames", "sures", "weaks")).alias("x")).select("doc_id", *cols)
    held = cut(held.distinct())
    values = cut(slot_values(spread(docs, doc_id), text, cut(held.select("frame").distinct())))
    least = F.when(F.col("plain"), VALUES_PLAIN).otherwise(VALUES)
    met = meet(held, values, ["frame"], "left").withColumn("fillers", F.coalesce("values", F.lit(0)))
    out = met.groupBy("doc_id", "mark", "sure", "plain").agg(F.max("fillers").alias("fillers"), F.max(F.col("fillers") >= least).alias("induced"))
    return out.select("doc_id", "mark", "sure", "plain", "fillers", "induced", (F.col("sure") | F.col("induced")).alias("unfilled"))


def whole_pages(scanned: DataFrame) -> DataFrame:
    """``(doc_id, kind, template)`` of texts that are nothing but filler, an error page or a script notice.

    ``template`` is set where the message or what stands around it repeats over ``PAGES`` distinct
    pages. Copies of a page count as one. A message that no phrase tells of is all the segments that
    a page holds beside the template; the same ones must stand so on ``PAGES`` pages, and each of
    them hardly elsewhere.
    """
    latin = scanned.filter("latin").select("doc_id", F.lit("filler").alias("kind"), F.lit(False).alias("template"))
    zipped = F.arrays_zip("keys", "said", "plain")
    said = scanned.filter("message").select("doc_id", "same", F.posexplode(zipped).alias("at", "x")).select("doc_id", "same", "at", F.col("x.keys").alias("k"), F.col("x.said").alias("said"), F.col("x.plain").alias("plain"))
    said = cut(said)
    asked = cut(said.select("k").distinct())
    # every page that holds such a segment, with or without a message
    pages = scanned.select("same", "message", F.explode(F.array_distinct("keys")).alias("k"))
    on = meet(pages, asked.withColumn("here", F.lit(True)), ["k"]).groupBy("k", "same").agg(F.max("message").alias("message"))
    learned = cut(on.groupBy("k").agg(F.avg(F.col("message").cast("int")).alias("with"), F.count("*").alias("pages")))
    judged = meet(said, learned, ["k"], "left")
    known = (F.col("with") >= COMPANION) & (F.col("pages") >= PAGES)
    content = F.col("said").isNull() & F.col("plain") & ~F.coalesce(known, F.lit(False))
    repeated = F.coalesce(F.col("pages") >= PAGES, F.lit(False)) & (F.col("plain") | F.col("said").isNotNull())
    page = judged.groupBy("doc_id").agg(
        F.max(content).alias("content"), F.min_by("said", F.when(F.col("said").isNotNull(), F.col("at"))).alias("first"),
        F.min(F.coalesce(F.col("said") == "filler", F.lit(False))).alias("all_filler"), F.max(repeated).alias("template"),
    )
    kind = F.when(F.col("all_filler"), "filler").otherwise(F.col("first"))
    seeded = page.filter(~F.col("content") & F.col("first").isNotNull()).select("doc_id", kind.alias("kind"), "template")
    # the template of the seeded pages around a message that no phrase tells of
    around = cut(judged.filter(known & F.col("said").isNull() & F.col("plain")).join(seeded.select("doc_id", "kind"), "doc_id").groupBy("k").agg(F.mode("kind", True).alias("kind")))
    others = scanned.filter("not message and not latin")
    beside = cut(meet(others.select("doc_id", "same", F.explode("keys").alias("k")), around, ["k"]).groupBy("doc_id", "same").agg(F.max("kind").alias("kind")))
    if beside.isEmpty():
        return latin.unionByName(seeded)
    seg = meet(others, beside, ["doc_id", "same"]).select("doc_id", "same", "kind", F.explode(F.arrays_zip("keys", "plain")).alias("x")).filter("x.plain").select("doc_id", "same", "kind", F.col("x.keys").alias("k"))
    unknown = meet(seg, around.select("k", F.lit(True).alias("known")), ["k"], "left").filter("known is null")
    bare = cut(unknown.groupBy("doc_id", "same", "kind").agg(F.sort_array(F.collect_set("k")).alias("unknown")))  # segments of one page
    only = cut(bare.groupBy("unknown").agg(F.count_distinct("same").alias("pages")).filter(F.col("pages") >= PAGES).select("unknown", F.lit(True).alias("here")))
    held = cut(meet(bare, only, ["unknown"]).select("same", F.explode("unknown").alias("k")).groupBy("k").agg(F.count_distinct("same").alias("bare")))
    total = meet(scanned.select("same", F.explode(F.array_distinct("keys")).alias("k")), held, ["k"]).groupBy("k").agg(F.count_distinct("same").alias("pages"), F.max("bare").alias("bare"))
    says = cut(total.select("k", (F.col("bare") >= COMPANION * F.col("pages")).alias("says")))
    learned_message = cut(meet(only.select("unknown", F.explode("unknown").alias("k")), says, ["k"]).groupBy("unknown").agg(F.min("says").alias("says")).filter("says"))
    return latin.unionByName(seeded).unionByName(meet(bare, learned_message, ["unknown"]).select("doc_id", "kind", F.lit(True).alias("template")))


def residue_evidence(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kind, evidence)`` of every text with template residue, one kind each.

    ``placeholder`` where an unfilled slot stands, else ``filler``, ``error_page`` or
    ``script_notice`` where the whole text is such. The evidence is ``slot`` where the records of a
    template differ in the place, ``notation`` where only the variable tells, ``page template`` where
    the page repeats over others, ``page`` where its message stands alone. Null and empty texts give
    no row, copies each give theirs; other columns are ignored.
    """
    docs = docs.select(doc_id, text)
    scanned = scan_texts(docs, doc_id, text)
    slots = template_slots(docs, doc_id, text, scanned).filter("unfilled").groupBy("doc_id").agg(F.max("induced").alias("induced"))
    unfilled = slots.select("doc_id", F.lit(0).alias("rank"), F.lit("placeholder").alias("kind"), F.when(F.col("induced"), "slot").otherwise("notation").alias("evidence"))
    pages = whole_pages(scanned).select("doc_id", F.lit(1).alias("rank"), "kind", F.when(F.col("template"), "page template").otherwise("page").alias("evidence"))
    best = unfilled.unionByName(pages).groupBy("doc_id").agg(F.min(F.struct("rank", "kind", "evidence")).alias("b"))
    return best.select("doc_id", "b.kind", "b.evidence")


def find_residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kind)`` of ``residue_evidence``."""
    return residue_evidence(docs, doc_id, text).select("doc_id", "kind")
