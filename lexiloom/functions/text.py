"""Scalar and array text functions as Column expressions; all stay on the JVM, array functions with lambdas outside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Signs that end a phrase.
DELIMITERS = r"[,;/:()\[\]{}\"]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
# Words that neither begin nor end a term.
STOP_WORDS = tuple(
    "a about after again all am an and any are as at be because been before but by can could did do does for from had has have he her him his how i if in into is it its "
    "just me more most my no not of off on one only or other our out over she should so some such than that the their them then there these they this those to too under until "
    "up very was we were what when where which while who why will with would you your".split()
)
# Affixes told apart in feature vectors.
PREFIXES = ("anti", "auto", "bi", "cardio", "co", "de", "dis", "endo", "gastro", "hyper", "hypo", "in", "inter", "neuro", "non", "over", "post", "pre", "re", "sub", "un")
SUFFIXES = ("able", "al", "ation", "ectomy", "emia", "ful", "gram", "ic", "ing", "ism", "itis", "ity", "less", "ly", "ment", "ness", "oma", "osis", "ous", "pathy", "tion")


def pad_punctuation(text: Column) -> Column:
    """Punctuation set off by spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(" + PUNCTUATION + ")", " $1 "), r"\s+", " "))


def printable(text: Column) -> Column:
    """Only printable ASCII, tabs and line ends; other characters are dropped, accented letters too."""
    return F.regexp_replace(text, r"[^\x20-\x7e\t\r\n]", "")


def ascii_runs(text: Column) -> Column:
    """Runs of other than ASCII replaced by a space."""
    return F.regexp_replace(text, r"[^\x00-\x7f]+", " ")


def normalize(text: Column) -> Column:
    """Lower case, delimiters and punctuation to spaces, collapsed and trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, " "), r"\s+", " "))


def word_array(text: Column) -> Column:
    """Non-empty words of a normalised text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def sort_words(text: Column) -> Column:
    return F.array_join(F.array_sort(word_array(text)), " ")


def lemma(word: Column) -> Column:
    """Rule lemma of an English word: plural, -ing and -ed endings taken off longer words."""
    return (
        F.when((F.length(word) > 4) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when((F.length(word) > 4) & word.rlike("(?:ss|sh|ch|x|z)es$"), F.substring(word, F.lit(1), F.length(word) - 2))
        .when((F.length(word) > 3) & word.endswith("s") & ~word.rlike("(?:ss|us|is)$"), F.substring(word, F.lit(1), F.length(word) - 1))
        .when((F.length(word) > 5) & word.endswith("ing"), F.substring(word, F.lit(1), F.length(word) - 3))
        .when((F.length(word) > 4) & word.endswith("ed"), F.substring(word, F.lit(1), F.length(word) - 2))
        .otherwise(word)
    )


def stem_words(text: Column) -> Column:
    """Lemmas of the words that are no stop words."""
    kept = F.filter(word_array(text), lambda w: ~w.isin(*STOP_WORDS))
    return F.array_join(F.transform(kept, lemma), " ")


def is_delimiter(token: Column) -> Column:
    """Nothing left without delimiters and punctuation."""
    return F.regexp_replace(token, PUNCTUATION, "") == ""


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[.?!]\s+|\n+"), lambda s: F.trim(s) != "")


def phrase_segments(text: Column) -> Column:
    """Stretches of a text that no sentence end and no delimiter interrupts."""
    return F.split(F.lower(text), r"[.?!]\s+|\n+|" + DELIMITERS)


def phrase_tokens(segment: Column) -> Column:
    return F.regexp_extract_all(segment, F.lit(r"([\p{L}\p{N}][\p{L}\p{N}'-]*)"), F.lit(1))


def edge_stop_word(tokens: Column) -> Column:
    """Whether the first or the last token is a stop word."""
    return F.get(tokens, F.lit(0)).isin(*STOP_WORDS) | F.element_at(tokens, -1).isin(*STOP_WORDS)


def pos_tag(word: Column) -> Column:
    """One-character tag by closed-class words and endings: a deterministic stand-in for a tagger.

    P preposition, T determiner, U pronoun, E conjunction, M modal, V verb form, R adverb, A adjective,
    D number, G gerund, N noun otherwise.
    """
    w = F.lower(word)
    return (
        F.when(w.isin("of", "in", "on", "at", "by", "for", "with", "from", "to", "into", "over", "under", "about"), "P")
        .when(w.isin("the", "a", "an", "this", "that", "these", "those"), "T")
        .when(w.isin("i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their"), "U")
        .when(w.isin("and", "or", "but", "nor", "yet"), "E")
        .when(w.isin("can", "could", "will", "would", "should", "may", "might", "must", "shall"), "M")
        .when(w.isin("is", "are", "was", "were", "be", "been", "am", "has", "have", "had", "do", "does", "did"), "V")
        .when(w.rlike("^[0-9]+$"), "D")
        .when(w.rlike("ly$"), "R")
        .when(w.rlike("ing$"), "G")
        .when(w.rlike("ed$"), "V")
        .when(w.rlike("(?:ous|ful|ive|able|ible|al|ic|ish|less)$"), "A")
        .otherwise("N")
    )


def collapse_pos(tag: Column) -> Column:
    """Penn tag to one character: punctuation is Z, what is not listed is O."""
    # The table of tags.
    table = {
        "N": ("NN", "NNS", "NNP", "NNPS"), "A": ("JJ", "JJR", "JJS"), "P": ("IN",), "R": ("RB", "RBR", "RBS", "WRB"), "V": ("VB", "VBD", "VBP", "VBZ"), "G": ("VBG",), "B": ("VBN",), "T": ("TO",),
        "D": ("DT", "PDT", "WDT"), "E": ("EX",), "F": ("FW",), "M": ("CD",), "U": ("RPR", "RPR$", "WP", "WP$"), "C": ("CC",), "W": ("UH",), "X": ("X",),
    }
    out = None
    for one, tags in table.items():
        out = F.when(tag.isin(*tags), one) if out is None else out.when(tag.isin(*tags), one)
    return out.when(tag.rlike("^" + PUNCTUATION + "+$"), "Z").otherwise("O")


def pos_signature(tags: Column) -> Column:
    return F.array_join(F.array_sort(tags), "+")


def similarity(a: Column, b: Column, fold: bool = True) -> Column:
    """1 less Levenshtein distance over the longer length; 0 where both are empty."""
    x, y = (F.lower(a), F.lower(b)) if fold else (a, b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(x, y) / longest)


def match_score(descr: Column, phrase: Column, norm: Column, stemmed: Column, ordered: Column, preferred: Column, same_pos: Column, case_factor: float = 0.9, prefer_factor: float = 0.1) -> Column:
    """Score 0 to 100 of a dictionary string against the four forms of a phrase.

    Levels 100, 90, 80, 80; distances mix case-sensitive and folded; unlike tags cost three tenths;
    a tenth comes from the likeness to the preferred name. Two empty strings score 0.
    """

    def level(form: Column, top: int) -> Column:
        longest = F.greatest(F.length(descr), F.length(form))
        dist = F.levenshtein(descr, form) * (1 - case_factor) + F.levenshtein(F.lower(descr), F.lower(form)) * case_factor
        return F.when(longest == 0, 0.0).otherwise((1 - dist / longest) * top)

    best = F.greatest(level(phrase, 100), level(norm, 90), level(stemmed, 80), level(ordered, 80))
    best = best * F.when(same_pos, 1.0).otherwise(0.7)
    return best * (1 - prefer_factor) + 100 * prefer_factor * similarity(phrase, preferred)


def string_to_int(text: Column, default: int = 0) -> Column:
    """Number read as float and cut to an integer, the default where it is none."""
    return F.coalesce(text.try_cast("float").cast("int"), F.lit(default))


def capital_class(term: Column) -> Column:
    """``all`` for upper case, ``term`` where every word begins so, ``first`` for the first, else ``none``."""
    return (
        F.when(term.rlike(r"^[A-Z0-9 -]*[A-Z][A-Z0-9 -]*$"), "all").when(term.rlike(r"^(?:[A-Z][^ ]*)(?: [A-Z][^ ]*)*$"), "term").when(term.rlike(r"^[A-Z]"), "first").otherwise("none")
    )


def period_seconds(text: Column) -> Column:
    """Seconds of an ISO period counted from 2000-01-01 (a year 366 days, a month 31); -1 where it is none."""
    part = lambda p: F.coalesce(F.regexp_extract(text, p, 1).try_cast("int"), F.lit(0))
    months = part(r"^P(?:(\d+)Y)") * 12 + part(r"^P(?:\d+Y)?(\d+)M")
    days = part(r"^P(?:\d+Y)?(?:\d+M)?(\d+)W") * 7 + part(r"^P(?:\d+Y)?(?:\d+M)?(?:\d+W)?(\d+)D")
    base = F.lit("2000-01-01").cast("date")
    span = F.datediff(F.date_add(F.add_months(base, months), days), base).cast("bigint") * 86400
    time = part(r"T(\d+)H") * 3600 + part(r"T(?:\d+H)?(\d+)M") * 60 + part(r"T(?:\d+H)?(?:\d+M)?(\d+)S")
    return F.when(text.rlike(r"^P(?=\d|T\d)(?:\d+Y)?(?:\d+M)?(?:\d+W)?(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+S)?)?$"), span + time).otherwise(F.lit(-1).cast("bigint"))


def to_months(seconds: Column) -> Column:
    """Whole months of 30.58333 days, halves up; -1 for negative spans."""
    return F.when(seconds < 0, -1).otherwise(F.floor(seconds / (30.58333 * 86400) + 0.5)).cast("bigint")


def affix(word: Column, affixes: tuple[str, ...], suffix: bool) -> Column:
    """The longest affix that the word has, else null."""
    ordered = sorted(affixes, key=lambda a: (-len(a), a))
    has = lambda a: word.endswith(a) if suffix else word.startswith(a)
    return F.coalesce(*[F.when(has(a), F.lit(a)) for a in ordered])


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.when(precision + recall == 0, 0.0).otherwise((1 + b) * precision * recall / (b * precision + recall))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def newlines(text: Column, policy: str) -> Column:
    """Line ends as ``space``, as ``period``, or as they are (``none``)."""
    return {"space": F.replace(text, F.lit("\n"), F.lit(" ")), "period": F.replace(text, F.lit("\n"), F.lit(". ")), "none": text}[policy]


def spans_overlap(b: str, e: str, other_b: str, other_e: str) -> Column:
    """Whether two spans, ends included, share a place."""
    return (F.col(b) <= F.col(other_e)) & (F.col(other_b) <= F.col(e))


def span_holds(b: str, e: str, other_b: str, other_e: str) -> Column:
    """Whether the first span holds the second."""
    return (F.col(b) <= F.col(other_b)) & (F.col(other_e) <= F.col(e))


def merge_spans(b: str, e: str, other_b: str, other_e: str) -> tuple[Column, Column]:
    """The least span that holds both."""
    return F.least(b, other_b), F.greatest(e, other_e)


def skip_count(b: Column, e: Column, words: Column) -> Column:
    """Places of a span beyond the words that it is made of."""
    return e - b + 1 - words
