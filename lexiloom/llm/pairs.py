"""Prompt and response pairs with a defective response, by kind of defect.

A suffix automaton of the prompt's words is traversed with the response to measure what share of
it is copied; an Aho-Corasick automaton of refusal phrases, a stack of delimiters with the corpus'
own sentence endings, and votes of stopwords find the other kinds.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..runtime import cut, meet, spread
from .endings import ending_counts, has_end, judge_open_ends

# What stands for no answer.
NO_ANSWER = ("null", "none", "nan", "n/a", "na", "no answer", "deleted", "removed", "nil", "empty", "blank")

# Phrases that decline.
REFUSALS = (
    "able to answer", "unable to answer", "cannot answer", "can't answer", "can not answer", "won't answer", "decline to", "must decline",
    "unable to give advice", "cannot give advice", "can't give advice", "not give medical advice", "cannot provide", "can't provide", "unable to provide",
    "can't help with", "cannot help with", "can't assist", "cannot assist", "unable to help", "unable to assist", "not able to help",
    "comfortable answering", "won't comment", "cannot comment", "can't comment", "no comment", "pass on this", "something i can discuss", "can't discuss", "cannot discuss",
    "right for me to", "not allowed to", "against our policy", "against my policy", "rather not", "does not permit", "not permitted to", "refuse to",
    "no puedo responder", "no puedo contestar", "no puedo ayudarte", "no puedo ayudarle", "prefiero no responder", "je ne peux pas répondre", "je ne peux pas vous aider", "je préfère ne pas répondre",
    "kann ich nicht beantworten", "kann ich leider nicht beantworten", "ich kann ihnen nicht helfen", "ich kann dir nicht helfen", "não posso responder", "não posso ajudar", "prefiro não responder",
)

# Phrases that come along with declining.
COURTESIES = (
    "ask a professional", "consult", "your own doctor", "anything else", "asking someone else", "ask someone else", "hope you understand", "lack the training",
    "see a doctor", "good luck", "take care", "thank you", "thanks", "consulte", "consultez", "wenden sie sich", "lo siento", "je suis désolé", "tut mir leid", "sinto muito",
)

# Words that open a refusal and say nothing.
OPENERS = frozenset("hi hello hey hmm sorry apologies unfortunately i'm i am but with respect well um dear please so".split())

# Frequent words of each language that the others lack or use less.
STOPWORDS = {
    "en": "no yes the and is are was were of to in it that this with for you your my i have has had do does not be been can could will would should but from by at an what when how why which after before there they he she his her we our their more than then if or as so on a me about will go see take",
    "es": "el la los las y es son que de en un una por para con no se su sus lo al del como más pero este esta esto tengo tiene mi me si yo le hace muy ya qué también cuando desde durante sin hay tomó años noche",
    "fr": "le la les et est sont que de en un une des du pour avec ne pas se sa son ses au aux ce cette mais plus je vous il elle mon ma mes qui dans sur si ai avez pendant depuis sans être parfois faut ou y d'un j'ai c'est n'est l'eau",
    "de": "der die das und ist sind nicht ein eine einen mit für von zu im in den dem des auf ich mir mich sie er es wir aber wenn auch als bei nach seit aus wie hat habe wird würde kann ohne mein meine meine schon noch dazu war",
    "pt": "o a os as e é são que de em um uma por para com não se seu sua ao do da dos das no na como mais mas este esta isso tenho tem minha meu você eu me já também quando desde há sem foi tomou deu às noite",
}

COPIED = 0.8  # share of the response's words that come from the prompt, beyond which it only repeats
RUN = 4  # shorter runs of words count as chance
ADDED = 4  # so many own words a copy may add
DECLINES = 25  # words for each of which a sentence that declines must hold one declining phrase

_MARKUP = re.compile(r"<[^<>]*>|&[a-z]+;|&#\d+;")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def tokens(text: str | None) -> list[str]:
    text = text or ""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.lower().replace("’", "'"))


_NO_ANSWER = frozenset(re.sub(r"\W", "", x) for x in NO_ANSWER)
_LONGEST = max(map(len, _NO_ANSWER))


def is_empty(text: str | None, words: list[str] | None = None) -> bool:
    """Null, blank, or nothing but punctuation, markup or a mark that stands for no answer."""
    words = tokens(text) if words is None else words
    return not words or (len(words) <= _LONGEST and re.sub(r"\W", "", "".join(words)) in _NO_ANSWER)


class SuffixAutomaton:
    """Suffix automaton over the words of a prompt; as many states as twice the words at most."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            cur = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    while p != -1 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, words: list[str], run: int) -> int:
        """Words of ``words`` that lie in runs of at least ``run`` words of the prompt."""
        state = n = count = until = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                n = 0
            if n >= run:
                count += i + 1 - max(until, i + 1 - n)
                until = i + 1
        return count


def is_copy(prompt: list[str], response: list[str]) -> bool:
    """Whether the response only repeats the prompt, but for few words."""
    if not prompt or len(response) < 2:
        return False
    # what is copied consists of words of the prompt; with too few of these the automaton is not built
    if sum(map(set(prompt).__contains__, response)) < COPIED * len(response):
        return False
    got = SuffixAutomaton(prompt).covered(response, min(RUN, len(prompt), len(response)))
    extra = len(response) - got
    return got >= COPIED * len(response) and extra <= max(ADDED, len(response) // 10) and got * 2 >= len(prompt)


@cache
def _refusal_automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, phrases in (("no", REFUSALS), ("by", COURTESIES)):
        for p in phrases:
            a.add_word(f" {p} ", (kind, len(p)))
            a.add_word(f" {p}s ", (kind, len(p)))
    a.make_automaton()
    return a


def _phrases(words: list[str]) -> list[str]:
    return [kind for _, (kind, _) in _refusal_automaton().iter(" " + " ".join(words) + " ")]


def is_refusal(text: str, words: list[str] | None = None) -> bool:
    """Whether every sentence of the text declines or goes along with declining, and one declines."""
    if "no" not in _phrases(tokens(text) if words is None else words):
        return False
    declined = False
    for sentence in re.split(r"(?<=[.?!])\s+|\n+", text.strip()):
        w = tokens(sentence)
        if not w:
            continue
        kinds = _phrases(w)
        if kinds.count("no") * DECLINES >= len(w):
            declined = True
        elif "by" not in kinds and not all(x in OPENERS for x in w):
            return False
    return declined


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


@cache
def _votes() -> dict[str, dict[str, float]]:
    owners: dict[str, list[str]] = {}
    for lang, ws in STOPWORDS.items():
        for w in set(ws.split()):
            for form in {w, _bare(w)}:  # accents are often left out
                if lang not in owners.setdefault(form, []):
                    owners[form].append(lang)
    return {w: {lang: 1 / len(langs) for lang in langs} for w, langs in owners.items()}


def votes(words: list[str]) -> dict[str, float]:
    """Stopword votes per language; a word that languages share is parted among them."""
    score: dict[str, float] = {}
    known = _votes()
    for w in words:
        if w in known:
            for lang, v in known[w].items():
                score[lang] = score.get(lang, 0) + v
    return score


def _other_language(prompt: list[str], response: list[str]) -> bool:
    """Whether the votes for the response's language clearly pass those for the prompt's, on both sides."""
    p, r = votes(prompt), votes(response)
    if not p or not r:
        return False
    mine, its = max(p, key=lambda k: (p[k], k)), max(r, key=lambda k: (r[k], k))
    return mine != its and p[mine] >= 1 and p[mine] > 2 * p.get(its, 0) and r[its] >= 1.2 and r[its] > 2.4 * r.get(mine, 0) and r[its] >= 0.1 * len(response)


def _plain_defect(prompt: pd.Series, response: pd.Series) -> pd.Series:
    out: list[str | None] = []
    for q, a in zip(prompt.tolist(), response.tolist(), strict=True):
        aw = tokens(a)
        if is_empty(a, aw):
            out.append("empty")
            continue
        qw = tokens(q)
        if qw and is_copy(qw, aw):
            out.append("copy")
        elif is_refusal(a, aw):
            out.append("refusal")
        elif qw and _other_language(qw, aw):
            out.append("other_language")
        else:
            out.append(None)
    return pd.Series(out, dtype="object")


def find_defects(pairs: DataFrame, key: str, prompt: str, response: str) -> DataFrame:
    """``(key, defect)`` of each pair with a defective response, one defect at most.

    In order: empty, copy, refusal, other_language, truncated. A null response is empty; a blank
    prompt is no defect and neither copied nor of a language; repeated rows give their defect each;
    other columns are ignored.
    """
    raw = spread(pairs.select(F.col(key).alias("key"), F.col(prompt).cast("string").alias("q"), F.col(response).cast("string").alias("a")), "key")
    plain = raw.select("key", "a", F.pandas_udf(_plain_defect, T.StringType())("q", "a").alias("defect"))
    # both branches below read this; a text that has its defect is not needed any more
    marked = cut(plain.select("key", F.when(F.col("defect").isNull() & ~has_end(F.col("a")), F.col("a")).alias("a"), "defect"))
    # copies of a pair are no further evidence, whereas an answer that different prompts get is a stock one
    counts = ending_counts(spread(cut(raw.filter(F.length("a") > 0).select("q", "a").distinct().select("a")), "a"), "a")
    open_ = marked.filter(F.col("a").isNotNull())
    judged = judge_open_ends(open_.select("a", F.col("a").alias("t")).distinct(), "a", "t", counts).filter("broken").select(F.col("key").alias("a"))
    broken = meet(open_, cut(judged), ["a"]).select("key", F.lit("truncated").alias("defect"))
    return marked.filter(F.col("defect").isNotNull()).select("key", "defect").unionByName(broken)
