"""Text operators on small fixtures with known answers, and brute force where there is one."""

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import leaks, queries, templates
from lexiloom.llm.endings import ending_counts, judge_open_ends
from lexiloom.llm.leaks import BlockShifts, WINDOW, find_leaks, held, words_of
from lexiloom.llm.markup import boilerplate_spans, markup_kinds, strip_markup, suffix_runs
from lexiloom.llm.pairs import SuffixAutomaton, find_defects, is_copy, is_empty, is_refusal
from lexiloom.llm.templates import find_residue, residue_evidence, template_slots
from lexiloom.llm.truncation import cut_sentences, cut_terms, length_limits

from ..conftest import DATA, same


def test_queries_like_sql(spark, duck):
    q, sql = queries.queries(), queries.oracle_sql()
    for name in sql:
        same(spark, duck, q[name], sql[name])


def test_found_columns(spark):
    q = queries.queries()
    want = {"p2_found": ["id", "defect"], "p3_found": ["tbl", "row_id", "field", "kind"], "p5_found": ["tbl", "id"], "p6_found": ["code_a", "code_b"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "kind"]}
    for name, cols in want.items():
        df = q[name](spark, DATA)
        assert df.columns == cols and (df.count() > 0 or name == "p8_found")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14), st.integers(1, 4))
def test_copied_words_like_brute_force(prompt, response, run):
    inside = set()
    for i in range(len(response)):
        for j in range(i + run, len(response) + 1):
            if any(prompt[k : k + j - i] == response[i:j] for k in range(len(prompt))):
                inside.update(range(i, j))
    assert SuffixAutomaton(prompt).covered(response, run) == len(inside)


def test_defect_rules():
    assert all(map(is_empty, [None, "", " \n", "?", "--", "<p></p>", "N/A", "[deleted]", "(no answer)", "\u200b", "\xa0"])) and not is_empty("No.")
    q = "can i eat cheese with a bad knee".split()
    assert is_copy(q, "re can i eat cheese with a bad knee".split()) and is_copy(q, q + q)
    assert not is_copy(q, ("you asked can i eat cheese with a bad knee well i would not do so without asking").split()) and not is_copy([], ["a", "b"])
    assert is_refusal("Sorry, I am not able to answer this. Please ask a professional.") and is_refusal("I can't help with that")
    assert not is_refusal("I cannot say for sure, yet the signs are clear. Rest and drink.") and not is_refusal("Sorry to hear that. Try tea.")


def test_defects(spark):
    rng = random.Random(1)
    things = ["tea", "milk", "bread", "rice", "soup", "fish"]
    whole = [f"Drink {rng.choice(things)} with {rng.choice(things)} and see whether your knee calms down." for _ in range(60)]
    rows = [(i, "Why does my knee hurt after a long walk?", a, "x") for i, a in enumerate(whole)]
    rows += [(100, "Why does my knee hurt?", "Drink tea with milk and see whether", "x"), (101, "Why does my knee hurt?", "Drink tea with milk and see whether your knee calms down", "x"), (102, "Why?", None, "x")]
    rows += [(103, "Why does my knee hurt after a long walk?", "Le médecin a dit que ce n'est pas la goutte et que je dois boire de l'eau.", "x"), (104, None, "Drink tea with " + "rice " * 20_000, "x")]
    got = {r.key: r.defect for r in find_defects(spark.createDataFrame(rows, "id int, q string, a string, defect string"), "id", "q", "a").collect()}
    assert got[100] == "truncated" and got[102] == "empty" and got[103] == "other_language"
    assert not set(got) & {*range(60), 101}
    assert find_defects(spark.createDataFrame([], "id int, q string, a string"), "id", "q", "a").count() == 0


def test_endings_of_one_corpus(spark):
    texts = [f"We saw the {a} cat near the {b} door." for a in ("old", "red", "big") for b in ("blue", "green", "white", "black")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + ["We saw the old cat near the", "We saw the red cat near the blue door", "We saw the big cat ne"])], "i int, t string")
    got = {r.key: r.broken for r in judge_open_ends(df, "i", "t", ending_counts(df, "t")).collect()}
    assert got == {12: True, 13: False, 14: True}


def test_length_limit(spark):
    rng = random.Random(2)
    rows = [("s", int(rng.gauss(65, 12))) for _ in range(3000)] + [("s", 64)] * 200 + [("u", int(rng.gauss(65, 12))) for _ in range(500)]
    got = length_limits(spark.createDataFrame(rows, "src string, len int"), ["src"], "len").filter("limit").collect()
    assert [(r.src, r.len) for r in got] == [("s", 64)]


def test_cut_rows(spark):
    rows = [("t", i, f"The {a} dog sleeps in the {b} house.", 1) for i, (a, b) in enumerate((a, b) for a in ("old", "red", "big") for b in ("blue", "green", "white"))]
    rows += [("t", 50, "The old dog sleeps in", 1), ("t", 51, None, 1), ("t", 52, "", 1), (None, 53, "The big dog sleeps in the blue house", 1)]
    got = {r.key for r in cut_sentences(spark.createDataFrame(rows, "src string, id int, s string, g int"), ["src"], "id", "s", ["g"]).collect()}
    assert 50 in got and not got & {51, 52, *range(9)}
    names = [f"bad {'very ' * (i % 9)}knee {i * i}" for i in range(200)]
    terms = [(i, t, f"Known {t} or use of tea.") for i, t in enumerate(names)]
    terms += [(900, "sharp heart fai", "Known sharp heart failure or use of tea."), (901, "bad knee", "Known bad knees or use of tea."), (902, "Bad knee", "Known bad knee or use of tea."), (903, None, "x"), (904, "x", None), (905, "history of bad", "Known history of bad knee or use of tea.")]
    got = {r.key for r in cut_terms(spark.createDataFrame(terms, "id int, t string, s string").withColumn("src", F.lit("b")), ["src"], "id", "t", "s").collect()}
    assert got == {900, 905}


MARKUP = {
    "plain text, 4 * 5 * 6 and X_1, my_food_diary_2 <3 #1 R&D ^_^ [sic] > 5": [], "a <b>bold</b> word": ["html"], "salt &amp; more": ["html"], "<!-- ad --> x": ["html"],
    "some **bold** word": ["markdown"], "# Head\n\nx": ["markdown"], "see [this](http://a.b)": ["markdown"], "1. a\n2. b": ["markdown"], "`code`": ["markdown"], "Head\n======\nx": ["markdown"],
    "[[link|x]] y": ["wiki"], "== Head ==\n* a\n* b": ["wiki"], "# one\n# two": ["wiki"], "{{citation needed}}": ["wiki"], "'''bold'''": ["wiki"], "[http://a.b c] d": ["wiki"],
    "\\textbf{x} y": ["latex"], "so $x^2$ is": ["latex"], "\\begin{itemize}\n\\item a\n\\end{itemize}": ["latex"], "It cost $5 or $6.": [], "<p>a **b**</p>": ["html", "markdown"], "": [],
}


def test_markup_kinds(spark):
    texts = list(MARKUP)
    got = {r.i: r.k for r in markup_kinds(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "k").collect()}
    for i, t in enumerate(texts):
        assert got[i] == MARKUP[t], t


def test_clean_text_and_boilerplate(spark):
    menu = " ".join(f"menu{i}" for i in range(30))
    rows = [(i, "h", f"<h2>Head</h2><p>own words of page {i}</p><p>{menu}</p>") for i in range(4)] + [(9, "h", None), (10, None, "\\section{A} \\(x^2\\)"), (11, "h", "")]
    df = spark.createDataFrame(rows, "id int, host string, t string").withColumn("clean", F.lit("clash"))
    got = {r.id: r for r in strip_markup(df, "host", ["id"], "t").collect()}
    assert got[0].clean == "# Head\n\nown words of page 0" and got[0].boilerplate == 30
    assert got[10].clean == "# A\n$x^2$" and got[9].clean is None and got[11].kinds == []


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), min_size=1, max_size=8))
def test_runs_like_brute_force(spark, pages):
    pages = sorted({" ".join(p) for p in pages})
    k, least = 3, 2
    want = set()
    cut = lambda p, i: tuple(p.split()[i : i + k])
    for a, p in enumerate(pages):
        for i in range(len(p.split()) - k + 1):
            if sum(any(cut(q, j) == cut(p, i) for j in range(len(q.split()) - k + 1)) for q in pages) >= least:
                want.add((a, i))
    df = spark.createDataFrame([(i, "h", p) for i, p in enumerate(pages)], "page int, host string, t string")
    assert {(r.page, r["at"]) for r in suffix_runs(df, "host", "page", "t", k, least).collect()} == want
    covered = {(r.page, i) for r in boilerplate_spans(df, "host", "page", "t", k, least).collect() for i in range(r.start, r.start + r.tokens)}
    assert covered == {(p, i + j) for p, i in want for j in range(k)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), min_size=WINDOW, max_size=9), min_size=1, max_size=4), st.lists(st.sampled_from("abcdef"), max_size=25))
def test_block_shifts_like_brute_force(items, text):
    automaton = BlockShifts([(i, w, None) for i, w in enumerate(items)])
    want = {}
    for i, w in enumerate(items):
        for at in range(len(w) - WINDOW + 1):
            window = w[at : at + WINDOW]
            if tuple(window) in automaton.windows:
                for p in range(len(text) - WINDOW + 1):
                    if text[p : p + WINDOW] == window:
                        want.setdefault(i, set()).add(p - at)
    assert automaton.hits(text) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), min_size=10, max_size=24), st.lists(st.sampled_from("abc"), max_size=60))
def test_chains_like_all_pieces(item, text):
    diagonals = set(range(-len(item), len(text)))
    pieces = sorted(p for d in diagonals for p in leaks.pieces_on(text, item, d) if not leaks.changed_too_much(text, item, p))
    best = []
    for i, (a, b, n) in enumerate(pieces):
        before = max([best[j] - max(0, c + m - a, d + m - b) for j, (c, d, m) in enumerate(pieces[:i]) if c < a and d < b], default=0)
        best.append(n + max(before, 0))
    assert held(text, item, diagonals) == max(best, default=0)


def test_leaks(spark):
    item = "a tall man of forty walks into the ward with a red ear and two cold hands after eating much old cheese at home last night"
    other = "one short girl runs out of a green house because her small dog barks at every white car that drives by in the rain"
    w = item.split()
    changed = " ".join("XX" if i == 12 else x for i, x in enumerate(w))
    docs = [
        (1, f"Hello. {item.upper()}! Bye."), (2, "so: " + " ".join(w[:10])), (3, "see " + " ".join(w[:6]) + " only"), (4, f"<b>{changed}</b>"), (5, None), (6, ""), (7, "x " * 50_000 + other),
        (8, " ".join(w[14:22]) + " nothing here " + " ".join(w[:8])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    i = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(d, i).collect()}
    assert got == {(1, 1), (2, 1), (4, 1), (7, 2), (8, 1)} - ({(8, 1)} if held(words_of(docs[7][1]), w, {14 * -1, 10}) * 3 < len(w) else set())
    assert find_leaks(d, i.limit(0)).count() == 0 and find_leaks(d.limit(0), i).count() == 0


def test_leaks_in_passes_of_any_size(spark, monkeypatch):
    stock = "which of these findings should a doctor look for first of all"
    items = [(k, f"the patient number w{k}a lives in w{k}b near w{k}c with w{k}d and eats w{k}e every day {stock}") for k in range(6)] + [(20, "one text that three suites took up word for word and letter by letter")] * 2
    items += [(21, items[-1][1]), (22, items[-1][1].upper())]
    docs = [(k, f"Intro. {items[k][1]} End.") for k in range(6)] + [(50, stock), (51, "Look: " + items[-1][1])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(k, k) for k in range(6)} | {(51, 20), (51, 21), (51, 22)}
    for size in (1, 40, 500_000):
        monkeypatch.setattr(leaks, "WORDS_PER_PASS", size)
        got = [(r.doc_id, r.item_id) for r in find_leaks(d, i).collect()]
        assert set(got) == want and len(got) == len(want), size


def test_leaks_of_shared_windows(spark):
    case = "a tall man of forty walks into the ward with a red ear and two cold hands after much old cheese"
    ask = "which of these findings should a doctor look for first of all"
    items = [(1, case), *((k, f"{case} in town w{k} by road w{k}a") for k in (2, 3, 4)), *((10 + k, f"girl g{k} runs out of house h{k} with dog d{k} at noon n{k} {ask}") for k in range(3))]
    girl = items[4][1].split()
    # the whole of a text whose every window others have; a stock question moved off its own words, and alone
    docs = [(1, f"Look: {case}."), (2, " ".join([*girl[:8], "and", "so", ask])), (3, f"Look: {ask}?")]
    got = {(r.doc_id, r.item_id): r.words_held for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {**{(1, k): 21 for k in (1, 2, 3, 4)}, (2, 10): 20}


def test_leaks_like_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    stock = [[rng.choice("abcdefgh") for _ in range(n)] for n in (9, 12, 15)]
    some = lambda n: [rng.choice("abcdefghijkl") for _ in range(n)]
    items = [(k, [*some(rng.randint(4, 20)), *rng.choice(stock), *some(rng.randint(0, 9))]) for k in range(30)]
    docs = []
    for d in range(150):
        w = list(rng.choice(items)[1])
        a = rng.randrange(len(w))
        w = [*w[a:], *some(rng.randint(0, 3)), *w[:a]] if rng.random() < 0.5 else [*w[:a], *some(rng.randint(0, 3)), *w[a:]]
        docs.append((d, [*some(5), *(x if rng.random() < 0.9 else "z" for x in w), *some(5)]))
    shared = lambda run: len({tuple(w) for _, w in items if any(w[p : p + len(run)] == run for p in range(len(w)))}) >= 3
    want = set()
    for d, w in docs:
        for k, item in items:
            best, best_own, chains = 0, 0, []
            for a, b, n in sorted({p for x in range(-len(item), len(w)) for p in leaks.pieces_on(w, item, x) if not leaks.changed_too_much(w, item, p)}):
                is_own = any(item[p : p + q] == w[p + b - a : p + b - a + q] and not shared(item[p : p + q]) for q in (4, 8, 16, 32) for p in range(a, a + n - q + 1))
                before = [(g - max(0, c + m - a, e + m - b), o and o - max(0, c + m - a, e + m - b)) for c, e, m, g, o in chains if c < a and e < b]
                got = n + max([g for g, _ in before], default=0)
                own = got if is_own else max([n + o for _, o in before if o], default=0)
                chains.append((a, b, n, got, own))
                best, best_own = max(best, got), max(best_own, own)
            whole = []
            for a, b, n in sorted({p for x in range(-len(item), len(w)) for p in leaks.pieces_on(w, item, x, 0)}):
                whole.append((a, b, n, n + max([g - max(0, c + m - a, e + m - b) for c, e, m, g in whole if c < a and e < b], default=0)))
            if best_own * 3 >= len(item) or max([x[3] for x in whole], default=0) * 2 > len(item):
                want.add((d, k, best, len(item)))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    for size in (100, 500_000):
        monkeypatch.setattr(leaks, "WORDS_PER_PASS", size)
        assert sorted(map(tuple, find_leaks(*df).collect())) == sorted(want)
    assert len(want) > 150


def test_residue(spark):
    docs = [
        (1, "Hello {{first_name}}! Your next visit is due."), (2, "My file lists {low, high} and {1, 2, 3} and I like that [name withheld]."), (3, "Lorem ipsum dolor sit amet, consectetur adipiscing elit."),
        (4, "blah blah blah TBD TBD TBD."), (5, "<h1>404 Not Found. Go back to the start page."), (6, "Please enable JavaScript to view this page."), (7, "I got a 404 not found when I opened the page of the clinic, so I called them instead. Then I went to bed early."),
        (8, None), (9, ""), (10, "word " * 30_000), (11, "%FIRSTNAME%, thank you."), (12, "The pump app asks me to enable JavaScript, does yours too? My knee hurts again today."),
    ]
    got = {r.doc_id: r.kind for r in find_residue(spark.createDataFrame(docs, "doc_id long, text string").withColumn("kind", F.lit("x"))).collect()}
    assert got == {1: "placeholder", 3: "filler", 4: "filler", 5: "error_page", 6: "script_notice", 11: "placeholder"}


def test_long_whole_pages(spark):
    docs = [
        (1, "Home | Forum | Search | Help\n" * 80 + "404 Not Found."), (2, "This is sample text. " * 100), (3, "Fatal error: boom\n" + "\n".join(f"at org.app.Main.run{i}(Main.java:{i})" for i in range(150))),
        (4, "I got a 404 not found when I opened the page of the clinic, so I called them instead. Then I went to bed early. " * 40), (5, " | ".join(["Home", "Forum"] * 3000) + "\nPlease enable JavaScript to view this page."),
        (6, "my knee hurts and " * 60 + "the page not found came up " + "so i went to bed " * 60), (7, "sample text " * 400),
    ]
    got = {r.doc_id: r.kind for r in find_residue(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "error_page", 2: "filler", 3: "error_page", 5: "script_notice", 7: "filler"}


def test_copies_of_a_cut_answer(spark):
    rng = random.Random(1)
    things = ["tea", "milk", "bread", "rice", "soup", "fish"]
    rows = [(i, f"Why does my knee hurt on day {i}?", f"Drink {rng.choice(things)} with {rng.choice(things)} and see whether your knee calms down.") for i in range(60)]
    rows += [(100 + i, "Why does my knee hurt?", "Drink tea with milk and see wheth") for i in range(8)] + [(200 + i, f"Did yours hurt on day {i}?", "Mine did") for i in range(8)]
    got = {r.key: r.defect for r in find_defects(spark.createDataFrame(rows, "id int, q string, a string"), "id", "q", "a").collect()}
    assert got == {100 + i: "truncated" for i in range(8)}


def test_copies_of_a_cut_term(spark):
    terms = [(i, f"bad {'very ' * (i % 9)}knee {i * i}", f"Known bad {'very ' * (i % 9)}knee {i * i} or use of tea.") for i in range(200)]
    terms += [(900 + i, "history of bad", "Known history of bad knee or use of tea.") for i in range(8)] + [(920 + i, "sore", f"Known sore left arm in case {i}.") for i in range(8)]
    got = {r.key for r in cut_terms(spark.createDataFrame(terms, "id int, t string, s string").withColumn("src", F.lit("b")), ["src"], "id", "t", "s").collect()}
    assert got == {*range(900, 908), *range(920, 928)}


def test_weak_marks_need_alignment(spark):
    docs = [
        (1, "My list has a [NOTE] beside rice."), (2, "She wrote one [NOTE] about sleep."), (3, "There was no [NOTE] under milk."),
        (4, "{name} wrote to us."), (5, "Anna wrote to us."), (6, "Bert wrote to us."), (7, "Yours truly, {sender}"), (8, "Yours truly, Anna"), (9, "Yours truly, Bert"),
    ]
    got = {r.doc_id: r.kind for r in find_residue(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {4: "placeholder", 7: "placeholder"}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, doc_id long, text string, host string, src string, g int, s string, t string, len int")
    assert strip_markup(df, "host", ["id"], "text").count() == 0
    assert find_residue(df).count() == 0
    assert cut_sentences(df, ["src"], "id", "s", ["g"]).count() == 0
    assert cut_terms(df, ["src"], "id", "t", "s").count() == 0
    assert length_limits(df, ["src"], "len").count() == 0
    assert ending_counts(df, "text").count() == 0


def test_slots_left_at_defaults_and_blanks(spark):
    names = ["Anna", "Bert", "Cleo", "Dora"]
    docs = [(i, f"Dear friend {n}, thank you for your question.") for i, n in enumerate(names)] + [(10, "Dear friend undefined, thank you for your question."), (11, "Dear friend , thank you for your question.")]
    docs += [(12, "My result was undefined by the lab."), (13, "We ate , then slept a lot."), (14, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.kind, r.evidence) for r in residue_evidence(df).collect()} == {(10, "placeholder", "slot"), (11, "placeholder", "slot")}


def test_alignment_in_passes_of_any_size(spark, monkeypatch):
    docs = [(i, f"Dear {n}, your visit on {d} is due.") for i, (n, d) in enumerate([("{name}", "Monday"), ("Anna", "{day}"), ("Bert", "Friday"), ("{who}", "{when}")])] + [(9, "Only one {lone} here.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(0, "{name}", True), (1, "{day}", True), (3, "{who}", True), (3, "{when}", True), (9, "{lone}", False)}
    for size in (1, 2, 500_000):
        monkeypatch.setattr(templates, "FRAMES_PER_PASS", size)
        assert {(r.doc_id, r.mark, r.unfilled) for r in template_slots(df, "doc_id", "text").collect()} == want


def test_message_learned_from_its_template(spark):
    nav = ["Home", "Forum", "Search", "Help", "Login"]
    page = lambda i, t: "\n".join([n for k, n in enumerate(nav) if i >> k & 1] + [t])
    docs = [(i, page(i, "404 Not Found. Kindly use the site map below.")) for i in range(1, 28)]
    docs += [(40 + i, page(i, "This leaf fell off the shelf. Kindly use the site map below.")) for i in range(1, 5)] + [(30, "I slept well. My knee is fine."), (31, "My leaf fell. Kindly use the site map below.")]
    got = {r.doc_id: (r.kind, r.evidence) for r in residue_evidence(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got.values()) == {("error_page", "page template")} and set(got) == {*range(1, 28), *range(41, 45)}


def test_message_learned_on_pages_of_any_length(spark):
    menu = ["Home", "Forum", "Search", "Help", "Login", "Menu", "Contact", "About", "Imprint", "Back", "Top", "FAQ", "News"]
    page = lambda i, t: "\n".join([*menu, *(n for k, n in enumerate(menu) if i >> k & 1), t])
    docs = [(i, page(i, "404 Not Found. Kindly use the site map below.")) for i in range(1, 40)]
    docs += [(40 + i, page(i, "This leaf fell off the shelf. Kindly use the site map below.")) for i in range(1, 4)]
    docs += [(50 + i, page(i, "A mouse ate this leaf. We will glue it soon. Kindly use the site map below.")) for i in range(1, 4)]
    docs += [(60 + i, page(i, f"I slept well on day {n}. My knee is fine. Kindly use the site map below.")) for i, n in ((1, "one"), (2, "two"))]
    got = {r.doc_id: (r.kind, r.evidence) for r in residue_evidence(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got.values()) == {("error_page", "page template")} and set(got) == {*range(1, 40), *range(41, 44), *range(51, 54)}


def test_messages_hold_a_trigger():
    said = [
        "comments are loaded by a script.", "turn on script", "scripts are off", "please run script", "scripting on", "noscript", "supported browsers", "outdated browser", "enable cookies", "javascript", "script is blocked", "requires script.",
        "404 page", "error code 418", "511 service.", "418 internal", "page you asked for", "page does not exist", "page can't be found", "couldn't load", "unable to reach", "access was denied", "no permission", "not authorized", "internal server error",
        "bad gateway", "gateway time-out", "request timed out", "too many requests", "service is temporarily unavailable", "session has expired", "something went wrong", "parse error", "fatal:", "warning: x", "undefined index", "on line 8",
        "has been moved", "moved or removed", "not writable", "under maintenance", "down for upkeep", "seite wurde nicht gefunden", "page introuvable", "no se encuentra la página", "página não encontrada", "página no encontrada",
        "acceso denegado", "zugriff verweigert", "accès refusé", "acesso negado", "erreur", "fehler 7", "oops", "sample text", "body copy", "text to follow", "content coming", "layout only", "will appear in this", "asdfgh", "replace before launch", "text goes here",
    ]
    assert [x for x in said if templates._said(x) is None] == []


def test_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names."""
    long = "word, " * 100_000 + "{{name}} " + "<b>x</b> " * 20_000
    rows = [(1, None, None), (None, "x", "some text. And more"), (2, "", ""), (3, "h", long), (3, "h", long), (4, None, "x" * 200_000), (5, "h", "404 not found 😀"), (6, "h", "\x00\x02  , , . ."), (6, "h", None)]
    df = spark.createDataFrame(rows, "id long, host string, t string")
    for c in ("doc_id", "text", "kind", "clean", "kinds", "page", "key", "a", "q", "len", "defect", "term", "frame", "mark", "words_held"):
        df = df.withColumn(c, F.lit("clash"))
    assert {r.doc_id: r.kind for r in find_residue(df, "id", "t").collect()} == {3: "placeholder", 5: "error_page"}
    clean = {r.id: r for r in strip_markup(df, "host", ["id"], "t").collect()}
    assert clean[3].kinds == ["html", "wiki"] and clean[2].kinds == [] and None in clean
    assert {r.key: r.defect for r in find_defects(df, "id", "host", "t").collect()}[2] == "empty"
    assert cut_sentences(df.withColumn("src", F.lit(None).cast("string")), ["src"], "id", "t", ["host"]).count() >= 0
    assert cut_terms(df.withColumn("src", F.lit("s")), ["src"], "id", "host", "t").count() >= 0
    items = spark.createDataFrame([(1, "word " * 30), (None, "word " * 30), (2, None)], "id long, t string").withColumn("doc_id", F.lit(7))
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, items, "id", "t", "id", "t").collect()} <= {(3, 1)}
    assert template_slots(df.limit(0), "id", "t").count() == 0
