"""Operators, sources and streams on small fixtures."""

import datetime

from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import criteria as C
from lexiloom.operators import graph as G
from lexiloom.operators import lexicon as L
from lexiloom.operators import ngrams as N
from lexiloom.operators import ordering as O
from lexiloom.operators import relational as R
from lexiloom.operators import vectors as V
from lexiloom.plans import extras, trials  # noqa: F401  (they register their queries)
from lexiloom.plans.registry import QUERIES
from lexiloom.runtime import meet
from lexiloom.sources import files as S
from lexiloom.streaming import windows as W

from .conftest import broadcast_sides, broadcasts_exploded, stored


def test_criterion_splitting():
    assert C.split_criterion("a: b: c: d") == ["a", "b", "c", "d"]
    assert C.split_criterion("x - y - z") == ["x", "y", "z"]
    assert C.split_criterion("Stable dose No surgery No pain") == ["Stable dose", "No surgery", "No pain"]
    assert C.split_criterion("No surgery") == ["No surgery"]
    assert C.split_criterion("a b c d Or e") == ["a b c d", "e"]
    assert C.split_criterion(None) == [] and C.split_criterion("") == []


def test_sections_and_their_guards(spark):
    texts = [
        "Intro here.\nInclusion Criteria: age over 5.\nGood one.\nExclusion Criteria: no.\nInclusion Criteria:", "Inclusion and exclusion criteria:\nAdults only.\nDisease characteristics: x\nnever both", None, "", "ok",
        "Non-inclusion criteria:\nBad one", "Inclusion criteria\nDISEASE CHARACTERISTICS: none\nInclusion criteria again", "Disease characteristics:\n- sore knee\n* weak hip\nPatient characteristics:\n1 adult\nPrior concurrent therapy:",
        "Both lists: the inclusion and exclusion criteria are long",
    ]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in C.criteria_rows(t, "doc_id", "text").orderBy("doc_id", "sent").collect():
        got.setdefault(r.doc_id, []).append((r.label, r["sub"]))
    assert [x[0] for x in got[0]] == ["Head", "Inclusion head", "Inclusion", "Exclusion head", "Inclusion head"]
    # with a colon the exclusion test comes first, and the later heads are not heard
    assert [x[0] for x in got[1]] == ["Exclusion head", "Exclusion", "Exclusion", "Exclusion"]
    assert [x[0] for x in got[5]] == ["Inclusion head", "Inclusion"]  # caught by the inclusion test
    assert [x[0] for x in got[6]] == ["Inclusion head", "Inclusion", "Inclusion"]
    assert got[7] == [("DISEASE CHARACTERISTICS", -1), ("DISEASE CHARACTERISTICS", 0), ("DISEASE CHARACTERISTICS", 0), ("PATIENT CHARACTERISTICS", -1), ("PATIENT CHARACTERISTICS", 3), ("PRIOR CONCURRENT THERAPY", -1)]
    assert got[8] == [("Head", -1)] and set(got) == {0, 1, 5, 6, 7, 8}


GRAMMAR = {
    "Stroke within 6 months": ("WITHIN", -1, 182 * 86400), "Any cancer for more than 2 weeks": ("WITHIN", -1, 14 * 86400), "Surgery greater than 3 days ago": ("MORETHAN_MT", 3 * 86400, -1), "History of stroke within 6 months": ("HISTORY_WITHIN", -1, 182 * 86400),
    "History of gout greater than 1 year": ("HISTORY_MT", 366 * 86400, -1), "History of gout within 2 weeks except for toe": ("HISTORY_WITHIN_EF", -1, 14 * 86400), "History of gout within 3-4 weeks prior to entry": ("HISTORY_WITHIN_PT", 21 * 86400, 28 * 86400),
    "Histologically confirmed tumor within 5 days": ("CONFIRMED_WITHIN", -1, 5 * 86400), "At least 4 weeks since prior radiotherapy": ("ATLEAST_PT", -1, 28 * 86400), "Positive test within 5 hours": ("POSITIVE_WITHIN", -1, 5 * 3600),
    "Prior statin for more than 5 days": ("PRIOR_MT", 5 * 86400, -1), "Concurrent statin for 5 days": ("CONCURRENT_EF", -1, 5 * 86400), "Negative test > = 2 days": ("MORETHAN_MT", 2 * 86400, -1), "Gout 2 weeks before entry": ("PRIOR_TO", -1, 14 * 86400),
    "Rest required for period 2 weeks prior to entry": ("REQUIRED_FOR_PERIOD", -1, 14 * 86400), "Prior statin for 5 days except for aspirin": ("PRIOR_FEF", -1, 5 * 86400), "Prior statin for 5 days including aspirin": ("PRIOR_FI", -1, 5 * 86400), "Two years old": None, "": None,
}


def test_grammar(spark):
    names = [n for n, _ in C.compile_rules()]
    assert len(names) == 34 and len(set(names)) == 29
    rows = spark.createDataFrame([(1, i, t, "x") for i, t in enumerate(GRAMMAR)] + [(1, 900, "x " * 5000 + "within 3 days", "x"), (1, 901, "No sign and never a stroke within 3 days without help", "x")], "doc_id int, sent long, s string, label string")
    got = {r.sent: r for r in C.match_patterns(rows).collect()}
    for i, (t, want) in enumerate(GRAMMAR.items()):
        assert (None if i not in got else (got[i].pattern, got[i].low_s, got[i].high_s)) == want, t
    assert got[900].pattern == "WITHIN" and (got[901].neg, got[901].neg_ahead) == (3, 2)


def test_quantity_and_keyword_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text("age,years old\n(op) cmp,<=? ?xxx\ndose,xxx mg\nshort\n")
    q = S.read_quantities(spark, str(tmp_path / "q.csv"))
    assert q == [("age", "years old"), ("(op) cmp", "<=? ?xxx"), ("dose", "xxx mg")]
    rows = spark.createDataFrame([("a 5mg dose",), ("<= 7 and 20.5 MG",), ("plain",), (None,)], "s string")
    got = [tuple(r) for r in rows.select(C.first_quantity(F.col("s"), q), C.all_quantities(F.col("s"), q)).collect()]
    assert got == [("None", ""), ("(op) cmp", "(op) cmp|dose"), ("None", ""), ("None", "")]
    (tmp_path / "k.csv").write_text("# heart\n1,C1,Heart Failure\n2,C2,attack\n# skin\n1,C3,rash\n")
    k = S.read_keyword_rows(spark, str(tmp_path / "k.csv"))
    assert [tuple(r) for r in k.orderBy("cui").collect()] == [("heart", 1, "C1", "Heart Failure"), ("heart", 2, "C2", "attack"), ("skin", 1, "C3", "rash")]
    s = spark.createDataFrame([(1, 0, "Known heart failure, or a rash."), (1, 1, "Nothing")], "doc_id int, sent int, s string")
    assert sorted((r.sent, r.cui or "-") for r in C.keyword_hits(s, k).collect()) == [(0, "C1"), (0, "C3"), (1, "-")]


def test_nesting_and_c_value(spark):
    f = spark.createDataFrame([("a b c", 3, 4), ("a b", 2, 6), ("b c", 2, 4), ("a", 1, 9)], "gram string, n int, tf long").withColumn("df", F.col("tf"))
    got = {r.gram: (r.nested_tf, r.containers, round(r.cvalue, 6)) for r in N.c_value(N.nesting(f)).collect()}
    assert got["a b"] == (4, 1, round(1.584962500721156 * 2, 6)) and got["b c"] == (4, 1, 0.0) and got["a"] == (10, 2, 4.0)


def test_context_without_neighbour(spark):
    occ = spark.createDataFrame([(1, 0, 1, 1, "x"), (1, 0, 4, 1, "y"), (2, 0, 1, 1, "x")], "doc_id int, seg int, start int, n int, gram string")
    known = spark.createDataFrame([("y",)], "gram string")
    got = {r.gram: (r.places, r.neighbours, r.distance) for r in N.context_counts(occ, known).collect()}
    assert got == {"x": (2, 1, 13), "y": (1, 0, 10)}


def test_lookup_by_each_key(spark):
    lex = L.build_lexicon(spark.createDataFrame([("C1", "A1", "S", "Chronic pains"), ("C1", "A2", "LAYVOC", "Pain, chronic"), (None, "A3", "S", "x"), ("C2", "A4", "S", "  ")], "cui string, aui string, sab string, s string"), "cui", "aui", "sab", "s")
    assert lex.count() == 2 and {r.preferred for r in lex.collect()} == {"Chronic pains"}
    hits = L.lookup(spark.createDataFrame([("chronic pain",), (None,), ("",)], "phrase string"), lex)
    assert {r.aui for r in hits.collect()} == {"A1", "A2"}
    best = L.best_pair(hits).collect()
    assert len(best) == 1 and 0 < best[0].chv_score <= best[0].umls_score <= 100


def test_relational_nulls_and_ties(spark):
    t = spark.createDataFrame([(1, None, 5), (2, "a", 7), (3, "a", 7), (4, None, None)], "id int, g string, v int")
    assert sorted(r.id for r in R.argmax_rows(t, ["g"], "v").collect()) == [1, 2, 3]
    assert sorted(r.id for r in R.delete_where(t, F.col("g") == "a").collect()) == [1, 4]
    up = R.update_from(t, spark.createDataFrame([(2, "z"), (2, "y")], "id int, g string"), ["id"], "g")
    assert {r.id: r.g for r in up.collect()} == {1: None, 2: "y", 3: "a", 4: None}
    e = spark.createDataFrame([("a", "b"), (None, "b")], "x string, y string")
    f = spark.createDataFrame([("b", "a")], "p string, q string")
    assert R.undirected_join(e, f, ("x", "y"), ("p", "q")).count() == 1
    hits = R.union_of_keys(t.withColumn("h", F.col("g")), spark.createDataFrame([("a", 1)], "k string, w int"), [("g", "k"), ("h", "k")], "id")
    assert hits.count() == 2


def test_graph_with_a_cycle(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "x"), ("p", "q"), ("q", "p"), (None, "a"), ("a", "a")], "child string, parent string")
    got = {r.node: (r.kind, r["head"], r.steps) for r in G.group_under_roots(e).collect()}
    assert got["a"] == ("root", "a", 0) and got["c"] == ("child", "a", 2) and got["d"] == ("new_root", "d", 0) and got["p"] == ("child", "p", -1)
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(50)] + [("m0", "m1"), ("m1", "m2"), ("m2", "m1")], "child string, parent string")
    got = {r.node: (r["head"], r.steps) for r in G.group_under_roots(chain).collect()}
    assert all(got[f"n{i}"] == ("n50", 50 - i) for i in range(51)) and got["m0"] == ("m0", -1) and got["m1"] == ("m1", -1)
    numbered = G.group_numbers(G.group_under_roots(e))
    assert {r.node: r.group_id for r in numbered.collect()} == {"a": 1, "b": 1, "c": 1, "d": 2, "x": 3, "p": 0, "q": 0}
    assert {r.group_id: (r.members, r.children, r.kind) for r in G.group_kinds(numbered).collect()} == {1: (3, 2, "root"), 2: (1, 0, "new_root"), 3: (1, 0, "single")}
    packed = spark.createDataFrame([("b,a;c,b;c,b; z,null",), (None,), ("",)], "p string")
    assert {tuple(r) for r in G.unpack_edges(packed, "p").collect()} == {("b", "a"), ("c", "b"), ("z", None)}
    assert {tuple(r) for r in G.split_new_roots(e).collect()} == {("b", "a"), ("c", "b"), ("p", "q"), ("q", "p")}
    assert {tuple(r) for r in G.split_new_roots(e, copies=True).collect()} == {("b", "a"), ("c", "b"), ("p", "q"), ("q", "p"), ("d@c", "c"), ("d@x", "x")}
    assert G.group_under_roots(e.limit(0)).count() == 0
    below = {(r.node, r.depth) for r in G.descendants(e, spark.createDataFrame([("a",)], "root string")).collect()}
    assert below == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_closure_of_every_parent(spark, tmp_path):
    edges = [("C90", "C80"), ("C91", "C90"), ("C80", "C10"), ("C10", "C91"), ("C95", "C99"), ("C95", "C95"), (None, "C80"), ("C90", None)] + [(f"D{i + 1}", f"D{i}") for i in range(8)]
    spark.createDataFrame([(a, b, "PAR" if i % 2 else "RB") for i, (a, b) in enumerate(edges)] + [("C1", "C2", "SY")], "cui1 string, cui2 string, rel string").write.parquet(str(tmp_path / "content_tag_compare_only_our.parquet"))
    below = {}
    for a, b in edges:
        if a and b and a != b:
            below.setdefault(b, set()).add(a)
    want = set()
    for root in below:
        depth, at = {root: 0}, {root}
        for k in range(1, G.DEPTH + 1):
            at = {c for n in at for c in below.get(n, ())} - set(depth)
            depth |= dict.fromkeys(at, k)
        want |= {(root, n, k) for n, k in depth.items()}
    got = [(r.root, r.node, r.depth) for r in QUERIES["concept_closure"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def _english(spark, tmp_path, texts, lang="en"):
    spark.createDataFrame([(i, "blog" if i % 2 else None, lang, t) for i, t in enumerate(texts)], "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))


def test_sequence_of_every_document(spark, tmp_path):
    _english(spark, tmp_path, ["red knee hurts", "cold tea", None], None)
    got = [(r.doc_id, r.ordinal, r.gram) for r in QUERIES["ngram_sequence"](spark, str(tmp_path)).orderBy("doc_id", "ordinal").collect()]
    first = ["red", "red knee", "red knee hurts", "knee", "knee hurts", "hurts"]
    assert got == [(0, i + 1, g) for i, g in enumerate(first)] + [(1, 1, "cold"), (1, 2, "cold tea"), (1, 3, "tea")]


def test_vector_of_every_gram(spark, tmp_path):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts = [w for w in words for _ in range(12)] + ["rare worda" + chr(98)] + ["wordaa wordac"] * 2
    _english(spark, tmp_path, texts)
    got = {(r.gram, r.word): r.n for r in QUERIES["bow_cooccur_vector"](spark, str(tmp_path)).collect()}
    want = {("rare", "wordab"): 1, ("rare wordab", "wordab"): 1, ("wordaa", "wordac"): 2, ("wordac", "wordaa"): 2, ("wordaa wordac", "wordaa"): 2, ("wordaa wordac", "wordac"): 2}
    assert got == want


def test_vector_broadcasts_the_vocabulary_alone(spark, tmp_path):
    rows = [(i, "red knee") for i in range(12)] + [(90, "red knee, red knee hurts red"), (91, "red tea"), (91, "red tea, knee"), (None, "red knee"), (92, None)]
    stored(spark, tmp_path, "documents.parquet", rows, "doc_id long, text string")
    v = QUERIES["bow_cooccur_vector"](spark, str(tmp_path))
    vocabulary = {"red", "knee", "red knee"}
    sides = " ".join(side.output().mkString(" ") for side in broadcast_sides(v))
    assert "tf#" not in sides and "doc_id#" not in sides
    got = {(r.gram, r.word): (r.n, r.per_place) for r in v.collect()}
    assert {w for _, w in got} == vocabulary and len(got) == len(set(got))
    assert got["red", "knee"] == (14, round(14 / 18, 6)) and got["hurts", "red"] == (1, 1.0) and got["red tea", "red"] == (1, 0.5) and ("red", "red") not in got


def test_suffixes_are_not_broadcast(spark, tmp_path):
    rows = [(1, "b", "S", "left Knee"), (2, "b", "S", "knee"), (3, "b", None, "left knee"), (4, "c", "S", "Knee"), (5, "b", "S", ""), (6, "b", "S", "LEFT knee")]
    stored(spark, tmp_path, "content_tag.parquet", rows, "id long, blogid string, sab string, target string")
    s = QUERIES["suffix_parents"](spark, str(tmp_path))
    assert not any("suffix#" in side.output().mkString(" ") for side in broadcast_sides(s))
    got = sorted((r.id, r.parent or "") for r in s.collect())
    assert got == [(1, "LEFT knee"), (1, "knee"), (2, ""), (3, ""), (4, ""), (6, "knee"), (6, "left Knee")]


def test_vectors(spark):
    e = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [5.0, 5.0])], "id long, v array<double>")
    got = [(r.query, r.key, r.place) for r in V.knn(e, e.filter("id = 1"), "id", "v", 2).orderBy("place").collect()]
    assert got == [(1, 2, 1), (1, 3, 2)]
    import numpy as np

    x = np.random.default_rng(1).normal(size=(300, 5)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>")
    got = {(r.query, r.place): r.key for r in V.knn(df, df.filter("id % 20 = 0"), "id", "v", 4).collect()}
    want = {(q, p + 1): k for q in range(0, 300, 20) for p, (_, k) in enumerate(sorted((((x[k] - x[q]) ** 2).sum(), k) for k in range(300) if k != q)[:4])}
    assert got == want and V.knn(df.limit(0), df, "id", "v").count() == 0
    n = V.nearest_centres(e, "id", "v", [(0, [0.0, 0.0]), (1, [5.0, 5.0])])
    assert {r.key: r.centre for r in n.collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


def test_grams_of_annotation_are_not_broadcast(spark, tmp_path):
    docs = stored(spark, tmp_path, "docs", [(1, "Red knee, red knee hurts"), (2, None)], "id int, s string")
    concepts = [("C1", "red knee"), ("C2", "red knee"), ("C3", "hurts"), ("C1", "red knee")] + [(f"D{i}", f"other {i}") for i in range(3000)]
    lexicon = stored(spark, tmp_path, "lexicon", concepts, "cui string, norm string")
    a = L.annotate(docs, "id", "s", lexicon)
    assert not broadcasts_exploded(a)
    assert sorted((r.seg, r.start, r.gram, r.cui) for r in a.collect()) == [(0, 1, "red knee", "C1"), (0, 1, "red knee", "C2"), (1, 1, "red knee", "C1"), (1, 1, "red knee", "C2"), (1, 3, "hurts", "C3")]


def test_meeting_of_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else None) for i in range(200)] + [(900, "b"), (901, "z")], "i int, k string")
    lookup = spark.createDataFrame([("hot", 1), ("b", 2), ("c", 3)], "k string, n int")
    for most in (0, 100):
        assert sorted((r.i, r.n) for r in meet(rows, lookup, ["k"], max_rows=most).collect()) == [(i, 1) for i in range(1, 200, 2)] + [(900, 2)]
        assert meet(rows, lookup, ["k"], "left", most).count() == 202


def test_copies_of_a_large_lookup_are_not_broadcast(spark, tmp_path):
    rows = stored(spark, tmp_path, "rows", [(i, "hot") for i in range(200)], "i int, k string")
    lookup = stored(spark, tmp_path, "lookup", [("hot", 1), ("b", 2)], "k string, n int")
    met = meet(rows, lookup, ["k"], max_rows=1)
    assert not broadcast_sides(met) and met.count() == 200


def test_large_groups_meet_in_parts(spark):
    rows = [("a", i) for i in range(60)] + [("b", 1), ("b", 2), (None, 5)]
    df = spark.createDataFrame(rows, "g string, i int")
    want = sorted((g, i, j) for g, i in rows for h, j in rows if g is not None and g == h)
    for per in (7, 1000):
        assert sorted(map(tuple, R.meet_within(df, ["g"], {"i": "j"}, per).select("g", "i", "j").collect())) == want


def test_next_row_of_a_hot_group(spark):
    rows = [("a" if i % 3 else None, f"{i:03}") for i in range(200)] + [("b", "x")]
    got = {(r.g, r.t): r.n for r in O.with_next(spark.createDataFrame(rows, "g string, t string"), ["g", "t"], "t", "n", ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted(t for k, t in rows if k == g)
        want |= {(g, t): n for t, n in zip(mine, [*mine[1:], None], strict=True)}
    assert got == want


def test_scores_and_periods(spark):
    r = spark.range(1).select(
        X.similarity(F.lit(""), F.lit("")).alias("e"), X.similarity(F.lit("Abc"), F.lit("abd")).alias("s"), X.period_seconds(F.lit("P1Y")).alias("y"), X.period_seconds(F.lit("PX")).alias("x"),
        X.string_to_int(F.lit("7.9")).alias("i"), X.string_to_int(F.lit("no"), 3).alias("d"), X.capital_class(F.lit("Heart Failure")).alias("c"), X.collapse_pos(F.lit("NNS")).alias("p"),
    ).first()
    assert (r.e, round(r.s, 4), r.y, r.x, r.i, r.d, r.c, r.p) == (0.0, 0.6667, 366 * 86400, -1, 7, 3, "term", "N")


def test_files(spark, tmp_path):
    dump = spark.createDataFrame([('noise<doc id="7" title="T x">\nbody <b>one</b>\n\n\nmore</doc><doc id="8" title="U">\n</doc>',)], "value string")
    assert [(r.doc_id, r.title, r.body.strip()) for r in S.parse_dump(dump, "value").collect()] == [(7, "T x", "body one\nmore"), (8, "U", "")]
    (tmp_path / "k.txt").write_text("# heart\nfailure\nattack\n# skin\nrash\n")
    assert [(r.root, r.keyword) for r in S.read_keywords(spark, str(tmp_path / "k.txt")).collect()] == [("heart", "failure"), ("heart", "attack"), ("skin", "rash")]
    (tmp_path / "w.txt").write_text("# words\nab\nabc\n\n")
    assert S.read_words(spark, str(tmp_path / "w.txt")) == ["abc", "ab"]
    (tmp_path / "t.txt").write_text("ab|T1|Finding\ncd|T2|Drug\n")
    (tmp_path / "g.txt").write_text("G|Group|T1|Finding\nG|Group|T3|Other\n")
    assert {tuple(r) for r in S.read_types(spark, str(tmp_path / "t.txt"), str(tmp_path / "g.txt")).collect()} == {("T1", "ab", "Finding", "G"), ("T2", "cd", "Drug", None), ("T3", None, "Other", "G")}
    (tmp_path / "v.txt").write_text("pain 7\nache 2\n")
    assert [tuple(r) for r in S.read_vocabulary(spark, str(tmp_path / "v.txt"), 3).collect()] == [("pain", 7)]
    df = spark.createDataFrame([("1", 'say "hi"\nnow, ok', None)], S.CRITERIA)
    S.write_quoted(df, str(tmp_path / "q"))
    back = S.read_separated(spark, str(tmp_path / "q"), S.CRITERIA, header=True).collect()
    assert (back[0].tid, back[0].criteria) == ("1", 'say "hi"\nnow, ok')
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("one\ntwo")
    assert S.read_texts(spark, str(tmp_path / "docs")).first().text == "one\ntwo"
    assert spark.range(1).select(S.visible_text(F.lit("<head>x</head><p>see <b>me</b></p><script>no</script>")).alias("t")).first().t == "see me"


def test_stream_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2020, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=7 * i), "a" if i % 3 else "b", float(i)) for i in range(60)] + [(900, t0 + datetime.timedelta(days=3), "late", 1.0)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    for k, part in enumerate((F.col("event_id") < 20, F.col("event_id").between(20, 39), F.col("event_id") >= 40)):
        e.filter(part).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    stream = W.follow_folder(spark, str(tmp_path / "in/*"), e.schema)
    W.run_available(W.tumbling(stream, "1 hour", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.start, r.event_type): (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type): (r.n, r.total) for r in W.tumbling(e, "1 hour").collect() if r.event_type != "late"}
    assert got == want  # the last event lets the watermark close every window but its own
