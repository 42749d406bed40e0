"""Suggestions, criteria outputs, layers, silhouettes and annotation on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import criteria as C
from lexiloom.operators import graph as G
from lexiloom.operators import lexicon as L
from lexiloom.operators import relational as R
from lexiloom.operators import suggestions as S
from lexiloom.operators import vectors as V
from lexiloom.sources import files, outputs

from .conftest import broadcasts_exploded, stored


def lexicon(spark):
    rows = [("C1", "A1", "S", "knee pain"), ("C2", "A2", "S", "pain"), ("C3", "A3", "LAYVOC", "heart failure"), ("C4", "A4", "S", "left heart")]
    return L.build_lexicon(spark.createDataFrame(rows, "cui string, aui string, sab string, s string"), "cui", "aui", "sab", "s")


def test_candidates_and_resolution(spark):
    rows = [(1, "the bad knee pain"), (2, "acute heart failure or shock"), (3, None), (4, " ; "), (5, "old sharp left knee pain quickly"), (6, "nothing known"), (7, "x " * 3000 + "knee pain")]
    df = spark.createDataFrame(rows, "id int, p string")
    c = S.candidates(df, "id", "p")
    got = {(r.key, r.candidate): (r["rank"], r.width, r.skipped) for r in c.collect()}
    assert got[1, "bad knee pain"] == (S.FULL, 3, 0) and got[1, "knee pain"] == (S.SUFFIX, 2, 0) and got[1, "bad pain"] == (S.HEAD, 2, 1) and (1, "the bad") not in got
    assert (2, "acute heart failure shock") in got and got[5, "old sharp left knee pain"][0] == S.FULL and not {3, 4} & {k for k, _ in got}
    found = {(r.key, r.candidate, r.cui) for r in S.resolve(c, lexicon(spark)).collect()}
    assert found == {(1, "knee pain", "C1"), (5, "knee pain", "C1"), (2, "heart failure", "C3"), (7, "knee pain", "C1")}
    out = S.fan_out(df.select("id"), spark.createDataFrame([(1, "C1", "T1"), (1, "C1", "T2"), (1, "C1", "T1")], "id int, cui string, tui string"), "id")
    assert sorted(map(tuple, out.filter("id < 3").collect())) == [(1, "C1", "T1"), (1, "C1", "T2"), (2, "none", "none")]
    assert S.candidates(df.limit(0), "id", "p").count() == 0


def test_candidates_are_not_broadcast(spark, tmp_path):
    phrases = stored(spark, tmp_path, "phrases", [(1, "the bad knee pain"), (2, None)], "id int, p string")
    concepts = [("C1", "knee pain"), ("C2", "knee pain"), ("C3", "pain")] + [(f"D{i}", f"other {i}") for i in range(3000)]
    found = S.resolve(S.candidates(phrases, "id", "p"), stored(spark, tmp_path, "lexicon", concepts, "cui string, norm string"))
    assert not broadcasts_exploded(found)
    assert sorted((r.key, r.candidate, r.cui) for r in found.collect()) == [(1, "knee pain", "C1"), (1, "knee pain", "C2")]


def test_masks(spark):
    rows = [("p", "C1", "T1", 90.0), ("p", "C1", "T2", 90.0), ("p", "C1", "T3", 90.0), ("p", "C2", "T4", 95.5), ("p", "C3", "T9", 95.9), ("q", "C1", "T2", 10.0), ("q", None, "T1", 1.0), ("p", "C2", "T4", 95.5)]
    rules = [("T2", "T1", "T1"), ("T4", "T1", "T1"), ("T5", "T6", "T6")]
    got = {(r.phrase, r.cui, r.tui): r["mask"] for r in S.preference_masks(spark.createDataFrame(rows, "phrase string, cui string, tui string, score double"), spark.createDataFrame(rules, "a string, b string, preferred string")).collect()}
    assert got == {("p", "C1", "T1"): 8, ("p", "C1", "T2"): 1, ("p", "C1", "T3"): 4, ("p", "C2", "T4"): 2, ("p", "C3", "T9"): 0, ("q", "C1", "T2"): 0}
    best = S.best_per_type(spark.createDataFrame(rows, "phrase string, cui string, tui string, score double"))
    assert best.filter("phrase = 'p'").count() == 5


def test_preference_file(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("sty1\tname1\tsty2\tname2\tcnt\tpreferred\nT1\tA\tT2\tB\t5\tT1\nT3\tA\tT4\tB\t5\t\n")
    assert [tuple(r) for r in files.read_preferences(spark, str(tmp_path / "r.tsv")).collect()] == [("T1", "T2", "T1")]


def test_layers(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("d", "x"), ("p", "q"), ("q", "p"), ("r", "q"), (None, "a")], "child string, parent string")
    placed = G.layers(e)
    assert {r.node: r.layer for r in placed.collect()} == {"a": 0, "x": 0, "b": 1, "c": 2, "d": 3, "p": -1, "q": -1, "r": -1}
    assert {(r.child, r.parent): r.relays for r in G.relays(e, placed).collect()} == {("b", "a"): 0, ("c", "b"): 0, ("c", "a"): 1, ("d", "c"): 0, ("d", "x"): 2}
    assert G.layers(e.limit(0)).count() == 0


def test_silhouette_like_brute_force(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    x, y = np.vstack([x, x[:1]]), np.append(y, 9)  # one row alone in its cluster
    got = {r.key: r.s for r in V.silhouette(spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))] + [(99, None, 1)], "i long, v array<double>, c int"), "i", "v", "c").collect()}
    for i in range(41):
        d = ((x - x[i]) ** 2).sum(axis=1)
        own = (y == y[i]) & (np.arange(41) != i)
        a, b = d[own].mean() if own.any() else None, min(d[y == c].mean() for c in set(y.tolist()) - {int(y[i])})
        assert abs(got[i] - (0 if a is None else (b - a) / max(a, b))) < 1e-9


def test_scored_annotation(spark):
    d = spark.createDataFrame([(1, "My Knee Pain, and heart failure."), (1, None), (2, ""), (3, "pain pain")], "id int, t string").distinct()
    got = sorted((r.doc_id, r.hit, r.gram, r.codes) for r in L.annotate_scored(d, "id", "t", lexicon(spark), 75.0).collect())
    assert got == [(1, 1, "knee pain", "C1"), (1, 2, "pain", "C2"), (1, 3, "heart failure", "C3"), (3, 1, "pain", "C2"), (3, 2, "pain", "C2")]


def test_given_filters_and_shares(spark):
    t = spark.createDataFrame([("ab", None), ("b", "x")], "a string, b string")
    assert R.where_given(t, {"a": "%b", "b": None}).count() == 2 and R.where_given(t, {"b": "%%"}).count() == 1
    shares = [r[0] for r in spark.range(2000).select(R.md5_share(F.col("id").cast("string"), "s")).collect()]
    assert set(shares) <= set(range(100)) and 380 < sum(x < 20 for x in shares) < 420
    r = spark.createDataFrame([(1, 4, 3, 9)], "a int, b int, c int, d int").select(X.spans_overlap("a", "b", "c", "d").alias("o"), X.span_holds("a", "b", "c", "d").alias("h"), *X.merge_spans("a", "b", "c", "d"), X.skip_count(F.lit(1), F.lit(9), F.lit(4)).alias("k")).first()
    assert tuple(r) == (True, False, 1, 9, 5)


def test_outputs(spark, tmp_path):
    texts = [(1, "Inclusion Criteria: acute heart failure within 6 months. Knee pain, strange glow.\nExclusion Criteria: no pain for 2 weeks."), (2, None)]
    trials = spark.createDataFrame(texts, "doc_id int, text string")
    k = spark.createDataFrame([("heart", "C3", "heart failure")], "root string, cui string, keyword string")
    for job in outputs.JOBS:
        outputs.run_job(job, spark, trials, lexicon(spark), k, str(tmp_path))
    read = lambda name: spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / name))
    assert {r.pattern for r in read("pattern").collect()} and read("normalized").count() == 3
    assert {r.cui for r in read("concept").collect()} | {r.cui for r in read("external").collect()} >= {"C1", "C3"} and "strange glow" in {r.term for r in read("other").collect()}
    quoted = lambda name: spark.read.option("header", True).option("quote", '"').csv(str(tmp_path / name))
    assert quoted("keyword").filter("cui = 'C3'").count() == 1 and quoted("split").count() >= 1 and quoted("quantity").count() == 3
    with pytest.raises(ValueError):
        outputs.run_job("other", spark, trials, lexicon(spark), k, str(tmp_path))
    docs = spark.createDataFrame([(1, "leg knee hurts. leg knee aches"), (2, "leg knee"), (3, None)], "doc_id int, text string")
    outputs.write_grams(docs, "doc_id", "text", str(tmp_path / "g"))
    g = {r.gram: r for r in read("g/grams").collect()}
    assert (g["leg knee"].tf, g["leg knee"].df, g["leg knee"].doc_id, g["leg knee"].nn) == ("3", "2", "1", "T") and read("g/vectors").count() > 0
    outputs.write_tokens(docs, "text", str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t/tokens")).collect()) == ["leg knee", "leg knee aches", "leg knee hurts"]
    assert {r.token: (r.norm, r.n) for r in read("t/statistics").collect()}["knee"] == ("knee", "3")
    outputs.write_groups(spark.createDataFrame([("b", "a"), ("c", "b")], "child string, parent string"), str(tmp_path / "s"))
    assert quoted("s/members").count() == 3 and quoted("s/groups").first().members == "3"


def test_tables_and_lexicon_files(spark, tmp_path):
    (tmp_path / "lex.csv").write_text('"C1","A1","S","knee ""pain""","knee pain"\n"C2","A2","S"\n')
    lex = files.read_lexicon(spark, str(tmp_path / "lex.csv"))
    assert [r.cui for r in lex.collect()] == ["C1"]
    files.write_json(lex, str(tmp_path / "j"), 1)
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    spark.sql("drop table if exists lexiloom_bucketed")
    files.write_bucketed(lex, "lexiloom_bucketed", "cui", 2)
    assert spark.table("lexiloom_bucketed").count() == 1
    spark.sql("drop table lexiloom_bucketed")
    rows = files.read_separated(spark, str(tmp_path / "q.csv"), files.CRITERIA, line_sep="`", header=True) if (tmp_path / "q.csv").write_text("tid,criteria,thread_id`1,\"a, b\",x`2,c,y`") else None
    assert [(r.tid, r.criteria) for r in rows.collect()] == [("1", "a, b"), ("2", "c")]


def test_database_read_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no database driver here")
    spark.range(50).selectExpr("id as k", "cast(id * 2 as double) as v").write.jdbc(url, "t", properties={"driver": driver})
    got = files.read_database(spark, url, "t", "k", 0, 50, 3, driver=driver)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 50 and got.agg(F.sum("v")).first()[0] == 2450.0


def test_empty_criteria(spark):
    t = spark.createDataFrame([], "doc_id int, text string")
    rows = C.criteria_rows(t, "doc_id", "text")
    assert rows.count() == 0 and C.match_patterns(rows).count() == 0
    k = spark.createDataFrame([], "root string, cui string, keyword string")
    assert C.keyword_hits(rows, k).count() == 0
