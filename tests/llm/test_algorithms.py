"""Pair counts, outranking flows and mixes against brute force."""

import itertools
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import cooccur, outranking, queries
from lexiloom.llm.cooccur import PairCounter, pair_lift
from lexiloom.llm.mixing import flight, land, mix_sources
from lexiloom.llm.outranking import Score, outranking_flows, rank_items

from ..conftest import DATA


def brute_pairs(rows):
    held = {}
    for i, c in rows:
        if i is not None and c is not None and c.strip():
            held.setdefault(i, set()).add(c.strip().upper())
    n = Counter(c for s in held.values() for c in s)
    ab = Counter(p for s in held.values() for p in itertools.combinations(sorted(s), 2))
    return {p: (n[p[0]], n[p[1]], k, len(held)) for p, k in ab.items()}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 12)), st.one_of(st.none(), st.sampled_from(["a", " A", "b", "c ", "d", "e", "", " ", "F", "f"]))), min_size=1, max_size=120))
def test_pairs_like_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "i long, code string").withColumn("n", F.lit(1))
    got = {(r.a, r.b): (r.n_a, r.n_b, r.n_ab, r.n) for r in pair_lift(df, "i", "code").collect()}
    assert got == brute_pairs(rows)


def test_pairs_query_gives_rare_pairs(spark, tmp_path):
    rows = [(i, c) for i in range(6) for c in "ab"] + [(7, "a"), (7, "rare"), (8, "once"), (8, "rare")]
    spark.createDataFrame(rows, "instance_id long, code string").write.parquet(str(tmp_path / "content_tag_ytex.parquet"))
    got = {(r.code_a, r.code_b): (r.n_a, r.n_b, r.n_ab) for r in queries.queries()["p6_lift"](spark, str(tmp_path)).collect()}
    assert got == {p: v[:3] for p, v in brute_pairs(rows).items()} and len(got) == 3


def test_counter_parts_agree():
    rng = np.random.default_rng(3)
    baskets = [np.unique(rng.zipf(1.4, 30) % 40) for _ in range(300)]
    want = Counter(p for b in baskets for p in itertools.combinations(b.tolist(), 2))
    for items, heavy in ((40, 0), (40, 5), (40, 40), (3000, 7)):
        c = PairCounter(items, heavy)
        frames = [f for s in range(0, 300, 70) for f in c.add(baskets[s : s + 70])]
        got = Counter()
        for df in [*frames, *c.result()]:
            for k, n in zip(df["pair"], df["n_ab"], strict=True):
                got[(k // items, k % items)] += n
        assert +got == want, (items, heavy)


def test_full_memory_and_large_baskets(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "DENSE", 0)
    monkeypatch.setattr(cooccur, "PAIRS_HELD", 50)
    rng = np.random.default_rng(4)
    baskets = [np.unique(rng.integers(0, 60, 25)) for _ in range(80)]
    c = PairCounter(60, 3)
    frames = [f for s in range(0, 80, 16) for f in c.add(baskets[s : s + 16])]
    assert len(frames) > 5 and c.held <= 2 * 50 + 60 * 60
    want, got = Counter(p for b in baskets for p in itertools.combinations(b.tolist(), 2)), Counter()
    for df in [*frames, *c.result()]:
        got.update({(k // 60, k % 60): n for k, n in zip(df["pair"].tolist(), df["n_ab"].tolist(), strict=True)})
    assert got == want
    monkeypatch.setattr(cooccur, "BASKET_ITEMS", 7)
    rows = [(i, f"c{k:02}") for i, b in enumerate(baskets[:12]) for k in b.tolist()] + [(50, "c01"), (50, "c02"), (51, "c01")]
    got = {(r.a, r.b): (r.n_a, r.n_b, r.n_ab, r.n) for r in pair_lift(spark.createDataFrame(rows, "i long, code string"), "i", "code").collect()}
    assert got == brute_pairs(rows)


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "i long, code string")
    assert pair_lift(df, "i", "code").count() == 0
    assert pair_lift(spark.createDataFrame([(1, None)], "i long, code string"), "i", "code", 5, 0.1).count() == 0


def brute_flow(values, q, t):
    have = {k: v for k, v in values.items() if v is not None}
    n = len(have)
    p = {k: 2 * sum(w < v for w in have.values()) + sum(w == v for w in have.values()) for k, v in have.items()}
    qq = int(2 * n * q)
    tt = max(int(2 * n * t), qq + 1)
    g = lambda d: 0 if abs(d) <= qq else (1 if d > 0 else -1) * min(abs(d) - qq, tt - qq) / (tt - qq)
    return {k: sum(g(p[k] - p[j]) for j in p) / (n - 1) if k in p and n > 1 else 0.0 for k in values}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 6)), st.one_of(st.none(), st.sampled_from(["1", "2.5", "1,000", "nan", "-", "inf", "7e1", ""]))), min_size=1, max_size=40))
def test_flows_like_brute_force(spark, rows):
    df = spark.createDataFrame([(f"t{i}", a, b) for i, (a, b) in enumerate(rows)], "name string, a int, b string")
    df = df.unionByName(df).withColumn("key", F.lit("clash"))
    number = {"1": 1.0, "2.5": 2.5, "1,000": 1000.0, "7e1": 70.0}
    want_a = brute_flow({f"t{i}": a if a is not None and a >= 0 else None for i, (a, _) in enumerate(rows)}, 0.02, 0.25)
    want_b = brute_flow({f"t{i}": number.get(b) for i, (_, b) in enumerate(rows)}, 0.02, 0.25)
    out = rank_items(outranking_flows(df, "name", [Score("a", 0), Score("b")])).collect()
    assert len(out) == len(rows)
    for r in out:
        assert abs(r.flow_a - want_a[r.key]) < 1e-9 and abs(r.flow_b - want_b[r.key]) < 1e-9
        assert r.place == 1 + sum(o.net_flow > r.net_flow for o in out)


def test_counts_up_to_marks_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"t{i}", int(rng.integers(0, 30)), float(rng.normal()) if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, a int, b double")
    run = lambda: sorted(map(tuple, outranking_flows(df, "name", [Score("a"), Score("b")]).collect()))
    few = run()
    monkeypatch.setattr(outranking, "small_enough", lambda *_: False)
    assert run() == few


def test_flows_of_nothing(spark):
    df = spark.createDataFrame([], "name string, a int")
    assert rank_items(outranking_flows(df, "name", [Score("a")])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=80), st.floats(0.02, 0.98))
def test_flight_keeps_totals(sizes, p):
    x = np.array(sizes, float)
    pi = np.full(len(x), p)
    out = flight(pi, x, 5)
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * x).sum() - (pi * x).sum()) < 1e-3
    assert sum(0 < v < 1 for v in out) <= 2
    assert set(land(pi, x, 5)) <= {0.0, 1.0}


def test_mix(spark):
    docs = [(i, "a", "word " * (1 + i % 7)) for i in range(300)] + [(1000 + i, "b", "some text here " * (i % 5)) for i in range(40)] + [(2000, None, "x y"), (2001, "other", "x"), (2002, "a", None)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeat int")
    mix, shares = mix_sources(d, t)
    rows = mix.collect()
    cap = {"a": 1, "b": 3}
    assert all(1 <= r["copies"] <= cap[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    s = {r.source: r for r in shares.collect()}
    assert s["none"].share == 0 and abs(s["a"].share - 5 / 9) < 0.02 and abs(s["b"].share - 4 / 9) < 0.02
    assert sorted((r.doc_id, r["copies"]) for r in mix_sources(d, t)[0].collect()) == sorted((r.doc_id, r["copies"]) for r in rows)
    empty, shares = mix_sources(d.limit(0), t)
    assert empty.count() == 0 and all(r.share == 0 for r in shares.collect())


def test_shares_reach_their_targets(spark):
    t = {r.source: r.target_share for r in spark.read.parquet(f"{DATA}/mix_targets.parquet").collect()}
    rows = queries.queries()["p9_shares"](spark, DATA).collect()
    reach = sum(t[r.source] for r in rows if r.documents)
    for r in rows:
        assert abs(r.share - (t[r.source] / reach if r.documents else 0)) < 0.02 and (not r.chosen or r["copies"] <= r.max_repeat * r.documents)
