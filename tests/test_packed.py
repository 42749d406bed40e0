import csv
import json

from hypothesis import given, settings, strategies as st

from lexiloom.operators.packed import explode_packed

CASES = {
    "  a ;  b's ": ["a", "b's"], '"x, y";"z z";w': ["x, y", "z z", "w"], '"hope, ""real"" hope";s': ['hope, "real" hope', "s"], '["hope, \\"real\\" hope","e"]': ['hope, "real" hope', "e"],
    "['a b', 'hope, \"real\" hope']": ["a b", 'hope, "real" hope'], "#a b, #c": ["a b", "c"], "#A#b": ["A", "b"], "#T #U": ["T", "U"], "a / b/c": ["a", "b/c"], "a|b; c, d": ["a", "b", "c", "d"],
    " ": [], "": [], ", k,,s,,no.s,": ["k", "s", "no.s"], "a\tb\r\nc": ["a", "b", "c"], "R&D | x": ["R&D", "x"], "[\"crohn's\", 'y']": ["crohn's", "y"], "a，b、c": ["a", "b", "c"], "x": ["x"], "[]": [], "#": [],
}


def values(df):
    out = {}
    for r in df.orderBy("id", "pos").collect():
        out.setdefault(r.id, []).append((r.pos, r.val))
    return out


def test_notations(spark):
    texts = list(CASES)
    got = values(explode_packed(spark.createDataFrame(list(enumerate(texts)), "id int, f string"), ["id"], "f"))
    for i, t in enumerate(texts):
        assert got.get(i, []) == list(enumerate(CASES[t], 1)), t


def test_edges(spark):
    long = ",".join(f"t{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, None, "x"), (2, long, "x"), (2, long, "y"), (None, "a,b", "x")], "id int, f string, val string")
    got = values(explode_packed(df, ["id"], "f"))
    assert 1 not in got and len(got[2]) == 20_000 and [v for _, v in got[None]] == ["a", "b"]
    assert explode_packed(df.limit(0), ["id"], "f").count() == 0


TAGS = st.lists(st.text("abc XY&.,;\"'", min_size=1, max_size=8).map(str.strip).filter(lambda s: s and not set(s) <= set("\"'") and not s.startswith(("'", '"')) and not s.endswith(("'", '"'))), min_size=1, max_size=5)


@settings(max_examples=25, deadline=None)
@given(st.lists(TAGS, min_size=1, max_size=10))
def test_round_trip(spark, lists):
    import io

    rows, want = [], {}
    for i, tags in enumerate(lists):
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(tags)
        for k, packed in enumerate((out.getvalue(), json.dumps(tags))):
            rows.append((2 * i + k, packed))
            want[2 * i + k] = list(enumerate(tags, 1))
    assert values(explode_packed(spark.createDataFrame(rows, "id int, f string"), ["id"], "f")) == want
