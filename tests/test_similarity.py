import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlink.functions import similarity as sim


def _one(spark, a, b, f):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("o")).first()[0]


def test_jaro_winkler_against_duckdb():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14)))
    pairs = [(word(), word()) for _ in range(3000)]
    con = duckdb.connect()
    con.execute("create table t (i int, a varchar, b varchar)")
    con.executemany("insert into t values (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    want = [r[0] for r in con.execute("select case when a = b then 1 else jaro_winkler_similarity(a, b) end from t order by i").fetchall()]
    got = sim.jaro_winkler_values([a for a, _ in pairs], [b for _, b in pairs])
    assert max(abs(x - y) for x, y in zip(got, want)) < 1e-12


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.text(max_size=30), st.text(max_size=30)), max_size=12))
def test_jaro_winkler_properties(pairs):
    pairs = [(a.replace("\0", ""), b.replace("\0", "")) for a, b in pairs]
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    got = sim.jaro_winkler_values(a, b)
    for x, y, v in zip(a, b, got):
        assert 0 <= v <= 1
        if not x or not y:
            assert v == 0
        elif x == y:
            assert v == 1


def test_jaro_winkler_known_values():
    a, b = ["MARTHA", "DIXON", "", "abc", "société"], ["MARHTA", "DICKSONX", "x", "abc", "societe"]
    got = sim.jaro_winkler_values(a, b)
    assert [round(x, 4) for x in got] == [0.9611, 0.8133, 0.0, 1.0, 0.8857]
    assert sim.jaro_winkler_values(["ab"], ["ac"], gated=False)[0] > sim.jaro_winkler_values(["ab"], ["ac"])[0]


def test_edge_values(spark):
    assert _one(spark, "", "", sim.levenshtein_norm) == 1.0
    assert _one(spark, "a", "", sim.levenshtein_norm) == 0.0
    assert _one(spark, "é", "e", sim.levenshtein_norm) == 0.0
    assert _one(spark, "", "", sim.length_ratio) == 1.0
    assert _one(spark, "ab", "abcd", sim.length_ratio) == 0.5
    tok = lambda a, b: sim.jaccard(sim.tokens(a), sim.tokens(b))
    assert _one(spark, "", "", tok) == 1.0
    assert _one(spark, "a", "", tok) == 0.0
    assert _one(spark, "a b b", "b c", tok) == pytest.approx(1 / 3)
    assert _one(spark, "a", "a", lambda a, b: sim.bigrams(a)) == ["a"]
    assert _one(spark, "", "a", lambda a, b: sim.bigrams(a)) == []


def test_composite_is_weighted(spark):
    got = _one(spark, "x", "y", lambda a, b: sim.composite(F.lit(1.0), F.lit(0.5), F.lit(0.0)))
    assert got == pytest.approx(0.4 + 0.15)
    assert _one(spark, "x", "y", lambda a, b: sim.composite(F.lit(1.0), F.lit(1.0), F.lit(1.0), sim.Weights(jaro_winkler=0, levenshtein=0, token=0))) == 0.0
