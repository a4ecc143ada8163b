"""Phrases inside texts against plain containment; the plans have no nested loop."""

import random

from pyspark.sql import functions as F

from docketlens.operators import retrieval, substrings


def test_against_containment(spark):
    rng = random.Random(3)
    pick = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(i, pick(rng.randrange(30))) for i in range(120)] + [(900, None), (901, "")]
    phrases = [(i, pick(rng.randrange(5))) for i in range(80)] + [(500, None), (501, ""), (1, "ab")]
    expected = sorted({(q, i) for q, p in phrases for i, t in texts if p and t and p in t})
    rows = spark.createDataFrame(texts, "id int, text string").repartition(3)
    asked = spark.createDataFrame(phrases, "query_id int, phrase string")
    for block_bytes in (substrings.BLOCK_BYTES, 20):
        found = substrings.contained(rows, asked, block_bytes)
        assert sorted((r["query_id"], r["id"]) for r in found.collect()) == expected
    assert substrings.contained(rows, asked.limit(0)).count() == 0
    assert substrings.contained(rows.limit(0), asked).count() == 0


def test_no_nested_loop(spark):
    queries = spark.createDataFrame([(1, "ab"), (2, "long phrase of words")], "query_id int, query string")
    chunks = spark.createDataFrame([(1, "cab"), (2, "a long phrase of words")], "id int, text string")
    scores = retrieval.lexical_scores(queries, chunks)
    plan = scores._jdf.queryExecution().optimizedPlan().toString() + scores._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert {(r["query_id"], r["id"]) for r in scores.filter(F.col("score") >= 1).collect()} == {(1, 1), (2, 2)}


def test_counts_meet_each_class_of_queries_once(spark, monkeypatch):
    # A thousand queries ask for the same two phrases, one of them for both.
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["ab x", "cd", "ab cd", "", None])], "id int, text string")
    asked = [(i, ("ab", "cd")[i % 2]) for i in range(1000)] + [(0, "cd"), (2000, "zz"), (2001, ""), (2002, None)]
    phrases = spark.createDataFrame(asked, "query_id int, phrase string")
    met = []
    whole = substrings.contained
    monkeypatch.setattr(substrings, "contained", lambda t, p, b: (met.append(p.count()), whole(t, p, b))[1])
    got = {r["query_id"]: r["n"] for r in substrings.counted(texts, phrases).collect()}
    assert got == {i: 2 for i in range(1, 1000)} | {0: 3}
    assert met == [5]
