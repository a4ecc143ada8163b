import math
import random
import re
from collections import Counter

import pytest

from docketlens.llm import ranked_search

from ..compare import spark_rows, sql_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def plain_ranking(docs, items, k=10):
    counts = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, tokens = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for place, (doc_id, c) in enumerate(counts):
            m = 10 + (90 * c.total() * n_docs) // tokens
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(plain_terms(text)) if c[t]
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, place))
        for rank, (score, none, doc_id, _) in enumerate(sorted(scores)[:k], 1):
            out.append((None if none else doc_id, item_id, rank, -score))
    return sorted(out, key=repr)


def found(docs, items, **options):
    columns, rows = spark_rows(ranked_search.top_documents(docs, items, **options).drop("item_no"))
    assert columns == ["doc_id", "item_id", "rank", "score"]
    return rows


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["é1", "Ünï", "THE", "of"]
    pick = lambda n: " ".join(words[min(int(rng.expovariate(0.02)), len(words) - 1)] for _ in range(n))
    docs = [(i, pick(rng.choice([1, 5, 40, 200]))) for i in range(600)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # many equal scores
    items = [(i, pick(rng.choice([1, 3, 12]))) for i in range(150)] + [(3, "w1 w2"), (None, "the OF"), (200, "?!"), (201, None)]
    return docs, items


@pytest.mark.parametrize("vocabulary_bytes", [1 << 20, 0])
def test_against_plain_scores(spark, corpus, vocabulary_bytes):
    """With the items' terms broadcast, and beyond that bound."""
    docs, items = corpus
    got = found(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"), vocabulary_bytes=vocabulary_bytes,
    )
    assert got == plain_ranking(docs, items)


def test_fewer_documents_than_ranks(spark):
    docs, items = [(1, "a b"), (2, "b"), (None, "a"), (3, "c")], [(0, "a b"), (1, "zz"), (2, "c")]
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == plain_ranking(docs, items)


def test_edges(spark, edge_docs, no_docs):
    items = [(0, "The und 12"), (1, "mail x"), (2, None), (3, "")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    # Equal rows tie; their scores and ids agree with the plain ranking in any order.
    assert found(edge_docs, asked) == plain_ranking(rows, items)
    assert found(no_docs, asked) == []
    assert found(edge_docs, asked.limit(0)) == []


def test_query_against_sql(spark, sf):
    columns, rows = spark_rows(ranked_search.op13_ranked_search(spark, sf))
    assert rows == sql_rows(ranked_search.OP13_SQL, sf, columns)


def test_bound_holds():
    """No document of a term adds more than the bound from its greatest count and least length."""
    import numpy as np

    for most, shortest, docs, tokens in ((1, 1, 10, 100), (50, 60, 1000, 90_000), (7, 9, 3, 40)):
        norm = 10 + (90 * shortest * docs) // tokens
        bound = int(ranked_search.contributions(5, np.array([most]), np.array([norm]))[0])
        times, norms = np.arange(1, most + 1), 10 + (90 * np.arange(shortest, shortest + most) * docs) // tokens
        assert (ranked_search.contributions(5, times[:, None], norms[None, :]) <= bound).all()
