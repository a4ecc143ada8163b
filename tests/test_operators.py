"""Small cases of blocks, retrieval, graph, search and lifecycle operators."""

import pytest
from pyspark.sql import functions as F

from docketlens.operators import blocks, briefing, graph, lifecycle, retrieval, search
from docketlens.sources import texts


def one_document(spark, parts):
    """(kind, text, path) tuples as one document of blocks."""
    struct = "array<struct<kind:string,text:string,section_path:array<string>,table_row:int>>"
    rows = [("d", [(k, t, p, r) for k, t, p, r in parts])]
    return spark.createDataFrame(rows, f"document_id string, blocks {struct}")


def words(n, prefix="w"):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_large_then_chunk(spark):
    docs = one_document(spark, [("paragraph", words(180), ["s"], None)] * 5)
    packed = blocks.coalesce_blocks(docs)
    assert blocks.explode_blocks(packed).count() == 1
    counts = [r["token_count"] for r in blocks.build_chunks(packed).collect()]
    assert len(counts) == 2 and max(counts) <= 700


def test_boundaries(spark):
    docs = one_document(spark, [
        ("heading", "Title", ["a"], None), ("paragraph", words(20), ["a"], None),
        ("agreement", words(5), ["a"], None), ("paragraph", words(20), ["b"], None),
    ])
    rows = blocks.explode_blocks(blocks.coalesce_blocks(docs, blocks.BlockLimits(100, 150))).orderBy("block_index")
    assert [r["kind"] for r in rows.collect()] == ["paragraph", "agreement", "paragraph"]


def test_table_rows_keep_the_first_row(spark):
    docs = one_document(spark, [("table_row", words(4), ["t"], 10 + i) for i in range(8)])
    rows = blocks.explode_blocks(blocks.coalesce_blocks(docs, blocks.BlockLimits(20, 30))).orderBy("block_index").collect()
    assert {r["kind"] for r in rows} == {"table_row"} and rows[0]["table_row"] == 10 and "\n" in rows[0]["text"]


def test_runs_equal_whole_documents(spark):
    import random

    rng = random.Random(6)
    kinds = ["paragraph", "list_item", "heading", "table_row", "note"]
    parts = [(rng.choice(kinds), words(rng.choice([0, 3, 40, 300, 1500])), [rng.choice("ab")], None) for _ in range(120)]
    docs = one_document(spark, parts)
    want = blocks.explode_blocks(blocks.coalesce_blocks(docs)).select("block_index", "id", "kind", "text").collect()
    rows = docs.select("document_id", F.posexplode("blocks").alias("block_index", "b")).select("document_id", "block_index", "b.*")
    got = blocks.coalesce_rows(rows).select("block_index", "id", "kind", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20


def test_no_block_is_dropped(spark):
    docs = one_document(spark, [("paragraph", f"word{i}", ["s"], None) for i in range(3000)])
    made = blocks.build_chunks(blocks.coalesce_blocks(docs))
    assert made.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] == 3000


def test_folds_stand_once_in_the_plan(spark):
    docs = one_document(spark, [("paragraph", "a b", ["s"], None)])
    plan = blocks.build_chunks(blocks.coalesce_blocks(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("starts") <= 60 and plan.count("Generate") >= 5


def test_hidden_rows_do_not_count(spark):
    grid = spark.createDataFrame(
        [("d", 0, "List", 1, ["x"])] + [("d", 1, "Registration", i, ["p"]) for i in range(6)],
        "document_id string, sheet_no int, sheet string, row_no int, cells array<string>",
    )
    assert texts.explode_source_blocks(texts.sheet_blocks(grid)).count() == 1


def test_fusion_values_and_errors(spark):
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3)], "query_id int, id string, rank int")
    got = {r["id"]: r["score"] for r in retrieval.fused([(ranks, 1.0)]).collect()}
    assert got == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62)}
    with pytest.raises(ValueError):
        retrieval.fused([(ranks, 1.0)], 0)
    with pytest.raises(ValueError):
        retrieval.fused([(ranks, -1.0)])


def test_hybrid_score_with_authority(spark):
    chunks = spark.createDataFrame(
        [("c1", "carrier aggregation", [1.0, 0.0]), ("c2", "other", [0.0, 1.0])], "id string, text string, embedding array<double>"
    )
    queries = spark.createDataFrame([("q", "carrier aggregation", [1.0, 0.0])], "query_id string, query string, embedding array<double>")
    evidence = spark.createDataFrame([("c1", 1.2), ("c1", 0.5)], "id string, weight double")
    best = retrieval.hybrid(queries, chunks, 1, evidence).collect()
    assert best[0]["id"] == "c1" and best[0]["score"] == pytest.approx((1 / 61 + 1 / 61) * 1.2)


def test_hybrid_equals_full_ranking(spark, monkeypatch):
    import random

    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=4)), [rng.choice([-1.0, 0.0, 1.0]), rng.random()]) for i in range(300)]
    chunks = spark.createDataFrame(rows, "id long, text string, embedding array<double>")
    queries = spark.createDataFrame(
        [(q, " ".join(rng.choices(vocabulary, k=2)), [rng.random(), rng.random()]) for q in range(4)],
        "query_id long, query string, embedding array<double>",
    )
    evidence = spark.createDataFrame([(i, rng.choice([0.5, 1.0])) for i in range(0, 300, 2)], "id long, weight double")
    got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9))
           for r in retrieval.hybrid(queries, chunks, 5, evidence).collect()}
    lexical = retrieval.ranked(retrieval.lexical_scores(queries, chunks))
    near = retrieval.vector_scores(queries, chunks, 300)
    full = retrieval.ranked(retrieval.with_authority(retrieval.fused([(lexical, 1.0), (near, 1.0)]), evidence), 5)
    assert got == {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in full.collect()}
    monkeypatch.setattr(retrieval, "PASS_CANDIDATES", 800)
    blocked = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9))
               for r in retrieval.hybrid(queries, chunks, 5, evidence).collect()}
    assert blocked == got


def _plain_scores(queries, chunks):
    """Lexical scores in plain code."""
    import re

    tokens = lambda t: re.findall(r"[a-z0-9]+(?:[._/-][a-z0-9]+)*", t.lower())
    out = {}
    for q, query in queries:
        wanted = set(tokens(query))
        for i, body in chunks:
            own = tokens(body or "")
            hits = [min(own.count(t), 3) for t in wanted if t in own]
            held = bool(wanted) and query.strip().lower() in (body or "").lower() and (hits or len(wanted) <= 2)
            if hits or held:
                out[q, i] = round(sum(hits) + len(hits) / len(wanted) + bool(held), 9)
    return out


def test_lexical_scores_move_no_texts_and_keep_k(spark, monkeypatch):
    import random

    rng = random.Random(7)
    words = ["ab", "abc", "x-1", "the", "of", "Zed", "é"]
    queries = [(q, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for q in range(30)] + [(90, "é"), (91, "")]
    chunks = [(i, " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(200)] + [(900, None), (901, "xabcx")]
    asked = spark.createDataFrame(queries, "query_id int, query string")
    texts = spark.createDataFrame(chunks, "id long, text string").repartition(3)
    expected = _plain_scores(queries, chunks)
    for size, block_bytes in ((retrieval.SLICE, retrieval.PHRASE_BYTES), (40, 60)):
        monkeypatch.setattr(retrieval, "SLICE", size)
        scores = retrieval.lexical_scores(asked, texts, block_bytes=block_bytes)
        assert {(r["query_id"], r["id"]): round(r["score"], 9) for r in scores.collect()} == expected
        plan = retrieval.lexical_scores(asked, spark.read.schema("id long, text string").json("/dev/null"), 3)
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        best = retrieval.ranked(retrieval.lexical_scores(asked, texts, 3, block_bytes), 3)
        by_query = {}
        for (q, i), s in expected.items():
            by_query.setdefault(q, []).append((-s, i))
        want = {(q, n + 1): i for q, rows in by_query.items() for n, (_, i) in enumerate(sorted(rows)[:3])}
        assert {(r["query_id"], r["rank"]): r["id"] for r in best.collect()} == want


def test_fused_best_equals_whole_rankings(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(q, i, float(rng.randrange(6))) for q in range(3) for i in range(1500) if rng.random() < 0.8]
    scores = spark.createDataFrame(rows, "query_id long, id long, score double")
    by_id = scores.withColumn("score", F.lit(0.0))
    full = retrieval.ranked(retrieval.fused([(retrieval.ranked(scores), 1.0), (retrieval.ranked(by_id), 0.5)]), 10)
    want = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in full.collect()}
    for most in (retrieval.PASS_CANDIDATES, 300):
        monkeypatch.setattr(retrieval, "PASS_CANDIDATES", most)
        best = retrieval.fused_best([(scores, 1.0), (by_id, 0.5)], 10)
        assert {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in best.collect()} == want


def test_vector_scores_in_slices(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(400)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(2)
    queries = chunks.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    whole = [tuple(r) for r in retrieval.vector_scores(queries, chunks, 5).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(retrieval, "SLICE", 50)
    sliced = [tuple(r) for r in retrieval.vector_scores(queries, chunks, 5, 300).orderBy("query_id", "rank").collect()]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)) if norm(a) and norm(b) else 0.0
    want = [(q, i) for q, a in rows if q % 20 == 0 for _, i in sorted((-round(cosine(a, b), 9), i) for i, b in rows)[:5]]
    assert [r[:2] for r in whole] == [r[:2] for r in sliced] == want


def test_short_phrase_inside_a_longer_token(spark):
    chunks = spark.createDataFrame([(1, "xabcx"), (2, "zzz")], "id long, text string")
    queries = spark.createDataFrame([(1, "abc")], "query_id long, query string")
    assert [(r["id"], r["score"]) for r in retrieval.lexical_scores(queries, chunks).collect()] == [(1, 1.0)]


@pytest.mark.parametrize("search_text, want", [
    ("alpha beta", [1]), ("alpha or gamma", [1, 2]), ('"beta alpha"', []), ("alpha -beta", []), ('gamma "delta eps"', [2]),
])
def test_fulltext(spark, search_text, want):
    rows = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma delta eps")], "id int, text string")
    got = rows.filter(retrieval.matches_fulltext(F.col("text"), search_text)).orderBy("id").collect()
    assert [r["id"] for r in got] == want


def test_rerank_validation(spark):
    candidates = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("r", 1, "c")], "query_id string, position int, id string")
    scores = spark.createDataFrame([("q", 1, 0.1), ("q", 2, 0.9), ("r", 1, float("nan"))], "query_id string, position int, score double")
    got = {r["id"]: (r["valid"], r["rank"]) for r in retrieval.reranked(scores, candidates).collect()}
    assert got["b"] == (True, 1) and got["a"] == (True, 2) and got["c"][0] is False


def test_chains_with_cycle(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("o", "gone")]
    places = graph.chain_places(spark.createDataFrame(links, "id string, previous string"))
    got = {r["id"]: (r["root"], r["depth"], r["is_cyclic"]) for r in places.collect()}
    assert got["c"] == ("a", 3, False) and got["o"] == ("o", 1, False)
    assert all(got[i] == (None, None, True) for i in "xyz")


def test_longest_chain_over_meetings(spark):
    docs = spark.createDataFrame(
        [("R2-0", None, "M1"), ("R2-1", "R2-0", "M2"), ("R2-2", "R2-1", "M2"), ("R2-3", "R2-2", "M2"), ("R1-9", None, "M2"),
         ("R2-9", "R2-2", "M2")],
        "id string, revised_from string, meeting_id string",
    )
    path = [r["id"] for r in graph.longest_chain(docs).orderBy("position").collect()]
    assert path == ["R2-0", "R2-1", "R2-2", "R2-3"]
    assert tuple(graph.revision_stats(docs).first()) == (4, 1)


def test_scope_validation():
    with pytest.raises(ValueError):
        search.TemporalScope(last_k=3, last_months=2)
    with pytest.raises(ValueError):
        search.TemporalScope(starts="2024-02-01", ends="2024-01-01")


def test_active_version(spark):
    versions = spark.createDataFrame([("v1", False), ("v2", True)], "id string, is_active boolean")
    assert search.active_version(versions) == "v2" and search.active_version(versions, "v1") == "v1"
    with pytest.raises(ValueError):
        search.active_version(versions, "v9")


def test_report_choice(spark):
    rows = spark.createDataFrame([("m", "skeleton v20.docx"), ("m", "draft v9.docx"), ("m", "draft v10.docx")], "meeting_id string, filename string")
    assert lifecycle.chosen_report(rows, ["meeting_id"]).first()["filename"] == "draft v10.docx"


def test_archive_guards(spark):
    rows = spark.createDataFrame([("a/../b", False), ("ok.txt", False), ("x.docm", False), ("y", True)], "filename string, encrypted boolean")
    assert {r["filename"]: r["reason"] for r in lifecycle.guarded_members(rows).collect()} == {
        "a/../b": "path traversal", "ok.txt": None, "x.docm": "macros", "y": "encrypted"
    }


def test_compare_needs_two_meetings(spark):
    with pytest.raises(ValueError):
        briefing.compared(spark.createDataFrame([("a", "M")], "status string, meeting_id string"), ("M",))


def test_blocks_of_documents_are_packed_once(spark, sf):
    from docketlens.plans import dataset_queries

    found = dataset_queries.QUERIES["chunk_evidence"](spark, sf)
    assert "documents.parquet" not in found._jdf.queryExecution().toString()
    rows = spark.read.parquet(f"{sf}/documents.parquet").filter(F.trim(F.translate("text", "\n\t", "  ")) != "")
    assert sorted(r[0] for r in found.collect()) == sorted(str(r["doc_id"]) for r in rows.select("doc_id").collect())


def test_words_are_counted_once_per_block(spark):
    docs = one_document(spark, [("paragraph", None, ["s"], None), ("paragraph", " ", ["s"], None), ("paragraph", words(1200), ["s"], None)])
    packed = blocks.coalesce_blocks(docs)
    plan = blocks.build_chunks(packed)._jdf.queryExecution().optimizedPlan().toString()
    # A block, a window of a large block and a packed block; the tokens of a chunk's part count once more.
    assert plan.count("regexp_count") <= 4
    assert sum(len(r["text"].split()) for r in blocks.explode_blocks(packed).collect()) == 1200
