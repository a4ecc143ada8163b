"""The corpus pipeline against plain Python of each stage, over the smallest tables."""

import corpus_pipeline
import pytest

from docketlens.llm import simhash

from .test_packing import check_pieces, tokenizer  # noqa: F401
from .test_pii import plain_base
from .test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Output of every stage by name."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def ids(frame):
    return {r["doc_id"] for r in frame.select("doc_id").collect()}


def test_columns_stay(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(stages[n].columns == stages["start"].columns for n in names[:-1])


def test_language_keeps_clean_documents(stages):
    assert len(ids(stages["language_id"])) >= 0.99 * stages["start"].count()


def test_one_of_each_group_stays(stages):
    import numpy as np

    rows = stages["language_id"].orderBy("doc_id").collect()
    codes = np.array([plain_fingerprint(r["text"]) for r in rows], dtype=np.uint64)
    assert ids(stages["simhash_near_dedup"]) == set(plain_components(codes, np.array([r["doc_id"] for r in rows])).tolist())


def test_leaks_go(stages, spark, sf):
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in stages["simhash_near_dedup"].collect()}
    leaked = {d for d, t in before.items() if any(i in t for i in items)}
    after = ids(stages["benchmark_decontamination"])
    assert not leaked & after and len(after) >= len(before) - 2 * len(leaked)


def test_personal_data_is_gone(stages):
    before = {r["doc_id"]: r["text"] for r in stages["benchmark_decontamination"].collect()}
    for r in stages["pii"].collect():
        base = plain_base(before[r["doc_id"]])
        assert (r["text"] == before[r["doc_id"]]) or "<" in r["text"]
        for _, a, z in base:
            assert before[r["doc_id"]][a:z] not in r["text"]
        assert r["n_chars"] == len(r["text"])


def test_packed_pieces(stages, tokenizer):  # noqa: F811
    docs = [(r["doc_id"], r["text"]) for r in stages["pii"].collect()]
    assert check_pieces(tokenizer, docs, stages["packing"].toPandas()) < 0.03


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages["packing"].count()
    assert corpus_pipeline.ORACLE_SQL is None
    assert simhash.MAX_BITS == 4


def test_edge_rows_pass_every_stage(spark, sf, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() >= 0


#: Names that the stages use for columns of their own.
OWN = ("row_id", "__row", "__lang", "__share", "_cuts", "_tail", "_size", "_chunks", "doc", "fp", "root", "u", "number")


def test_shuffled_rows_and_own_names(spark, stages):
    """Behind a shuffle, and with columns named like helpers, every stage gives the same rows unharmed."""
    from pyspark.sql import functions as F

    names = [n for n, _ in corpus_pipeline.STAGES]
    for before, (name, stage) in zip(["start", *names], corpus_pipeline.STAGES[:-1]):
        docs = stages[before].repartition(7, F.xxhash64("text"))
        for own in OWN:
            docs = docs.withColumn(own, F.concat(F.lit(own), F.col("doc_id")))
        found = stage(spark, docs, "/root/testdata/sf0.001")
        assert found.columns == docs.columns
        rows = found.collect()
        assert all(r[own] == f"{own}{r['doc_id']}" for r in rows for own in OWN)
        if name == "language_id":
            # The sample depends on the order of the rows, so a doubtful document may differ.
            assert len(rows) >= 0.99 * stages[name].count()
            continue
        columns = stages["start"].columns
        plain = lambda rows: sorted((tuple(r[c] for c in columns) for r in rows), key=repr)
        assert plain(rows) == plain(stages[name].collect())
