import zlib

from pyspark.sql import functions as F

from docketlens.llm import common, language


def test_held_out_accuracy(spark, documents):
    scorer = language.train(language.learnable(documents))
    found = language.identify(documents, scorer).filter(common.held_out(F.col("doc_id"))).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_held_out_flag(documents):
    rows = documents.select("doc_id", common.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_edges(edge_docs, no_docs):
    scorer = language.train(edge_docs)
    rows = language.identify(edge_docs, scorer).collect()
    assert len(rows) == edge_docs.count()
    by_text = {r["text"]: (r["lang_pred"], float(r["score"])) for r in rows}
    assert by_text[None] == by_text[""] == by_text["12 34 !!"] == ("und", 0.0)
    assert by_text["Der die das und nicht. " * 20][0] == "de"
    assert language.identify(no_docs, scorer).count() == 0
    empty = language.train(no_docs)
    assert {r["lang_pred"] for r in language.identify(edge_docs, empty).collect()} == {"und"}


def test_long_text_is_scored_whole(spark, documents):
    scorer = language.train(language.learnable(documents))
    texts = {lang: documents.filter(F.col("lang") == lang).first()["text"] for lang in ("en", "de")}
    scorer_runs = common.RUN_CHARS
    try:
        common.RUN_CHARS = 997
        cut = scorer.log_odds([texts["en"] * 5, None, texts["de"]])
    finally:
        common.RUN_CHARS = scorer_runs
    whole = scorer.log_odds([texts["en"] * 5, None, texts["de"]])
    assert abs(cut - whole).max() < 1e-6 * abs(whole).max()


def test_filter_keeps_clean_documents(documents, edge_docs, no_docs):
    kept = language.identified(documents)
    assert kept.columns == documents.columns and kept.count() >= 0.99 * documents.count()
    left = {r["text"] for r in language.identified(edge_docs).collect()}
    assert None not in left and "12 34 !!" not in left and "Der die das und nicht. " * 20 in left
    assert language.identified(no_docs).count() == 0
