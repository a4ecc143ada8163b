"""Which texts contain which phrases, for batches of phrases and whole tables of texts.

All phrases of a block become one automaton, so a task reads each of its texts once however many phrases
there are. A block holds at most ``block_bytes`` of phrases; more phrases are searched in further passes.
Texts are not shuffled: only the found pairs leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow

BLOCK_BYTES = 2 << 20


def contained(texts: DataFrame, phrases: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, text)`` and ``(query_id, phrase)`` to distinct ``(query_id, id)`` where the text holds the phrase.

    The comparison is exact, so callers lower-case both sides if case is to be ignored. Null texts hold
    nothing; null and empty phrases are found nowhere.
    """
    wanted = phrases.filter(F.length("phrase") > 0).select("query_id", "phrase").distinct()
    distinct = wanted.select("phrase").distinct()
    total = distinct.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found = [
        _block(texts, distinct.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)) for b in range(blocks)
    ]
    return reduce(DataFrame.unionByName, found).join(wanted, "phrase").select("query_id", "id").distinct()


def counted(texts: DataFrame, phrases: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, n``: the number of distinct ids whose text holds a phrase of the query, where there is any.

    Queries with the same phrases are one class: only its least query meets the texts, and the others get its count.
    """
    sets = phrases.filter(F.length("phrase") > 0).groupBy("query_id").agg(F.sort_array(F.collect_set("phrase")).alias("phrases"))
    classes = sets.groupBy("phrases").agg(F.min("query_id").alias("least"))
    asked = classes.select(F.col("least").alias("query_id"), F.explode("phrases").alias("phrase"))
    counts = contained(texts, asked, block_bytes).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    of_class = classes.join(counts.withColumnRenamed("query_id", "least"), "least").select("phrases", "n")
    return sets.join(of_class, "phrases").select("query_id", "n")


def _block(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast([r["phrase"] for r in phrases.collect()])
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words = shared.value
        if not words:
            return
        automaton = ahocorasick.Automaton()
        for number, word in enumerate(words):
            automaton.add_word(word, number)
        automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for at, text in enumerate(batch.column("text")):
                own = {number for _, number in automaton.iter(text.as_py() or "")}
                rows += [at] * len(own)
                hits += [words[number] for number in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], names=["id", "phrase"]
            )

    return texts.select("id", "text").transform(map_in_arrow, run, f"id {kind}, phrase string")
