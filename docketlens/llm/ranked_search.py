"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners by how common they are. Documents are cut into shards of at most
``SHARD_DOCS`` documents, items into bundles of at most ``BUNDLE_ITEMS``. A bundle visits the owners one
after the other, the rarest terms first: each visit is a cogroup by (bundle, shard) of the bundle, which
carries a sparse accumulator of document scores for each of its items, with the owner's postings of that
shard. The owner adds its integer contributions. Before the bundle moves on, documents go whose score
cannot reach the best ``k`` any more: ``k`` documents of the same shard already have more than its score
plus the most that all later owners can add. That bound is exact, so the result is. The best ``k`` of
each shard meet in one final selection.

The scan of the documents writes compact postings per shard and term. They are restricted to terms of the
items by a broadcast set while that set is within ``vocabulary_bytes``; beyond, all terms are written and
the join with the items' terms restricts them.

A task holds one (bundle, shard) pair: its scores are a matrix of bounded size. No document meets an item
outside of it, and nothing but counts (documents, terms) reaches the driver.

Null texts, and texts without a term, have no terms and are never found. Null ids come behind all other
ids among equal scores; rows that share an id are documents of their own. Repeated items are ranked one by
one. Items without terms, an empty corpus or an empty benchmark give no rows. Further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, map_in_arrow, ship_package
from . import common

TOP = 10
SHARD_DOCS = 4096
#: A shard also ends after so many postings.
SHARD_POSTINGS = 1_000_000
#: Items share a bundle if their numbers agree above so many bits.
BUNDLE_BITS = 7
VOCABULARY_BYTES = 64 << 20
#: Owner 0 has the terms in at most this share of the documents, owner 1 up to the next share and so on.
OWNER_SHARES = (1 / 256, 1 / 32, 1 / 8)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are no letter or digit separate terms; everything beyond ASCII belongs to one.
_TABLE = bytes(
    b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _string(term: bytes) -> str:
    return term.decode("utf-8", "replace")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[_string(t) for t in dict.fromkeys(terms(text))] for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_no"), batch.column("item_id"), pa.array(found, pa.list_(pa.string()))],
            names=["item_no", "item_id", "terms"],
        )


def numbered_items(items: DataFrame) -> DataFrame:
    """``(item_id, text)`` to ``item_no, item_id, terms``, written once."""
    rows = items.select(F.monotonically_increasing_id().alias("item_no"), "item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    return cut_lineage(rows.transform(map_in_arrow, _item_terms, f"item_no long, item_id {kind}, terms array<string>"))


class _Shard:
    """Postings of a run of documents, by term."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.lists: dict[bytes, tuple[list[int], list[int]]] = {}
        self.postings = 0

    def add(self, doc_id, counts: Counter, wanted: frozenset | None, length: int) -> None:
        at = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(length)
        chosen = counts.keys() if wanted is None else counts.keys() & wanted
        for term in chosen:
            places, times = self.lists.setdefault(term, ([], []))
            places.append(at)
            times.append(counts[term])
        self.postings += len(chosen)

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        lengths = np.array(self.lengths, dtype="<i8")
        rows = [(shard, None, b"", lengths.tobytes(), self.ids, len(lengths), int(lengths.sum()), 0, 0)]
        for term, (places, times) in self.lists.items():
            at, tf = np.array(places, dtype="<i4"), np.array(times, dtype="<i4")
            rows.append((shard, _string(term), at.tobytes(), tf.tobytes(), None, len(at), 0,
                         int(tf.max()), int(lengths[at].min())))
            if len(rows) == 1000:
                yield self._batch(rows)
                rows = []
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 4]
        names = ["shard", "term", "places", "times", "ids", "docs", "tokens", "most", "shortest"]
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def postings(docs: DataFrame, vocabulary: DataFrame, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """Per shard a head row (``term`` null, with ids and lengths) and one row per term.

    ``docs``: number of documents of the row; ``most``: greatest number of times in one of them;
    ``shortest``: length of the shortest of them.
    """
    spark = docs.sparkSession
    size = vocabulary.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    wanted = None
    if size <= vocabulary_bytes:
        wanted = spark.sparkContext.broadcast(frozenset(r["term"].encode() for r in vocabulary.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if wanted is None else wanted.value
        number = TaskContext.get().partitionId() << 24
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                counts = Counter(terms(text.as_py()))
                if not counts:
                    continue
                shard.add(doc_id, counts, only, counts.total())
                if len(shard.ids) == SHARD_DOCS or shard.postings >= SHARD_POSTINGS:
                    yield from shard.batches(number)
                    shard, number = _Shard(), number + 1
        if shard.ids:
            yield from shard.batches(number)

    schema = ("shard long, term string, places binary, times binary, ids array<long>, docs long, tokens long, "
              "most long, shortest long")
    return cut_lineage(docs.select(F.col("doc_id").cast("long"), "text").transform(map_in_arrow, run, schema))


def owned(stored: DataFrame, vocabulary: DataFrame, docs: int, tokens: int) -> DataFrame:
    """``term, weight, owner, bound`` of the items' terms that occur.

    ``bound`` is the most that the term can add to one document: the contribution grows with the count and
    falls with the length, so greatest count and least length bound it.
    """
    found = stored.filter("term is not null").join(vocabulary, "term", "left_semi").groupBy("term").agg(
        F.sum("docs").alias("df"), F.max("most").alias("most"), F.min("shortest").alias("shortest")
    )
    n, total = F.lit(docs).cast("long"), F.lit(max(1, tokens)).cast("long")
    weight = F.floor(
        F.lit(1000.0) * F.ln((2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))
    ).cast("long")
    owner = sum((F.col("df") > share * docs).cast("int") for share in OWNER_SHARES)
    return found.withColumn("length_part", F.expr("90L * shortest") * n).select(
        "term", weight.alias("weight"), owner.alias("owner"),
        (weight * F.call_function(
            "div", F.lit(1_000_000_000) * F.col("most"),
            F.lit(1000) * F.col("most") + 8 * (F.lit(10) + F.call_function("div", F.col("length_part"), total)),
        )).alias("bound"),
    )


def _state(bundle: int, shard: int, rows: list[tuple]) -> pa.Table:
    """Rows ``(item_no, rest, places, scores, ids, lengths)`` of one bundle in one shard."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
    names = ["item_no", "rest", "places", "scores", "ids", "lengths"]
    columns = list(zip(*rows, strict=True))
    return pa.Table.from_arrays(
        [pa.array([bundle] * len(rows), pa.int64()), pa.array([shard] * len(rows), pa.int64()),
         *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
        names=["bundle", "shard", *names],
    )


STATE = ("bundle long, shard long, item_no long, rest array<long>, places binary, scores binary, "
         "ids array<long>, lengths binary")
FOUND = "item_no long, doc_id long, score long, shard long, place long"


def contributions(weight: int, times: np.ndarray, norms: np.ndarray) -> np.ndarray:
    times = times.astype(np.int64)
    return weight * ((1_000_000_000 * times) // (1000 * times + 8 * norms))


def _visit(owner: int, docs: int, tokens: int, k: int, last: bool):
    """The visit of one bundle at one owner, for the documents of one shard."""

    def run(carried: pa.Table, offered: pa.Table) -> pa.Table:
        rows = carried.to_pylist()
        head = next(r for r in rows if r["item_no"] is None)
        items = [r for r in rows if r["item_no"] is not None]
        lengths = np.frombuffer(head["lengths"], dtype="<i8")
        norms = 10 + (90 * lengths * docs) // tokens
        line = {r["item_no"]: i for i, r in enumerate(items)}
        scores = np.zeros((len(items), len(lengths)), dtype=np.int64)
        for i, r in enumerate(items):
            scores[i, np.frombuffer(r["places"], dtype="<i4")] = np.frombuffer(r["scores"], dtype="<i8")
        for r in offered.to_pylist():
            at = np.frombuffer(r["places"], dtype="<i4")
            added = contributions(r["weight"], np.frombuffer(r["times"], dtype="<i4"), norms[at])
            lines = np.array([line[n] for n in r["items"]])
            scores[np.ix_(lines, at)] += added
        out = []
        for i, r in enumerate(items):
            own = scores[i]
            least = np.partition(own, -k)[-k] if len(own) > k else 0
            at = np.flatnonzero((own > 0) & (own + r["rest"][owner] >= least))
            if last:
                ids = [(-int(own[p]), head["ids"][p] is None, head["ids"][p] or 0, int(p)) for p in at]
                out += [(r["item_no"], head["ids"][p], -s, head["shard"], p) for s, _, _, p in sorted(ids)[:k]]
            else:
                out.append((r["item_no"], r["rest"], at.astype("<i4").tobytes(), own[at].astype("<i8").tobytes(),
                            None, None))
        if last:
            names = ["item_no", "doc_id", "score", "shard", "place"]
            columns = zip(*out, strict=True) if out else [[]] * 5
            return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
        return _state(head["bundle"], head["shard"], [(None, None, None, None, head["ids"], head["lengths"]), *out])

    return run


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP,
                  vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """The ``k`` best documents of every item: ``item_no, item_id, rank, doc_id, score``."""
    ship_package(docs.sparkSession)
    asked = numbered_items(items)
    of_items = asked.select("item_no", F.shiftright("item_no", BUNDLE_BITS).alias("bundle"), F.explode("terms").alias("term"))
    vocabulary = of_items.select("term").distinct()
    stored = postings(docs, vocabulary, vocabulary_bytes)
    totals = stored.filter("term is null").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
    count, tokens = totals["docs"] or 0, totals["tokens"] or 1
    wanted = cut_lineage(of_items.join(owned(stored, vocabulary, count, tokens), "term"))
    owners = range(len(OWNER_SHARES) + 1)
    rest = wanted.groupBy("bundle", "item_no").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("owner") > o, F.col("bound"))), F.lit(0)) for o in owners
    ]).alias("rest"))
    by_bundle = cut_lineage(wanted.groupBy("bundle", "term", "owner", "weight").agg(F.collect_list("item_no").alias("items")))
    lists = stored.filter("term is not null").select("shard", "term", "places", "times")
    # A bundle visits the shards that have one of its terms.
    visits = lists.join(by_bundle, "term").select("bundle", "shard").distinct()
    heads = stored.filter("term is null").select("shard", "ids", F.col("times").alias("lengths"))
    empty = F.lit(b"")
    state = cut_lineage(
        visits.join(heads, "shard").select(
            "bundle", "shard", F.lit(None).cast("long").alias("item_no"),
            F.lit(None).cast("array<long>").alias("rest"), F.lit(None).cast("binary").alias("places"),
            F.lit(None).cast("binary").alias("scores"), "ids", "lengths",
        ).unionByName(visits.join(rest, "bundle").select(
            "bundle", "shard", "item_no", "rest", empty.alias("places"), empty.alias("scores"),
            F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("lengths"),
        ))
    )
    for owner in owners:
        last = owner == owners[-1]
        offered = lists.join(by_bundle.filter(F.col("owner") == owner), "term").select(
            # New names' ids, as both sides of the cogroup come from the same tables.
            *[F.col(c).alias(c) for c in ("bundle", "shard", "weight", "items", "places", "times")]
        )
        visited = state.groupBy("bundle", "shard").cogroup(offered.groupBy("bundle", "shard")).applyInArrow(
            _visit(owner, count, tokens, k, last), FOUND if last else STATE
        )
        state = cut_lineage(visited)
    order = W.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "place")
    best = state.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asked.select("item_no", "item_id"), "item_no").select("item_no", "item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.drop("item_no")


def _sql_terms(table: str, key: str) -> str:
    return f"""SELECT r, {key}, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, {key}, text FROM {table})"""


OP13_SQL = f"""WITH tf AS (SELECT r, doc_id, term, count(*) AS tf FROM ({_sql_terms('documents', 'doc_id')}) GROUP BY 1, 2, 3),
asked AS (SELECT DISTINCT r AS i, item_id, term FROM ({_sql_terms('benchmark', 'item_id')})),
lens AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM lens),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), totals),
scored AS (SELECT i, item_id, tf.r, doc_id,
  CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // tokens)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lens ON lens.r = tf.r, totals GROUP BY 1, 2, 3, 4)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *,
  row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""
