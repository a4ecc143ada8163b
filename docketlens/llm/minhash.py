"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

A document's set are its distinct 4-word shingles, as 64-bit hashes. Each distinct set is handled once, so
exact copies cost one row. ``HASHES`` minima per set form bands of ``BAND_ROWS``, whose hashes are bucket keys;
sets that share a bucket are candidates. A signature keeps only ``BITS`` bits of the least hash in each of
``BINS`` ranges of hash values, and none for a range without a hash. Equal places are counted by XOR and bit counts, places
that are equal by chance are corrected for (``similarity``), and pairs below a cut go. The cut and the number of
bands are such that a pair at the limit is lost with a probability below 1e-8 (``MISS`` for the cut). Pairs that
pass are confirmed by intersecting the full sets.

No bucket gives its pairs. First every set of a bucket meets one pivot. Later rounds look only at buckets
that still hold sets of several components, and there only at pairs of different components: each set that
is not in the pivot's component is compared with the others by its signature and sends its best partners,
more in each round, until none is held back. Components only grow, so a set that sent all its partners in a bucket need
not ask there again. Of several shared buckets the first one sends a pair. Then every candidate pair between different components has
been tested, so no link between different components is lost, while links inside one are not needed.
Large buckets are cut into tiles, so a task holds two blocks of signatures.

The limits are parameters. Null, empty and blank texts have an empty set, are linked with nothing and are
their own component. With fewer than four words the whole sequence is the one shingle. A null ``doc_id``
takes part but never names a component unless nothing else is in it (then the component is null, and the
row is kept); equal ids stay rows of their own. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, map_in_arrow
from . import common
from .components import connected_components, with_least

SEED = 42
SHINGLE_WORDS = 4
#: Link if 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 80
BAND_ROWS = 4
BANDS = 40
HASHES = BANDS * BAND_ROWS
BITS = 4
BINS = 1024
#: Probability that the bit count loses a pair that is exactly at the limit.
MISS = 1e-9
#: Shingles whose minima are taken at a time.
BLOCK_SHINGLES = 8192
#: Sets per side of a tile, and signature comparisons at a time.
TILE = 1024
RUN_PAIRS = 1 << 16
#: Partners of a set in the first round of a bucket; each further round allows 8 times as many.
PARTNERS = 4
#: Rows of one partition in tables of sets and of links, so that small ones do not become many tiny files.
PART_SETS = 10_000
PART_LINKS = 25_000
#: Keys up to which a list of texts is broadcast; a longer one is joined by a shuffle.
BROADCAST_KEYS = 2_000_000

_random = np.random.RandomState(SEED)
_FACTORS = _random.randint(0, 2**63, HASHES, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _random.randint(0, 2**63, BAND_ROWS + 1, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_NIBBLES = np.uint64(0x1111111111111111)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    k = min(SHINGLE_WORDS, len(words))
    first = [0, *ends[: len(words) - k].tolist()]
    last = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    found = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=len(first)
    )
    return np.unique(found)


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes()), dtype="<i8")
    return int(both[0]), int(both[1])


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """``HASHES`` x sets minima; of an empty set the greatest value."""
    out = np.full((HASHES, len(sets)), np.uint64(0xFFFFFFFFFFFFFFFF))
    pieces: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        values = np.concatenate([p for _, p in pieces])
        starts = np.cumsum([0, *[len(p) for _, p in pieces[:-1]]])
        least = np.minimum.reduceat(_FACTORS[:, None] * values[None, :], starts, axis=1)
        own = np.array([i for i, _ in pieces])
        # A set has one piece in a block, so no column is written twice.
        out[:, own] = np.minimum(out[:, own], least)

    for i, hashes in enumerate(sets):
        for at in range(0, len(hashes), BLOCK_SHINGLES):
            piece = hashes[at : at + BLOCK_SHINGLES]
            if held and held + len(piece) > BLOCK_SHINGLES:
                flush()
                pieces, held = [], 0
            pieces.append((i, piece))
            held += len(piece)
    if pieces:
        flush()
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """Sets x ``BANDS`` bucket keys; the number of the band is part of the key."""
    rows = least.reshape(BANDS, BAND_ROWS, -1)
    keys = np.arange(BANDS, dtype=np.uint64)[:, None] * _MIX[-1]
    for r in range(BAND_ROWS):
        keys = (keys ^ rows[:, r]) * _MIX[r]
        keys ^= keys >> np.uint64(29)
    return keys.T.view(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Sets x packed bytes: ``BITS`` bits, 1 and above, of the least hash of each bin; 0 for an empty bin."""
    codes = np.zeros((len(sets), BINS), dtype=np.uint8)
    for row, hashes in zip(codes, sets, strict=True):
        if len(hashes):
            bins = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])  # the hashes are sorted
            row[bins[first]] = 1 + (hashes[first] >> np.uint64(20)) % np.uint64(2**BITS - 1)
    return codes[:, ::2] | codes[:, 1::2] << BITS


def _filled(words: np.ndarray) -> np.ndarray:
    """How many places of packed words are not 0; overwrites the words."""
    words |= words >> np.uint64(1)
    words |= words >> np.uint64(2)
    words &= _NIBBLES
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


def equal_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where both signatures have the same bits, and places where at least one has any."""
    either = _filled(a | b)
    return either - _filled(a ^ b), either


def similarity(equal: np.ndarray | float, either: np.ndarray | float) -> np.ndarray | float:
    """Similarity from equal places, corrected for bits that are equal by chance."""
    chance = 1 / (2.0**BITS - 1)
    return (equal / np.maximum(either, 1) - chance) / (1 - chance)


def is_near(equal: np.ndarray, either: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether signatures allow the limit; ``sizes``: the sum of both sets' sizes.

    A place differs only through a hash that one set lacks, and at the limit those are few: that bound is exact
    and the sharper one for small sets. For large ones the count of equal places is.
    """
    apart = sizes * (100 - percent) // (100 + percent)
    return (equal >= least_equal(percent)[either]) & (either - equal <= apart)


@lru_cache
def least_equal(percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """For each number of filled places the equal ones that a pair at the limit falls below with
    probability ``miss`` at most. Chance only adds equal places, so it is left out here."""
    p, found = percent / 100, []
    for n in range(BINS + 1):
        below, equal = 0.0, 0
        while equal < n:
            ways = lgamma(n + 1) - lgamma(equal + 1) - lgamma(n - equal + 1)
            below += exp(ways + equal * log(p) + (n - equal) * log(1 - p)) if p < 1 else 0.0
            if below > miss:
                break
            equal += 1
        found.append(equal)
    return np.array(found)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        lengths = [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()]
        for begin, end in common.runs_of(lengths):
            sets = [shingle_hashes(t) for t in texts.slice(begin, end - begin).to_pylist()]
            least = minima(sets)
            digests = [set_digest(s) for s in sets]
            keys = band_keys(least)
            marks = (keys & 0xFFFFFFFF).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(begin, end - begin), batch.column("text_key").slice(begin, end - begin),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()),
                 pa.array([d[1] for d in digests], pa.int64()),
                 pa.array([s.tobytes() for s in signatures(sets)], pa.binary()),
                 pa.array(list(keys), pa.list_(pa.int64())), pa.array([k.tobytes() for k in marks], pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "hi", "lo", "signature", "bands", "marks"],
            )


def described(docs: DataFrame) -> DataFrame:
    """Every row's set: size, 128-bit digest, packed signature, bucket keys and their lower halves (``marks``)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return rows.transform(
        map_in_arrow, _described,
        "doc_id long, text_key long, n_shingles long, hi long, lo long, signature binary, bands array<long>, marks binary",
    )


def distinct_sets(rows: DataFrame) -> DataFrame:
    """One row per distinct set that is not empty, with a number ``node``, written once."""
    found = cut_lineage(
        rows.filter("n_shingles > 0").groupBy("hi", "lo").agg(
            F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"),
            F.min("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"), F.first("marks").alias("marks"),
        ).withColumn("node", F.monotonically_increasing_id())
    )
    return found.coalesce(_parts(found, PART_SETS))


def _parts(rows: DataFrame, size: int) -> int:
    return max(1, -(-rows.count() // size))


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """``key, node, pivot, size`` of every bucket that several sets share."""
    banded = nodes.select("node", F.explode("bands").alias("key"))
    pivots = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size"))
    found = cut_lineage(banded.join(pivots.filter("size > 1"), "key"))
    return found.coalesce(_parts(found, PART_LINKS))


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _words(column: pa.Array, kind: str = "<u8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def near_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` pairs whose sizes and signatures allow the limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal, either = equal_places(_words(batch.column("sig_a")), _words(batch.column("sig_b")))
                near = pa.array(is_near(equal, either, batch.column("sizes").to_numpy(), percent))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], names=["a", "b"])

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("signature").alias(f"sig_{name}"))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        _similar_sizes(F.col("n_a"), F.col("n_b"), percent)
    )
    return joined.select("a", "b", "sig_a", "sig_b", (F.col("n_a") + F.col("n_b")).alias("sizes")).transform(map_in_arrow, run, "a long, b long")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of one tile after the other, from rows sorted by tile."""
    names = ("key", "tile", "asks", "node", "root", "n")
    held: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        columns += [_words(batch.column("signature")), _words(batch.column("marks"), "<u4")]
        change = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
        if held and (held[-1][0][-1] != columns[0][0] or held[-1][1][-1] != columns[1][0]):
            yield joined()
            held = []
        at = 0
        for end in change:
            held.append([c[at:end] for c in columns])
            yield joined()
            held, at = [], end
        held.append([c[at:] for c in columns])
    if held:
        yield joined()


def cross_pairs(buckets: DataFrame, nodes: DataFrame, roots: DataFrame, partners: int, percent: int,
                tile: int = TILE, held: DataFrame | None = None) -> DataFrame:
    """Candidate pairs ``(a, b)`` of different components that share a bucket, with its ``key`` and the set that ``asked``.

    Each set outside of its bucket's pivot component sends its ``partners`` best candidates of a tile;
    ``more`` says that it held others back. ``roots``: ``node, root`` of sets that are not their own root. With
    ``held`` only these ``key, node`` ask: those that held candidates back before.
    """
    if held is not None:
        buckets = buckets.join(held.select("key").distinct(), "key", "left_semi").join(
            held.withColumn("held", F.lit(True)), ["key", "node"], "left"
        )
    labelled = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    pivots = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    labelled = labelled.join(pivots, "pivot", "left").withColumn("pivot_root", F.coalesce("pivot_root", "pivot"))
    asking = F.col("root") != F.col("pivot_root")
    if held is not None:
        asking = asking & F.col("held").isNotNull()
    mixed = labelled.groupBy("key").agg(F.count_if(asking).alias("outside")).filter("outside > 0")
    split = F.ceil(F.col("size") / tile).cast("int")
    blocks = F.sequence(F.lit(0), split - 1)
    askers = F.sequence(F.lit(0), F.ceil(F.col("outside") / tile).cast("int") - 1)
    rows = labelled.join(mixed, "key").join(nodes.select("node", "n", "signature", "marks"), "node")

    def dealt(parts: Column) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(SEED)), parts).cast("int")

    asked = rows.withColumn("asks", F.lit(False)).withColumn("row", F.explode(askers)).withColumn("col", dealt(split))
    asks = rows.filter(asking).withColumn("asks", F.lit(True)).withColumn("col", F.explode(blocks)).withColumn(
        "row", dealt(F.ceil(F.col("outside") / tile))
    )
    tiles = asked.unionByName(asks).select(
        "key", (F.col("row").cast("long") * 1_000_000_007 + F.col("col")).alias("tile"), "asks", "node", "root", "n", "signature", "marks"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, ask, node, root, n, words, marks in _tiles(batches):
            own_mark = np.uint32(key[0] & 0xFFFFFFFF)
            wanted, base = np.flatnonzero(ask), np.flatnonzero(~ask)
            step = max(1, RUN_PAIRS // max(1, len(base)))
            for at in range(0, len(wanted), step):
                some = wanted[at : at + step]
                equal, either = equal_places(words[some, None, :], words[None, base, :])
                small, large = np.minimum(n[some, None], n[None, base]), np.maximum(n[some, None], n[None, base])
                apart = (root[some, None] != root[None, base]) & (100 * small >= percent * large)
                near = is_near(equal, either, n[some, None] + n[None, base], percent)
                left, right = np.nonzero(near & apart)
                shared = marks[some[left]] == marks[base[right]]
                first = marks[some[left], shared.argmax(axis=1)] == own_mark
                left, right = left[first], right[first]
                value = similarity(equal[left, right], either[left, right])
                order = np.lexsort((node[base][right], -value, left))
                left, right = left[order], right[order]
                place = np.arange(len(left)) - np.searchsorted(left, left)
                best = place < partners
                a, b = node[some][left[best]], node[base][right[best]]
                held_back = np.bincount(left, minlength=len(some))[left[best]] > partners
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(held_back),
                     pa.array(np.full(len(a), key[0])), pa.array(a)],
                    names=["a", "b", "more", "key", "asked"],
                )

    return tiles.repartition("key", "tile").sortWithinPartitions("key", "tile").transform(
        map_in_arrow, run, "a long, b long, more boolean, key long, asked long"
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text"), strict=True):
            if key in seen:
                continue
            seen.add(key)
            hashes = shingle_hashes(text.as_py())
            hi, lo = set_digest(hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([hi], pa.int64()), pa.array([lo], pa.int64()),
                 pa.array([hashes.view(np.int64)], pa.list_(pa.int64()))], names=["hi", "lo", "hashes"],
            )


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, hashes`` of the wanted nodes, from one text of each; written once."""
    chosen = cut_lineage(nodes.join(wanted, "node", "left_semi").select("node", "hi", "lo", "text_key"))
    keys = chosen.select("text_key").distinct()
    if chosen.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = docs.select("text", F.xxhash64("text").alias("text_key")).join(keys, "text_key", "left_semi")
    found = texts.select("text", "text_key").transform(map_in_arrow, _sets, "hi long, lo long, hashes array<long>")
    # Two texts may share a key, so a text counts for the set that it has.
    return cut_lineage(
        found.groupBy("hi", "lo").agg(F.first("hashes").alias("hashes")).join(chosen.select("node", "hi", "lo"), ["hi", "lo"])
        .select("node", "hashes")
    )


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``(a, b)`` pairs that reach the limit on their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common_ = F.size(F.array_intersect("of_a", "of_b"))
    counted = both.select("a", "b", common_.alias("common"), (F.size("of_a") + F.size("of_b")).alias("total"))
    return counted.filter(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def _components(links: list[DataFrame]) -> DataFrame:
    edges = reduce(DataFrame.unionByName, links).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return connected_components(edges)


def set_components(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT, partners: int = PARTNERS,
                   tile: int = TILE) -> DataFrame:
    """``node, root`` of every distinct set that is linked with another one and is not the root itself."""
    buckets = shared_buckets(nodes)
    parts = _parts(buckets, PART_LINKS)
    sets = full_sets(docs, nodes, buckets.select("node").distinct()).coalesce(parts)
    stars = buckets.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    tested = cut_lineage(near_pairs(stars, nodes, percent).coalesce(parts))
    links = [cut_lineage(confirmed(tested, sets, percent).coalesce(parts))]
    held = None
    while True:
        roots = _components(links)
        found = cut_lineage(cross_pairs(buckets, nodes, roots, partners, percent, tile, held).coalesce(parts))
        fresh = found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        new = cut_lineage(confirmed(fresh, sets, percent).coalesce(parts))
        held = cut_lineage(found.filter("more").select("key", F.col("asked").alias("node")).distinct())
        if new.limit(1).count():
            links.append(new)
            roots = None
        if not held.limit(1).count():
            return _components(links) if roots is None else roots
        tested = cut_lineage(tested.unionByName(found.select("a", "b")).distinct().coalesce(parts))
        partners *= 8


def near_duplicates(docs: DataFrame, percent: int = PERCENT, partners: int = PARTNERS, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    rows = cut_lineage(described(docs))
    nodes = distinct_sets(rows)
    roots = set_components(docs, nodes, percent, partners, tile)
    placed = nodes.select("node", "hi", "lo", "first_id").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    named = with_least(cut_lineage(placed), "root", "first_id", "least_id").select("hi", "lo", "least_id")
    blank = F.col("n_shingles") == 0
    given = rows.select("doc_id", "n_shingles", "hi", "lo")
    linked = given.filter(~blank).join(named, ["hi", "lo"]).select("doc_id", "n_shingles", F.col("least_id").alias("component_id"))
    alone = given.filter(blank).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


#: Every shared shingle of two different sets is counted, and links are followed to a fixed point.
OP12_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id,
  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
  range(1, greatest(2, len(w) - 2)), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM words),
folded AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
listed AS (SELECT node, n, unnest(s) AS g FROM folded),
shared AS (SELECT a.node AS a, b.node AS b, count(*) AS c, any_value(a.n + b.n) AS t
  FROM listed a JOIN listed b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (t - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node, node AS seen FROM folded UNION SELECT r.node, w.b FROM reach r JOIN ways w ON r.seen = w.a),
least_ids AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, t.doc_id) AS component_id,
  t.doc_id = coalesce(l.component_id, t.doc_id) AS kept
FROM sets t LEFT JOIN folded f ON t.s = f.s LEFT JOIN least_ids l ON f.node = l.node"""
