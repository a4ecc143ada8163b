"""SimHash fingerprints and their exact 4-bit linking by a Gray-order hierarchical index.

A fingerprint takes the bitwise majority of the XXH64 values of a text's 4-word shingles. Equal
fingerprints are folded first. Two fingerprints that differ in at most 4 bits agree on at least two
of six bit blocks, so each distinct fingerprint is listed under its 15 pairs of blocks; such a
masked pattern is the top node of an index. Below it the fingerprints are sorted by Gray rank and
packed into nodes of 16, level by level; a node holds the bits that all below it share. A query
adds up its differences with the masked patterns on the way down and drops a whole node once they
pass 4. A node that even in the worst case stays within 4 is linked by a single edge.

Each bucket gives a spanning forest, never its pairs; components follow by star contraction.

Null and blank texts have fingerprint 0 and are linked like any other. A null ``doc_id`` takes
part, but never names a component unless nothing else is in it (then the component is null).
Repeated rows are equal fingerprints. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, map_in_arrow
from . import common
from .components import connected_components, with_least

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
FANOUT = 16
#: Buckets are searched in runs of about so many fingerprints, and so many comparisons at a time.
RUN_CODES = 1 << 17
RUN_PAIRS = 1 << 21
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    begins = ends - lengths
    k = min(SHINGLE_WORDS, len(words))
    first = begins[: len(words) - k + 1].tolist()
    last = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), 1 << 16):
        hashes = np.array(
            [digest(joined[a:b], SEED)
             for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    set_bits = (votes * 2 > len(first)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", output: str = "fp") -> DataFrame:
    """``df`` with the fingerprint as a signed long."""

    def start():
        def compute(columns, rows):
            values = [fingerprint(t) for t in columns[text].to_pylist()]
            return [np.array(values, dtype=np.uint64).view(np.int64)]

        return compute

    return common.append_columns(df, f"`{output}` long", start, (text,))


def gray_rank(code: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def block_masks() -> list[int]:
    """Masks of all pairs of six blocks of 11 or 10 bits, as signed 64-bit values."""
    masks, at = [], 0
    for width in (11, 11, 11, 11, 10, 10):
        masks.append(((1 << width) - 1) << at)
        at += width
    joined = [a | b for a, b in combinations(masks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in joined]


class GrayIndex:
    """The masked-pattern hierarchy over buckets of Gray-ordered codes.

    ``levels[0]`` are the codes, each higher level groups up to ``FANOUT`` nodes of one bucket, and
    the last one has a single node per bucket.
    """

    def __init__(self, codes: np.ndarray, buckets: np.ndarray) -> None:
        self.codes = codes
        n = len(codes)
        self.levels = [
            {"pattern": codes, "mask": np.full(n, _ALL), "bucket": buckets,
             "child": np.arange(n), "children": np.ones(n, dtype=np.int64),
             "first": np.arange(n), "end": np.arange(n) + 1}
        ]
        while True:
            below = self.levels[-1]
            m = len(below["pattern"])
            starts = np.flatnonzero(np.r_[True, below["bucket"][1:] != below["bucket"][:-1]])
            sizes = np.diff(np.r_[starts, m])
            if len(self.levels) > 1 and (sizes == 1).all():
                break
            place = np.arange(m) - np.repeat(starts, sizes)
            cut = np.flatnonzero(place % FANOUT == 0)
            both = np.bitwise_and.reduceat(below["pattern"], cut)
            any_ = np.bitwise_or.reduceat(below["pattern"], cut)
            mask = np.bitwise_and.reduceat(below["mask"], cut) & ~(both ^ any_)
            ends = np.r_[cut[1:], m]
            self.levels.append(
                {"pattern": both & mask, "mask": mask, "bucket": below["bucket"][cut],
                 "child": cut, "children": ends - cut, "first": below["first"][cut],
                 "end": below["end"][ends - 1]}
            )

    def links(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges (query position, code position) that join every pair within ``MAX_BITS`` bits."""
        top = self.levels[-1]
        nodes = np.searchsorted(top["bucket"], self.levels[0]["bucket"][queries])
        spent = np.zeros(len(queries), dtype=np.int64)
        used = np.zeros(len(queries), dtype=np.uint64)
        left, right = [], []
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            mask = level["mask"][nodes]
            fresh = mask & ~used
            spent = spent + np.bitwise_count((self.codes[queries] ^ level["pattern"][nodes]) & fresh)
            near = (spent <= MAX_BITS) & (level["end"][nodes] > queries)
            queries, nodes, spent, used = queries[near], nodes[near], spent[near], mask[near]
            whole = spent + np.bitwise_count(~used) <= MAX_BITS
            if whole.any():
                left.append(queries[whole])
                right.append(level["first"][nodes[whole]])
                rest = ~whole
                queries, nodes, spent, used = queries[rest], nodes[rest], spent[rest], used[rest]
            if depth == 0 or not len(queries):
                break
            counts = level["children"][nodes]
            base = np.repeat(level["child"][nodes] - np.r_[0, np.cumsum(counts)[:-1]], counts)
            queries, spent, used = (np.repeat(x, counts) for x in (queries, spent, used))
            nodes = base + np.arange(len(queries))
        if not left:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(left), np.concatenate(right)


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of ``a`` and ``b``; a label is the smallest position."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            nearer = labels[labels]
            if (nearer == labels).all():
                break
            labels = nearer


def forest(codes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """For each code the position of its set's first code; codes are Gray-ordered per bucket."""
    labels = np.arange(len(codes))
    _, inverse, counts = np.unique(buckets, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts[inverse] > 1)
    if not len(shared):
        return labels
    own, own_buckets = codes[shared], buckets[shared]
    index = GrayIndex(own, own_buckets)
    sub = np.arange(len(own))
    weight = np.cumsum(counts[inverse][shared])
    begin = 0
    while begin < len(own):
        limit = (weight[begin - 1] if begin else 0) + RUN_PAIRS
        end = max(begin + 1, int(np.searchsorted(weight, limit, "right")))
        sub = _merge(sub, *index.links(np.arange(begin, end)))
        begin = end
    labels[shared] = shared[sub]
    return labels


def _whole_buckets(batches: Iterator[pa.RecordBatch]):
    """Runs of complete (mask, key) buckets from sorted batches."""
    held: list[tuple] = []
    size, due = 0, RUN_CODES

    def joined():
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in ("mask_no", "key", "fp")))
        size += batch.num_rows
        if size < due:
            continue
        mask_no, key, fp = joined()
        change = np.flatnonzero((key[1:] != key[:-1]) | (mask_no[1:] != mask_no[:-1]))
        if len(change):
            cut = change[-1] + 1
            yield mask_no[:cut], key[:cut], fp[:cut]
            held, size, due = [(mask_no[cut:], key[cut:], fp[cut:])], len(key) - cut, RUN_CODES
        else:
            # One bucket alone so far: look again once it has doubled.
            held, due = [(mask_no, key, fp)], 2 * size
    if size:
        yield tuple(joined())


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for mask_no, key, fp in _whole_buckets(batches):
        change = (key[1:] != key[:-1]) | (mask_no[1:] != mask_no[:-1])
        buckets = np.r_[0, np.cumsum(change)]
        labels = forest(fp.view(np.uint64), buckets)
        moved = np.flatnonzero(labels != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(fp[moved]), pa.array(fp[labels[moved]])], names=["src", "dst"]
        )


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """Distinct ``fp`` values to edges ``(src, dst)`` that connect every near pair."""
    listed = F.array(*[
        F.struct(F.lit(i).alias("mask_no"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(block_masks())
    ])
    buckets = fingerprints.select("fp", gray_rank(F.col("fp")).alias("rank"),
                                  F.explode(listed).alias("b"))
    return (
        buckets.select("b.mask_no", "b.key", "rank", "fp")
        .repartition("mask_no", "key")
        .sortWithinPartitions("mask_no", "key", "rank")
        .select("mask_no", "key", "fp")
        .transform(map_in_arrow, _bucket_edges, "src long, dst long")
        .distinct()
    )


def _rooted(prints: DataFrame) -> DataFrame:
    """``prints`` with the fingerprint ``root`` and the ``component_id`` of each row's component."""
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = cut_lineage(connected_components(fingerprint_links(firsts.select("fp"))))
    placed = cut_lineage(firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        firsts["fp"], "first_id", F.coalesce("root", firsts["fp"]).alias("root")
    ))
    by_print = with_least(placed, "root", "first_id", "component_id").select("fp", "root", "component_id")
    return prints.join(by_print, "fp")


def near_components(prints: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` rows to ``(doc_id, fp, component_id)``; the input should be materialised."""
    return _rooted(prints).select("doc_id", "fp", "component_id")


def documents_with_components(docs: DataFrame) -> DataFrame:
    return near_components(cut_lineage(with_fingerprint(docs.select("doc_id", "text")).drop("text")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents_with_components(common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one row of each near-duplicate group, that with the smallest id.

    Rows are told apart by their number, so rows that share an id or have none are judged like any
    other: a group's rows without an id give way to those with one, and of several rows with the
    smallest id the first in the scan stays.
    """
    rows = common.with_stored_row(docs, "simhash")
    prints = cut_lineage(with_fingerprint(common.columns_of(rows, "doc_id", "text")).drop("text"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", common.ROW)
    kept = _rooted(prints).groupBy("root").agg(F.min_by(common.ROW, order).alias(common.ROW))
    return rows.join(kept, common.ROW, "left_semi").select(f"{common.DOC}.*")
