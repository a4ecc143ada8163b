"""Merkle manifest of a dataset with checkpoint-and-recompute proofs.

Every row is a leaf; the leaves of one group (a source) form a tree of fan-out 16 in the order of their
ids, and the groups' roots form one more tree. Only the leaves and every ``STRIDE``-th level above them
are persisted. A proof needs the levels between as well: they are regenerated, one aligned subtree of
``FANOUT ** STRIDE`` stored nodes at a time, used to emit the siblings of the nodes below, and discarded.
So a task holds one subtree and the siblings above it, at any size of the dataset.

Places are counted without gathering a group: rows are range-partitioned by group and id, and one count
per partition and group gives the offsets, so a group that holds a third of all rows is spread like any
other.

Nulls hash as ``-``; a null group is a group of its own and comes first, and null ids come first in their
group and are never altered by ``tampered``. Rows that share an id are ordered by their leaf, so equal rows
are equal leaves with proofs of their own. Empty texts hash as ``0:``. A null or empty table gives no rows.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, map_in_arrow
from . import common

FANOUT = 16
#: Every so many levels are persisted; a subtree that is regenerated in one piece has 16^2 stored nodes.
STRIDE = 2
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def leaf_hash(**values: Column) -> Column:
    """Hash of named values: each is ``-`` if null, else its byte count, ``:`` and itself."""
    parts = []
    for value in values.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tampered(doc_id: Column) -> Column:
    """Rows whose text a test of the manifest alters: 5 divides the CRC-32 of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree`` (the source), ``doc_id``, ``hash``, and ``altered``: the leaf of a tampered row, else null."""
    plain = {name: F.col(name) for name in FIELDS}
    changed = plain | {"text": F.translate("text", _UPPER, _LOWER)}
    return docs.select(
        F.col("source").cast("string").alias("tree"), "doc_id", leaf_hash(**plain).alias("hash"),
        F.when(tampered(F.col("doc_id")), leaf_hash(**changed)).alias("altered"),
    )


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with ``pos``: their place from 0 within ``tree`` by ``order``."""
    sorted_ = cut_lineage(
        nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
        .withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id())
    )
    counts = sorted_.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    earlier = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        F.col("part").alias("of_part"), F.col("tree").alias("of_tree"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
    )
    here = (F.col("part") == F.col("of_part")) & F.col("tree").eqNullSafe(F.col("of_tree"))
    return sorted_.join(starts, here).select(*nodes.columns, (F.col("seq") + F.col("shift")).alias("pos"))


def grown(hashes: list[str], alone: bool) -> list[list[str]]:
    """Levels of one subtree from its stored nodes up; ``alone`` if it is the whole tree."""
    levels = [hashes]
    for _ in range(STRIDE):
        below = levels[-1]
        if alone and len(below) == 1:
            break
        levels.append([digest("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """Left and right siblings, joined, of node ``at`` on each level below the top one."""
    left, right = [], []
    for level in levels[:-1]:
        first = at - at % FANOUT
        left.append("".join(level[first:at]))
        right.append("".join(level[at + 1 : first + FANOUT]))
        at //= FANOUT
    return left, right


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, list[dict]]]:
    """The header and the nodes of each subtree, from rows in the order of ``_in_subtrees``."""
    key, head, nodes = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["tree"], row["sub"])
            if own != key and key is not None:
                yield head, nodes
                head, nodes = None, []
            key = own
            if row.get("is_node", True):
                nodes.append(row)
            else:
                head = row
    if key is not None:
        yield head, nodes


def _levels_of(nodes: list[dict]) -> list[list[str]]:
    # All subtrees of a tree but the last one are full, so a first one that is not full is the whole tree.
    alone = nodes[0]["sub"] == 0 and len(nodes) < FANOUT**STRIDE
    return grown([n["hash"] for n in nodes], alone)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = []
    for _, nodes in _subtrees(batches):
        made.append((nodes[0]["tree"], nodes[0]["sub"], _levels_of(nodes)[-1][0]))
        if len(made) == 4096:
            yield _table(made, "tree", "pos", "hash")
            made = []
    yield _table(made, "tree", "pos", "hash")


def _table(rows: list[tuple], *names: str) -> pa.RecordBatch:
    kinds = {"pos": pa.int64(), "doc_id": pa.int64(), "verified": pa.bool_(),
             "left": pa.list_(pa.string()), "right": pa.list_(pa.string())}
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names=list(names)
    )


def _in_subtrees(nodes: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Nodes by subtree in order, each subtree behind its header if there are headers."""
    rows = nodes.withColumn("sub", F.shiftright("pos", (FANOUT**STRIDE).bit_length() - 1))
    order = ["tree", "sub", "pos"]
    if heads is not None:
        rows = rows.withColumn("is_node", F.lit(True)).unionByName(
            heads.withColumn("is_node", F.lit(False)), allowMissingColumns=True
        )
        order = ["tree", "sub", "is_node", "pos"]
    return rows.repartitionByRange("tree", "sub").sortWithinPartitions(*order)


@dataclass
class Forest:
    """The stored levels of one tree per ``tree`` value: 0, STRIDE, 2 STRIDE and so on.

    The last level has one node, the root, for each tree.
    """

    levels: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("tree", "hash")


def forest(nodes: DataFrame, *order: str) -> Forest:
    """Stored levels over ``nodes`` (``tree, hash`` and further columns) in the given order."""
    levels = [cut_lineage(placed(nodes, *order))]
    while True:
        below = _in_subtrees(levels[-1].select("tree", "pos", "hash"))
        levels.append(cut_lineage(below.transform(map_in_arrow, _folded, "tree string, pos long, hash string")))
        if not levels[-1].filter("pos > 0").limit(1).count():
            return Forest(levels)


def _headers_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("tree", "pos", "left", "right", "subroot", "root")
    made = []
    for head, nodes in _subtrees(batches):
        levels = _levels_of(nodes)
        for at, node in enumerate(nodes):
            left, right = siblings(levels, at)
            made.append((node["tree"], node["pos"], left + head["left"], right + head["right"],
                         head["subroot"], head["root"]))
            if len(made) == 512:
                yield _table(made, *names)
                made = []
    yield _table(made, *names)


def refolded(node: str, left: list[str], right: list[str]) -> str:
    for a, b in zip(left, right, strict=True):
        node = digest(a + node + b)
    return node


def _leaf_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("tree", "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    made = []
    for head, nodes in _subtrees(batches):
        levels = _levels_of(nodes)
        above = "".join(a + b for a, b in zip(head["left"], head["right"], strict=True))
        tops: dict[str, str] = {}
        for at, node in enumerate(nodes):
            left, right = siblings(levels, at)
            top = refolded(node["altered"] or node["hash"], left, right)
            if top not in tops:
                tops[top] = refolded(top, head["left"], head["right"])
            proof = "".join(a + b for a, b in zip(left, right, strict=True)) + above
            made.append((node["tree"], node["doc_id"], node["hash"], head["subroot"], head["root"],
                         digest(proof), tops[top], tops[top] == head["root"]))
        if len(made) >= 4096:
            yield _table(made, *names)
            made = []
    yield _table(made, *names)


def _descended(stored: Forest, heads: DataFrame, whole: bool) -> DataFrame:
    """Headers of the leaves (``whole`` false) or their proofs, from headers of the roots.

    ``heads``: ``tree, sub, left, right, subroot, root`` with ``sub`` 0 for each tree.
    """
    header = "tree string, pos long, left array<string>, right array<string>, subroot string, root string"
    for level in reversed(stored.levels[1:-1]):
        below = _in_subtrees(level, heads).transform(map_in_arrow, _headers_below, header)
        heads = below.withColumnRenamed("pos", "sub")
    rows = _in_subtrees(stored.levels[0], heads)
    if not whole:
        return rows.transform(map_in_arrow, _headers_below, header)
    return rows.transform(
        map_in_arrow, _leaf_proofs,
        "tree string, doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean",
    )


def proofs(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    of_sources = forest(leaves(docs), "doc_id", "hash")
    named = of_sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash")
    over = forest(named, "source")
    nothing = F.array().cast("array<string>")
    top = over.roots.select(
        "tree", F.lit(0).cast("long").alias("sub"), nothing.alias("left"), nothing.alias("right"),
        F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"),
    )
    above = _descended(over, top, whole=False)
    # Places in the tree of roots name the sources again.
    sources = over.levels[0].select("pos", F.col("source"), F.col("hash").alias("of_source"))
    heads = above.join(sources, "pos").select(
        F.col("source").alias("tree"), F.lit(0).cast("long").alias("sub"), "left", "right",
        F.col("of_source").alias("subroot"), "root",
    )
    return _descended(of_sources, heads, whole=True)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(common.table(spark, sf_dir, "documents")).drop("tree")


# --- the same rows in DuckDB ----------------------------------------------------------------------

#: Levels that the SQL unrolls; 16^6 leaves of one source are far beyond the tables it is run on.
_SQL_LEVELS = 6


def _sql_field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _sql() -> str:
    """Levels as a chain of CTEs; a tree that has come down to one node stays as it is."""
    # CRC-32 by its definition, bit by bit over the decimal digits.
    step = "CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    bits = "list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) for i in range(8)]), lambda c, z: " + step + ")"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {bits}), 4294967295)"
    plain = " || ".join(_sql_field(n) for n in FIELDS)
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    changed = " || ".join(_sql_field(lower if n == "text" else n) for n in FIELDS)
    ctes = [
        f"""raw AS (SELECT doc_id, source, sha256({plain}) AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN sha256({changed}) END AS altered FROM documents)""",
        """leafs AS (SELECT *, coalesce('s' || source, '') AS tree, row_number() OVER (PARTITION BY source
  ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM raw)""",
    ]

    def climb(name: str, first: str) -> None:
        ctes.append(f"{name}0 AS ({first})")
        for k in range(_SQL_LEVELS):
            ctes.append(f"""{name}r{k} AS (SELECT tree, pos // 16 AS up, string_agg(hash, '' ORDER BY pos) AS run,
  max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}) GROUP BY 1, 2)""")
            ctes.append(f"""{name}{k + 1} AS (SELECT tree, up AS pos,
  CASE WHEN n = 1 THEN run ELSE sha256(run) END AS hash FROM {name}r{k})""")

    def walk(name: str, first: str, prefix: str) -> str:
        """CTEs that take ``node`` and ``proof`` of each row from the leaves of ``name`` to its root."""
        last = first
        for k in range(_SQL_LEVELS):
            shift = f"(a.pos // {16**k})"
            left, right = f"substring(r.run, 1, 64 * ({shift} % 16))", f"substring(r.run, 64 * ({shift} % 16) + 65)"
            ctes.append(f"""{prefix}{k} AS (SELECT a.* EXCLUDE (node, proof),
  CASE WHEN r.n = 1 THEN a.node ELSE sha256({left} || a.node || {right}) END AS node,
  CASE WHEN r.n = 1 THEN a.proof ELSE a.proof || {left} || {right} END AS proof
  FROM {last} a JOIN {name}r{k} r ON a.tree = r.tree AND {shift} // 16 = r.up)""")
            last = f"{prefix}{k}"
        return last

    climb("t", "SELECT tree, pos, leaf AS hash FROM leafs")
    ctes.append(f"""tops AS (SELECT tree AS source_tree, hash AS subroot, '' AS tree,
  row_number() OVER (ORDER BY tree) - 1 AS pos FROM t{_SQL_LEVELS})""")
    climb("u", "SELECT tree, pos, subroot AS hash FROM tops")
    ctes.append("begun AS (SELECT *, coalesce(altered, leaf) AS node, '' AS proof FROM leafs)")
    low = walk("t", "begun", "p")
    ctes.append(f"""middle AS (SELECT l.doc_id, l.leaf, l.node, l.proof, o.subroot, o.tree, o.pos
  FROM {low} l JOIN tops o ON l.tree = o.source_tree)""")
    high = walk("u", "middle", "q")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT m.doc_id, m.leaf, m.subroot, r.hash AS root, sha256(m.proof) AS proof_sha256,
  m.node AS folded_root, m.node = r.hash AS verified
FROM {high} m CROSS JOIN u{_SQL_LEVELS} r"""


OP11_SQL = _sql()
