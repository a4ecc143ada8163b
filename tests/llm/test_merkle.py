import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from docketlens.llm import merkle

from ..compare import spark_rows, sql_rows


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    parts = []
    for name in merkle.FIELDS:
        value = None if row[name] is None else str(row[name])
        parts.append("-" if value is None else f"{len(value.encode())}:{value}")
    return h("".join(parts))


def plain_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + 16])))
        at //= 16
    return out


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row["source"], []).append((row, leaf(row)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for source in order:
        trees[source].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        built[source] = plain_tree([x[1] for x in trees[source]])
    over = plain_tree([built[s][-1][0] for s in order])
    root, out = over[-1][0], []
    for k, source in enumerate(order):
        for at, (row, own) in enumerate(trees[source]):
            path = plain_path(built[source], at) + plain_path(over, k)
            node = own
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                node = leaf({**row, "text": lowered(row["text"])})
            for left, right in path:
                node = h(left + node + right)
            out.append((row["doc_id"], node, own, h("".join(a + b for a, b in path)), root, built[source][-1][0], node == root))
    return sorted(out, key=repr)


def found(docs):
    columns, rows = spark_rows(merkle.proofs(docs).drop("tree"))
    assert columns == ["doc_id", "folded_root", "leaf", "proof_sha256", "root", "subroot", "verified"]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_trees_of_all_heights(spark):
    """Sizes on both sides of a full run, a full subtree and two stored levels, and a null source."""
    sizes = {None: 3, "": 1, "a": 2, "b": 16, "c": 17, "d": 255, "e": 256, "f": 257, "g": 4097, "é": 33}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7919 % 100_003, source, None if n % 3 else "en", n, f"Text {n} ÄB"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(docs) == plain_manifest([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows])


@pytest.mark.parametrize("sources", [1, 2, 40])
def test_few_and_many_sources(spark, sources):
    rows = [(i, f"s{i % sources}", "en", i, f"T{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(docs) == plain_manifest([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows])


def test_edges(edge_docs, no_docs):
    assert found(edge_docs) == plain_manifest([r.asDict() for r in edge_docs.collect()])
    one = edge_docs.filter("doc_id = 3")
    assert found(one) == plain_manifest([r.asDict() for r in one.collect()])
    assert found(no_docs) == []
    assert found(edge_docs.withColumn("source", F.lit(None).cast("string"))) == plain_manifest(
        [{**r.asDict(), "source": None} for r in edge_docs.collect()]
    )


def test_query_against_sql(spark, sf):
    columns, rows = spark_rows(merkle.op11_merkle(spark, sf))
    assert rows == sql_rows(merkle.OP11_SQL, sf, columns)
    assert {r[-1] for r in rows} == {True, False}
