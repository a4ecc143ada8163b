import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docketlens.llm import components, simhash


def plain_fingerprint(text):
    data = (text or "").encode().lower().split()
    shingles = [b" ".join(data[i : i + 4]) for i in range(max(1, len(data) - 3))] if data else []
    out = 0
    for bit in range(64):
        votes = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        out |= (2 * votes > len(shingles)) << bit
    return out


def plain_components(codes, ids):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    found = ids.copy()
    while True:
        moved = np.array([found[row].min() for row in near])
        if (moved == found).all():
            return found
        found = moved


def test_fingerprints(documents):
    rows = simhash.with_fingerprint(documents.select("doc_id", "text")).limit(60).collect()
    assert all(r["fp"] & (2**64 - 1) == plain_fingerprint(r["text"]) for r in rows)
    for text in (None, "", " \t", "A b", "Ä b c d É", "a b c d"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_query_against_all_pairs(spark, sf):
    found = simhash.op10_simhash(spark, sf).orderBy("doc_id").toPandas()
    codes = np.array([int(x, 16) for x in found.fingerprint], dtype=np.uint64)
    assert (plain_components(codes, found.doc_id.to_numpy()) == found.component_id.to_numpy()).all()


def planted(n, seed):
    """Codes in dense balls, chains of 4-bit steps and random ones."""
    rng = random.Random(seed)
    codes = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            codes.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
        step = centre
        for _ in range(15):
            step ^= sum(1 << b for b in rng.sample(range(64), 4))
            codes.append(step)
    return codes


@pytest.mark.parametrize("least_degree", [64, 2])
def test_components_with_hubs(spark, monkeypatch, least_degree):
    rng = random.Random(12)
    pairs = [(5000, i) for i in range(4000, 4300)] + [(i, 7) for i in range(10, 300)] + [(4100, 150), (3, 3)]
    pairs += [(i, i + 1) for i in range(6000, 6100)] + [tuple(rng.sample(range(7000, 7400), 2)) for _ in range(300)]
    monkeypatch.setattr(components, "_hub_degree", lambda edges: least_degree)
    got = {r["node"]: r["root"] for r in components.connected_components(
        spark.createDataFrame(pairs, "src long, dst long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


def test_links_lose_no_pair(spark):
    codes = planted(400, 5)
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(prints).collect()}
    want = plain_components(np.array(codes, dtype=np.uint64), np.arange(len(codes)))
    assert [got[i] for i in range(len(codes))] == want.tolist()


def test_index_in_small_runs(monkeypatch):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    codes = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(700)})
    codes = np.array(codes, dtype=np.uint64)
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    monkeypatch.setattr(simhash, "RUN_PAIRS", 2000)
    labels = simhash.forest(codes, np.zeros(len(codes), dtype=np.int64))
    assert (labels == plain_components(codes, np.arange(len(codes)))).all()


def test_buckets_stay_whole(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    sizes = [1, 300, 2, 2, 900, 1, 40]
    keys = np.repeat(np.arange(len(sizes)), sizes)
    rows = [np.zeros(len(keys), dtype=np.int32), keys, np.array([rng.getrandbits(63) for _ in keys])]
    whole = pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["mask_no", "key", "fp"])
    monkeypatch.setattr(simhash, "RUN_CODES", 50)
    runs = list(simhash._whole_buckets(whole.slice(i, 17) for i in range(0, len(keys), 17)))
    assert np.concatenate([r[2] for r in runs]).tolist() == rows[2].tolist()
    seen = [set(r[1].tolist()) for r in runs]
    assert sum(map(len, seen)) == len(sizes) and len(runs) > 2


def test_edges(edge_docs, no_docs):
    rows = simhash.documents_with_components(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    zero = [r for r in rows if r["fp"] == 0]
    assert len(zero) >= 4 and {r["component_id"] for r in zero} == {2}
    german = {r["component_id"] for r in rows if r["doc_id"] == 6}
    assert german == {6}
    assert simhash.documents_with_components(no_docs).count() == 0


def test_survivors(edge_docs, documents, no_docs):
    kept = simhash.survivors(documents)
    assert kept.columns == documents.columns
    components = simhash.documents_with_components(documents)
    assert kept.count() == components.select("component_id").distinct().count()
    assert kept.join(components.filter(F.col("doc_id") == F.col("component_id")), "doc_id", "left_anti").count() == 0
    ids = sorted(r["doc_id"] for r in simhash.survivors(edge_docs).filter("doc_id is not null").collect())
    assert len(ids) == len(set(ids)) and {1, 2, 5, 6} <= set(ids) and 3 not in ids
    assert simhash.survivors(no_docs).count() == 0


@pytest.mark.parametrize("key", [None, 7])
def test_survivors_that_share_an_id(spark, key):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("left", "right"))
    docs = spark.createDataFrame([(key, a), (key, a), (key, b)], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.survivors(docs).collect()) == [a, b]
