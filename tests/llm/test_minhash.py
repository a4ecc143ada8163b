import random

import numpy as np
import pytest

from docketlens.llm import minhash

from ..compare import spark_rows, sql_rows


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def plain_rows(rows, percent=80):
    """``(component_id, doc_id, kept, n_shingles)`` by comparing all pairs of texts."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in (least.get(top(i)), doc_id) if x is not None]
        least[top(i)] = min(known, default=None)
    out = [(least[top(i)], d, least[top(i)] == d, len(sets[i])) for i, (d, _) in enumerate(rows)]
    return sorted(out, key=repr)


def found(docs, **options):
    columns, rows = spark_rows(minhash.near_duplicates(docs, **options))
    assert columns == ["component_id", "doc_id", "kept", "n_shingles"]
    return rows


def planted(seed, groups=8, copies=25, words=150):
    """Groups of near copies around the limit, chains, exact copies, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for g in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8])):
                text[rng.randrange(words)] = word()
            texts.append(" ".join(text).upper() if rng.random() < 0.2 else " ".join(text))
        step = list(base)
        for _ in range(12):
            for _ in range(3):
                step[rng.randrange(words)] = word()
            texts.append("  ".join(step))
    texts += [" ".join(word() for _ in range(words)) for _ in range(60)]
    texts += ["", None, " \t", "a b", "A B", "a b c", "a b c d", "a b c d"]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, partners, tile", [(1, 8, 4096), (2, 1, 16)])
def test_against_all_pairs(spark, seed, partners, tile):
    """Also with tiles smaller than the buckets and partners held back, so that several rounds run."""
    rows = planted(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(docs, partners=partners, tile=tile) == plain_rows(rows)


def test_only_sets_that_held_partners_back_ask_again(spark, monkeypatch):
    cross, rounds = minhash.cross_pairs, []

    def spied(*args):
        pairs = minhash.cut_lineage(cross(*args))
        allowed = args[-1] and {tuple(r) for r in args[-1].select("key", "node").collect()}
        rounds.append((allowed, {tuple(r) for r in pairs.select("key", "asked").collect()}))
        return pairs

    monkeypatch.setattr(minhash, "cross_pairs", spied)
    rows = planted(3, groups=3)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), partners=1, tile=16) == plain_rows(rows)
    assert len(rounds) > 1 and rounds[0][0] is None
    assert all(asked <= allowed for allowed, asked in rounds[1:])


def test_edges(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    expected = plain_rows(rows)
    assert found(edge_docs) == expected
    assert found(no_docs) == []
    blank = spark.createDataFrame([(1, None), (None, ""), (2, " ")], "doc_id long, text string")
    assert found(blank) == plain_rows([(1, None), (None, ""), (2, " ")])


def test_query_against_sql(spark, sf):
    columns, rows = spark_rows(minhash.op12_minhash(spark, sf))
    assert rows == sql_rows(minhash.OP12_SQL, sf, columns)


def test_estimate_follows_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for shared in (200, 500, 800, 1000):
        # 1000 - shared hashes on either side are its own, so the union is 2000 - shared.
        a, b = np.unique(pool[:1000]), np.unique(pool[1000 - shared : 2000 - shared])
        codes = minhash.signatures([a, b])
        equal, either = minhash.equal_places(*codes.view("<u8"))
        true = shared / (2000 - shared)
        assert abs(minhash.similarity(equal, either) - true) < 0.1
        places = [(x, y) for p, q in zip(*codes, strict=True) for x, y in ((p & 15, q & 15), (p >> 4, q >> 4))]
        assert equal == sum(x == y != 0 for x, y in places) and either == sum(x + y > 0 for x, y in places)


def test_signatures_keep_every_pair_at_the_limit():
    """Pairs of all sizes that share exactly four fifths of their union pass."""
    rng = np.random.default_rng(6)
    for union in (5, 10, 50, 200, 700, 2500, 9000):
        for _ in range(20):
            pool = np.unique(rng.integers(0, 2**63, union).astype(np.uint64) * np.uint64(2))
            own = rng.permutation(len(pool))[: len(pool) - 4 * len(pool) // 5]
            left, right = own[: len(own) // 2], own[len(own) // 2 :]
            a, b = np.delete(pool, left), np.delete(pool, right)
            equal, either = minhash.equal_places(*minhash.signatures([a, b]).view("<u8"))
            assert minhash.is_near(equal, either, np.int64(len(a) + len(b)), 80)


def test_minima_of_pieces(monkeypatch):
    """Sets longer than a block, empty ones between, against plain minima."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 64)
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 0, 300, 63, 64, 65, 2, 128)]
    least = minhash.minima(sets)
    for i, hashes in enumerate(sets):
        for k in (0, 17, minhash.HASHES - 1):
            factor = int(minhash._FACTORS[k])
            assert int(least[k, i]) == min((int(x) * factor % 2**64 for x in hashes), default=2**64 - 1)


def test_cut_keeps_the_limit():
    """The cut is loose enough for the limit and still drops unlike sets."""
    cut = minhash.least_equal(80, 1e-9)
    assert 0.65 < minhash.similarity(cut[minhash.BINS], minhash.BINS) < 0.76
    assert cut[0] == 0 and cut[1] == 0 and (np.diff(cut) >= 0).all()
    assert (1 - 0.8**minhash.BAND_ROWS) ** minhash.BANDS < 1e-8
