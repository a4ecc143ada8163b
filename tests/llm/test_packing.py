import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docketlens.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer_file(tokenizer, documents):
    options = packing.PackOptions()
    rng = random.Random(2)
    odd = ["", " ", "\n\n x", "don't  stop\t", "é😀ß 漢字 ١٢٣ ½", "a" * 3000, "<|endoftext|> x", "  x", "é"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), 10])) for _ in range(60)) for _ in range(60)]
    odd += ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x\n<|endoftext|>\n y", "<|endoftext", "a<|endoftext|>"]
    texts = odd + [r["text"] for r in documents.limit(60).collect()]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert packing.encode(text, options).tolist() == want
    assert packing.encode(None, options).tolist() == [0]


def check_pieces(tokenizer, docs, pieces):
    """Every id once, in order, with right sums; windows gapless and short; returns the padded share."""
    left = pieces.groupby("doc_id", dropna=False)
    assert len(pieces) >= len(docs)
    for doc_id, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        own = left.get_group(doc_id).sort_values("start")
        assert set(own.doc_tokens) == {len(ids)}
        at = 0
        for p in own.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padded = used = 0
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset.to_numpy() == np.r_[0, own.length.cumsum()[:-1]]).all()
        n = int(own.length.sum())
        assert n <= 1024
        padded += packing.padding(n, 1024)
        used += n
    return padded / (padded + used)


def test_query(spark, sf, tokenizer, documents):
    pieces = packing.op7_packing(spark, sf).toPandas()
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert check_pieces(tokenizer, docs, pieces) < 0.03


def test_edges(edge_docs, no_docs, tokenizer):
    named = edge_docs.filter("doc_id is not null and doc_id <> 1")
    pieces = packing.pack(named).toPandas()
    check_pieces(tokenizer, [(r["doc_id"], r["text"]) for r in named.collect()], pieces)
    everything = packing.pack(edge_docs).toPandas()
    assert everything.length.sum() == sum(
        len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in edge_docs.collect()
    )
    assert packing.pack(no_docs).count() == 0


def plain_cost(positions, penalty, window):
    best = [0] + [10**12] * (len(positions) - 1)
    for j in range(1, len(positions)):
        for i in range(j):
            n = positions[j] - positions[i]
            if n <= window:
                best[j] = min(best[j], best[i] + packing.padding(n, window) + penalty[j])
    return best[-1]


def test_cuts_are_optimal():
    rng = random.Random(4)
    for window in (8, 16, 64):
        for _ in range(60):
            positions = [0]
            while len(positions) < 40:
                positions.append(positions[-1] + rng.randint(1, min(window, 9)))
            penalty = [rng.choice([0, 1, 3, 20]) for _ in positions]
            ends = packing.best_cuts(np.array(positions), np.array(penalty), window)
            weight = dict(zip(positions, penalty))
            cuts = [0, *ends.tolist()]
            cost = sum(packing.padding(b - a, window) + weight[b] for a, b in zip(cuts, cuts[1:]))
            assert cost == plain_cost(positions, penalty, window)


def test_small_blocks_keep_every_token(edge_docs, tokenizer):
    named = edge_docs.filter("doc_id in (5, 6, 7)")
    pieces = packing.pack(named, packing.PackOptions(block_tokens=500)).toPandas()
    check_pieces(tokenizer, [(r["doc_id"], r["text"]) for r in named.collect()], pieces)
