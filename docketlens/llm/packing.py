"""Order-preserving packing into token windows by dynamic programming.

Documents are tokenised and concatenated in scan order, one end token after each. Cut candidates are
document ends, sentence ends and, where neither comes for a while, evenly spaced tokens. The cost of
a window is its padding plus a penalty for the kind of cut that ends it; the cheapest sequence of
cuts is found with a monotone queue over the last ``window`` tokens, plus the unpadded transitions of
power-of-two lengths. A partition is packed in blocks of about ``block_tokens``, so memory does not
grow with it, and every window lies inside one block.

A null text is empty and packs as its end token alone. Repeated rows are packed one by one. An empty
table gives an empty result. Tables with other columns are read by ``doc_id`` and ``text`` only.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..session import map_in_arrow
from . import common


@dataclass(frozen=True)
class PackOptions:
    """``vocabulary`` is a file of byte-pair ranks; its ids equal those of the JSON tokenizer file."""

    vocabulary: str | None = None
    window: int = 1024
    end_id: int = 0
    sentence_penalty: int = 6
    hard_penalty: int = 40
    longest_gap: int = 64
    spacing: int = 32
    block_tokens: int = 1 << 20


#: Fixed value: the added token of the vocabulary, which stands for itself wherever a text holds it.
ADDED_TOKENS = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def _encoding(vocabulary: str | None):
    import public_tokenizers
    import tiktoken

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding(
        "pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED_TOKENS
    )
    size = max(*ranks.values(), *ADDED_TOKENS.values()) + 1
    stops, breaks, opens = (np.zeros(size, dtype=bool) for _ in range(3))
    for piece, i in ranks.items():
        stops[i] = piece.rstrip(b"\"')]}").endswith((b".", b"!", b"?"))
        breaks[i] = b"\n" in piece
        opens[i] = piece[:1] == b" "
    return encoding, stops, breaks, opens


def encode(text: str | None, options: PackOptions) -> np.ndarray:
    encoding = _encoding(options.vocabulary)[0]
    if text and any(t in text for t in ADDED_TOKENS):
        ids = encoding.encode(text, allowed_special="all")
    else:
        ids = encoding.encode_ordinary(text) if text else []
    return np.array([*ids, options.end_id], dtype="<u4")


def cut_candidates(ids: np.ndarray, doc_ends: np.ndarray, options: PackOptions):
    """Sorted cut positions (0 first, the end last) and the penalty of each."""
    _, stops, breaks, opens = _encoding(options.vocabulary)
    ends = breaks[ids]
    ends[:-1] |= stops[ids[:-1]] & opens[ids[1:]]
    soft = np.flatnonzero(ends) + 1
    at = np.union1d(np.union1d(soft, doc_ends), [0])
    gaps = np.flatnonzero(np.diff(at) > options.longest_gap)
    hard = [np.arange(at[g] + options.spacing, at[g + 1], options.spacing) for g in gaps]
    every = np.union1d(at, np.concatenate(hard)) if hard else at
    penalty = np.full(len(every), options.hard_penalty, dtype=np.int64)
    penalty[np.isin(every, soft, assume_unique=True)] = options.sentence_penalty
    penalty[np.isin(every, doc_ends, assume_unique=True)] = 0
    return every, penalty


def padding(length: int, window: int) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def best_cuts(positions: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """Positions of the cheapest windows' ends."""
    count = len(positions)
    exact: dict[int, list[int]] = {}
    size = 1
    while size <= window:
        wanted = positions - size
        found = np.searchsorted(positions, wanted)
        hit = np.flatnonzero((wanted >= 0) & (positions[np.minimum(found, count - 1)] == wanted))
        for j, i in zip(hit.tolist(), found[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
        size *= 2
    pos, pen = positions.tolist(), penalty.tolist()
    cost, back = [0] * count, [0] * count
    # Queue of (position, cost + position, index); the key grows, the first entry is the cheapest.
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])
    for j in range(1, count):
        here = pos[j]
        reach = here - window
        while queue[0][0] < reach:
            queue.popleft()
        _, key, i = queue[0]
        best = key + window - here
        for k in exact.get(j, ()):
            if cost[k] < best:
                best, i = cost[k], k
        best += pen[j]
        cost[j], back[j] = best, i
        key = best + here
        while queue and queue[-1][1] >= key:
            queue.pop()
        queue.append((here, key, j))
    ends, j = [], count - 1
    while j:
        ends.append(pos[j])
        j = back[j]
    return np.array(ends[::-1], dtype=np.int64)


def pack_block(ids: np.ndarray, doc_lengths: np.ndarray, options: PackOptions):
    """Pieces of one block: (document, start, length, window, offset) arrays."""
    doc_ends = np.cumsum(doc_lengths)
    ends = best_cuts(*cut_candidates(ids, doc_ends, options), options.window)
    begins = np.r_[0, ends[:-1]]
    piece_ends = np.union1d(ends, doc_ends)
    piece_begins = np.r_[0, piece_ends[:-1]]
    doc = np.searchsorted(doc_ends, piece_begins, "right")
    window = np.searchsorted(ends, piece_begins, "right")
    start = piece_begins - np.r_[0, doc_ends[:-1]][doc]
    return doc, start, piece_ends - piece_begins, window, piece_begins - begins[window], piece_begins


PIECES = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "`offset` long")


def pack(docs: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """``(doc_id, text)`` to one row per piece; windows number from the scan's partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 40, 0
        names: list[pa.Array] = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal used, size
            ids = np.concatenate(parts)
            lengths = np.array([len(p) for p in parts], dtype=np.int64)
            doc, start, length, window, offset, begin = pack_block(ids, lengths, options)
            crc = [zlib.crc32(ids[a : a + n].data) for a, n in zip(begin, length, strict=True)]
            keys = pa.concat_arrays(names).take(pa.array(doc))
            columns = [keys, start, length, pa.array(crc, pa.int64()), lengths[doc],
                       base + used + window, offset]
            used += int(window[-1]) + 1
            names.clear()
            parts.clear()
            size = 0
            return pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                names.append(keys.slice(i, 1))
                parts.append(encode(texts[i].as_py(), options))
                size += len(parts[-1])
                if size >= options.block_tokens:
                    yield flush()
        if parts:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(map_in_arrow, run, PIECES.format(id=kind))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
