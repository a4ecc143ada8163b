"""Toxicity by compression distance between two zstandard dictionaries.

A text's words are cut into windows of a few words, and each window is compressed with an ordinary and
with a toxic dictionary. The ordinary dictionary is trained on windows of ordinary training texts. The
toxic one holds the same content at the same distances, with the contrast vocabulary of the toxic training texts
in the room that the other one leaves empty; so an ordinary window compresses alike with both, and a
shorter toxic length is a sign of toxic text. A logistic model over the mean difference, the largest
differences and their sum is fitted and shifted so that the best threshold on the training rows has
score 0.7.

The contrast vocabulary are words and word beginnings that follow many *different* words in toxic
texts and few in ordinary ones: copies of one text repeat their neighbours and so count once.

Training uses at most about ``toxic_rows`` and ``ordinary_rows`` labelled rows, chosen by a hash of the
id; scoring reads every whole text. Null and empty texts are scored as one empty window. Without toxic
or without ordinary training rows every score is 0. Repeated rows repeat their score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, map_in_arrow
from . import common

_WORD = re.compile(r"[^\W\d_]+")
_GAP = "   "
_PREFIXES = (4, 5, 6)
#: Bytes that no UTF-8 text has.
_FILLS = (0xFF, 0xFE, 0xFD, 0xFC, 0xFB, 0xFA, 0xF9, 0xF8, 0xF7, 0xF6, 0xF5, 0xC1, 0xC0)


@dataclass(frozen=True)
class ToxicityOptions:
    toxic_rows: int = 1500
    ordinary_rows: int = 4500
    window_words: int = 8
    vocabulary_bytes: int = 32 << 10
    counter_words: int = 1024
    dictionary_samples: int = 8192
    dictionary_bytes: int = 64 << 10
    min_evidence: float = 20.0
    min_ratio: float = 20.0
    threshold: float = 0.7


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def windows(text: str | None, size: int) -> list[bytes]:
    """Windows of ``size`` words set apart by blanks, so that a short word is a long match."""
    words = words_of(text)
    return [
        (_GAP + _GAP.join(words[i : i + size]) + _GAP).encode("utf-8", "surrogatepass")
        for i in range(0, max(1, len(words)), size)
    ]


def training_rows(docs: DataFrame, labels: DataFrame, options: ToxicityOptions) -> DataFrame:
    """``(doc_id, text, toxic)`` of the sampled labels, written once; the options bound them.

    An id counts once: as toxic if any of its labels says so, with one of its texts.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id"))
    )
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {1: options.toxic_rows, 0: options.ordinary_rows}
    share = F.when(F.col("toxic") == 1, most[1] / max(1, sizes.get(1, 0))).otherwise(
        most[0] / max(1, sizes.get(0, 0))
    )
    chosen = usable.filter(common.sample_share(F.col("doc_id"), "toxicity") < share)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")
    return cut_lineage(texts.dropDuplicates(["doc_id"]))


def evidence(k: float, o: float, toxic_total: float, ordinary_total: float) -> float:
    """Likelihood-ratio statistic for a unit seen more often in toxic text, else 0."""
    if not k or k * ordinary_total <= o * toxic_total:
        return 0.0
    both = (k + o) / (toxic_total + ordinary_total)
    return 2 * (k * math.log(k / (both * toxic_total))
                + (o * math.log(o / (both * ordinary_total)) if o else 0.0))


def contrast_vocabulary(rows: DataFrame, options: ToxicityOptions) -> list[str]:
    """Toxic words and word beginnings, weakest first, as many as the dictionary holds."""

    types = (pa.int32(), pa.string(), pa.int64())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(),
                                   strict=True):
                words = words_of(text)
                seen.update(
                    (toxic, w, xxhash.xxh64_intdigest(p) >> 1)
                    for p, w in zip(["", *words], words) if len(w) >= _PREFIXES[0]
                )
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*seen, strict=True), types, strict=True)],
                    names=["toxic", "word", "before"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[set, set]] = {}
        totals = [set(), set()]
        for batch in batches:
            for toxic, word, before in zip(*[batch.column(c).to_pylist() for c in
                                             ("toxic", "word", "before")], strict=True):
                totals[toxic].add((word, before))
                for unit in [word, *[word[:k] for k in _PREFIXES if len(word) > k]]:
                    seen.setdefault(unit, (set(), set()))[toxic].add(before)
        found = [(u, len(t), len(o)) for u, (o, t) in seen.items() if len(t) >= 3 and len(t) > len(o)]
        found.append(("", len(totals[1]), len(totals[0])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*found, strict=True)], names=["unit", "toxic", "ordinary"]
        )

    counted = (
        rows.select("text", "toxic").transform(map_in_arrow, pairs, "toxic int, word string, before long")
        .repartition(4, F.substring("word", 1, _PREFIXES[0]))
        .transform(map_in_arrow, count, "unit string, toxic long, ordinary long").collect()
    )
    toxic_total = sum(r["toxic"] for r in counted if not r["unit"])
    ordinary_total = sum(r["ordinary"] for r in counted if not r["unit"])
    scored: dict[str, tuple[float, int]] = {}
    for r in counted:
        if r["unit"]:
            g = evidence(r["toxic"], r["ordinary"], toxic_total, ordinary_total)
            rare = r["toxic"] * ordinary_total > options.min_ratio * r["ordinary"] * toxic_total
            if g > options.min_evidence and rare:
                scored[r["unit"]] = (g, r["toxic"])
    chosen, size = [], 0
    for unit in sorted(essential(scored), key=lambda u: (-scored[u][0], u)):
        size += len(unit.encode("utf-8", "surrogatepass")) + len(_GAP)
        if size > options.vocabulary_bytes:
            break
        chosen.append(unit)
    return chosen[::-1]


def essential(scored: dict[str, tuple[float, int]], slack: float = 1.2) -> list[str]:
    """Of units on one stem the ones that carry the evidence.

    A beginning that many words share speaks for all of them, and their ordinary endings stay out of
    the dictionary; a beginning that only one word has gives way to the whole word.
    """
    dropped = set()
    for unit, (_, n) in scored.items():
        for k in _PREFIXES:
            stem = unit[:k]
            if len(unit) > k and stem in scored:
                dropped.add(unit if scored[stem][1] > slack * n else stem)
    return [u for u in scored if u not in dropped]


def ordinary_windows(rows: DataFrame, options: ToxicityOptions) -> list[bytes]:
    """Hash-chosen windows of ordinary training texts: one half to train on, one to compare with."""
    size, wanted = options.window_words, 2 * options.dictionary_samples

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {w for t in batch.column("text").to_pylist() for w in windows(t, size)}
            ranks = {xxhash.xxh64_intdigest(w, 1) >> 1: w for w in made}
            least = sorted(ranks)[:wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array(least, pa.int64()), pa.array([ranks[r] for r in least], pa.binary())],
                names=["rank", "piece"],
            )

    chosen = (
        rows.filter("toxic = 0").select("text").transform(map_in_arrow, cut, "rank long, piece binary")
        .distinct().orderBy("rank").limit(wanted).collect()
    )
    return [bytes(r["piece"]) for r in chosen]


def trained_dictionary(pieces: list[bytes], options: ToxicityOptions) -> bytes:
    """Content of a dictionary trained on windows; too few windows are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(options.dictionary_bytes, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)


def quietest_fill(ordinary: bytes, vocabulary: list[str], pieces: list[bytes], options: ToxicityOptions) -> int:
    """The filling byte under which ordinary windows differ least between the dictionaries.

    The vocabulary takes some hash slots of the ordinary content; which ones depends on that byte.
    """
    def noise(fill: int) -> int:
        distance = Distance(ordinary, vocabulary, fill, options)
        return sum(abs(distance.difference(p)) for p in pieces)

    return min(_FILLS, key=noise)


def counter_vocabulary(rows: DataFrame, vocabulary: list[str], options: ToxicityOptions) -> bytes:
    """Ordinary words on the stem of a unit but without the unit itself, for both dictionaries."""
    stems = {u[: _PREFIXES[0]] for u in vocabulary}
    units, sizes = set(vocabulary), sorted({len(u) for u in vocabulary})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {
                w for t in batch.column("text").to_pylist() for w in words_of(t)
                if w[: _PREFIXES[0]] in stems and not any(w[:k] in units for k in sizes)
            }
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    chosen = (
        rows.filter("toxic = 0").select("text").transform(map_in_arrow, pick, "word string").groupBy("word")
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word")
        .limit(options.counter_words).collect()
    )
    return "".join(_GAP + r["word"] for r in reversed(chosen)).encode("utf-8", "surrogatepass")


class Distance:
    """Length differences of windows under the two dictionaries; one instance per task."""

    def __init__(self, ordinary: bytes, vocabulary: list[str], fill: int, options: ToxicityOptions) -> None:
        self.options = options
        gap = bytes([fill])
        # Units are parted by a byte that no text has, so that only beginnings of words match.
        toxic = gap.join([b"", *[(_GAP + u).encode("utf-8", "surrogatepass") for u in vocabulary]])
        toxic += gap * 16  # The compressor does not index the last bytes of a dictionary.
        # The vocabulary comes last: nearest, and first where two positions share a hash slot.
        self.ordinary = self._compressor(ordinary + gap * len(toxic))
        self.toxic = self._compressor(ordinary + toxic)

    @staticmethod
    def _compressor(content: bytes):
        parameters = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=18, strategy=zstandard.STRATEGY_FAST, min_match=7, target_length=1,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)

    def difference(self, window: bytes) -> int:
        return len(self.ordinary.compress(window)) - len(self.toxic.compress(window))

    def features(self, text: str | None) -> tuple[float, float, float]:
        lengths = [self.difference(w) for w in windows(text, self.options.window_words)]
        top = sorted(lengths)[-3:]
        return (
            sum(lengths) / len(lengths), sum(top) / len(top),
            math.log1p(sum(d - 1 for d in lengths if d > 1)),
        )


def fit_logistic(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, float]:
    """Weights (with a ridge of 1) and offset, shifted so that the best F1 cut has ``threshold``.

    A cut must be right more often than not; without such a cut the plain probability stays.
    """
    scale = np.maximum(x.std(axis=0), 1e-9)
    design = np.column_stack([x / scale, np.ones(len(x))])
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - ridge @ w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge
        move = np.linalg.solve(hessian, gradient)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    logit = design @ w
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    # Only the last of equal logits is a possible cut.
    f1[:-1][logit[order][:-1] == logit[order][1:]] = -1
    f1[2 * hits <= np.arange(1, len(y) + 1)] = -1
    best = int(f1.argmax())
    if f1[best] < 0:
        return w[:-1] / scale, float(w[-1])
    below = logit[order][best + 1] if best + 1 < len(y) else logit[order][best] - 1.0
    cut = (logit[order][best] + below) / 2
    return w[:-1] / scale, float(w[-1] - cut + math.log(threshold / (1 - threshold)))


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    vocabulary: list[str]
    fill: int
    weights: np.ndarray
    offset: float


def train(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> Model | None:
    """Dictionaries and calibration; None without training rows of both kinds."""
    rows = training_rows(docs, labels, options)
    pieces = ordinary_windows(rows, options)
    vocabulary = contrast_vocabulary(rows, options)
    ordinary = trained_dictionary(pieces[::2], options) + counter_vocabulary(rows, vocabulary, options)
    fill = quietest_fill(ordinary, vocabulary, pieces[1::2], options)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(ordinary, vocabulary, fill, options)
        for batch in batches:
            made = np.array([distance.features(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), *[pa.array(c) for c in made.reshape(-1, 3).T]],
                names=["toxic", "a", "b", "c"],
            )

    found = rows.select("text", "toxic").transform(
        map_in_arrow, measure, "toxic int, a double, b double, c double"
    ).collect()
    y = np.array([r["toxic"] for r in found], dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([(r["a"], r["b"], r["c"]) for r in found])
    order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], y))
    return Model(ordinary, vocabulary, fill, *fit_logistic(x[order], y[order], options.threshold))


def score(docs: DataFrame, model: Model | None, options: ToxicityOptions = ToxicityOptions(),
          text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the calibrated toxicity score."""
    shared = docs.sparkSession.sparkContext.broadcast((model, options))

    def start():
        own, opts = shared.value
        distance = Distance(own.ordinary, own.vocabulary, own.fill, opts) if own is not None else None

        def compute(columns, rows):
            if distance is None:
                return [np.zeros(rows)]
            made = np.array([distance.features(t) for t in columns[text].to_pylist()]).reshape(-1, 3)
            logit = np.clip(made @ own.weights + own.offset, -40, 40)
            return [1 / (1 + np.exp(-logit))]

        return compute

    return common.append_columns(docs, f"`{output}` double", start, (text,))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    options = ToxicityOptions()
    model = train(docs, common.table(spark, sf_dir, "labels"), options)
    return score(docs.select("doc_id", "text"), model, options).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= options.threshold).cast("int").alias("predicted"),
    )
