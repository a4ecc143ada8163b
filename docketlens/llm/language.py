"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded, hash-chosen sample of labelled rows per language; the log-probability
matrix (languages x buckets) is broadcast, and a run of texts is scored as a sparse matrix in
compressed-row form: each row lists the buckets of one text's n-grams.

Null texts and texts without a letter get ``und`` with score 0. Without any labelled row every text
is ``und``. Ties go to the language that sorts first. Repeated rows are scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_in_arrow
from . import common

UNDETERMINED = "und"
_ODD = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)
_ALPHA = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x10000)), dtype=np.uint8).astype(bool)


@dataclass(frozen=True)
class LanguageOptions:
    """``rows_per_language`` bounds the labelled sample; ``bits`` and ``orders`` fix the features."""

    bits: int = 15
    orders: tuple[int, ...] = (1, 2, 3)
    rows_per_language: int = 4000
    smoothing: float = 0.5
    max_matrix_bytes: int = 512 << 20


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _buckets(points: np.ndarray, starts: int, options: LanguageOptions) -> list[np.ndarray]:
    """Per n-gram order, the bucket of the n-gram at each of the first ``starts`` points."""
    out = []
    for n in options.orders:
        h = np.full(starts, n * 40503, dtype=np.uint32)
        for k in range(n):
            h += points[k : k + starts] * _ODD[k % 4]
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        out.append((h >> np.uint32(32 - options.bits)).astype(np.int32))
    return out


def _points(pieces: list[str]) -> np.ndarray:
    """Code points of the pieces one after the other, everything but letters as a blank."""
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _ALPHA[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    return np.where(letter, points, np.uint32(32))


def _segments(texts: list[str | None], options: LanguageOptions):
    """Runs of (text index, padded piece, number of n-gram starts); long texts are cut."""
    pad = max(options.orders) - 1
    run, size = [], 0
    for i, text in enumerate(texts):
        low = text.lower() if text else ""
        for k in range(0, len(low), common.RUN_CHARS):
            n = min(common.RUN_CHARS, len(low) - k)
            piece = low[k : k + n + pad]
            run.append((i, piece + " " * (n + pad - len(piece)), n))
            size += n
            if size >= common.RUN_CHARS:
                yield run
                run, size = [], 0
    if run:
        yield run


def _sparse_rows(texts: list[str | None], options: LanguageOptions):
    """Per run: text indexes, row bounds and, per order, the bucket of each point."""
    for run in _segments(texts, options):
        points = _points([piece for _, piece, _ in run])
        pad = max(options.orders) - 1
        lengths = np.array([n for _, _, n in run], dtype=np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths + pad)[:-1]))
        padded = np.concatenate((points, np.full(pad + 1, 32, dtype=np.uint32)))
        yield [i for i, _, _ in run], begins, begins + lengths, _buckets(padded, len(points), options)


class Scorer:
    """Log-probability rows of the languages, applied to runs of texts."""

    def __init__(self, languages: list[str], matrix: np.ndarray, priors: np.ndarray,
                 options: LanguageOptions) -> None:
        self.languages, self.matrix, self.priors, self.options = languages, matrix, priors, options

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        total = np.tile(self.priors, (len(texts), 1))
        for owners, begins, ends, orders in _sparse_rows(texts, self.options):
            cuts = np.column_stack((begins, ends)).ravel()
            for buckets in orders:
                buckets = np.append(buckets, np.int32(0))
                for j, row in enumerate(self.matrix):
                    sums = np.add.reduceat(row[buckets], cuts, dtype=np.float64)[::2]
                    np.add.at(total[:, j], owners, sums)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        named = np.array([bool(t) and _has_letter(t) for t in texts], dtype=bool)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        odds = self.log_odds([t if ok else None for t, ok in zip(texts, named, strict=True)])
        best = odds.argmax(axis=1) if len(texts) else np.zeros(0, dtype=int)
        share = 1.0 / np.exp(odds - odds.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, named, strict=True)]
        return names, np.where(named, share, 0.0)


def labelled_sample(df: DataFrame, options: LanguageOptions) -> DataFrame:
    """About ``rows_per_language`` rows of each language, drawn row by row.

    The languages' row counts reach the driver (the matrix bound limits them), so that no text is
    shuffled by its language.
    """
    labelled = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = options.max_matrix_bytes // (4 << options.bits)
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError("the log-probability matrix of so many languages is too large to broadcast")
    if not sizes:
        return labelled.select("lang", "text").limit(0)
    shares = F.create_map(*[
        F.lit(x) for r in sizes for x in (r["lang"], options.rows_per_language / r["rows"])
    ])
    return labelled.filter(
        common.sample_share(F.col("doc_id"), "language") < F.try_element_at(shares, F.col("lang"))
    ).select("lang", "text")


def train(df: DataFrame, options: LanguageOptions = LanguageOptions()) -> Scorer:
    """Fit on ``(doc_id, text, lang)`` rows; what reaches the driver is one count vector per language.

    A language's sampled rows are bounded, so one task counts all of them.
    """
    width = 1 << options.bits

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                counts = totals.setdefault(lang, np.zeros(width, dtype=np.int64))
                rows[lang] = rows.get(lang, 0) + len(own)
                for _, begins, ends, orders in _sparse_rows(own, options):
                    inside = np.zeros(len(orders[0]) + 1, dtype=np.int8)
                    np.add.at(inside, begins, 1)
                    np.add.at(inside, ends, -1)
                    inside = np.cumsum(inside[:-1]) > 0
                    for buckets in orders:
                        counts += np.bincount(buckets[inside], minlength=width)
        langs = list(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array([rows[x] for x in langs], pa.int64()),
             pa.array([totals[x].tobytes() for x in langs], pa.binary())],
            names=["lang", "rows", "counts"],
        )

    parts = (
        labelled_sample(df, options).repartition(16, "lang")
        .transform(map_in_arrow, count, "lang string, rows long, counts binary").collect()
    )
    languages = sorted({r["lang"] for r in parts})
    counts = np.zeros((len(languages), width))
    rows = np.zeros(len(languages))
    for r in parts:
        counts[languages.index(r["lang"])] += np.frombuffer(r["counts"], dtype=np.int64)
        rows[languages.index(r["lang"])] += r["rows"]
    smooth = counts + options.smoothing
    matrix = np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))
    blank = np.full(max(options.orders) * 2, 32, dtype=np.uint32)
    for buckets in _buckets(blank, 1, options):
        matrix[:, buckets[0]] = 0.0
    # Every language has about the same number of sampled rows, so the prior is flat.
    priors = np.full(len(languages), -np.log(max(1, len(languages))))
    return Scorer(languages, matrix.astype(np.float32), priors, options)


def identify(df: DataFrame, scorer: Scorer, text: str = "text",
             outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the predicted language and its posterior share."""
    shared = df.sparkSession.sparkContext.broadcast(
        (scorer.languages, scorer.matrix, scorer.priors, scorer.options)
    )

    def start():
        own = Scorer(*shared.value)

        def compute(columns, rows):
            names, shares = own.predict(columns[text].to_pylist())
            return [names, shares]

        return compute

    name, share = outputs
    return common.append_columns(df, f"`{name}` string, `{share}` double", start, (text,))


def learnable(df: DataFrame) -> DataFrame:
    """The rows that a model may learn from."""
    return df.select("doc_id", "text", "lang").filter(~common.held_out(F.col("doc_id")))


def is_kept(name: Column, share: Column, minimum: float = 0.5) -> Column:
    """A document stays if a language was found and holds most of the probability."""
    return (name != UNDETERMINED) & (share >= minimum)


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language was found; all rows if there is nothing to learn from."""
    scorer = train(learnable(docs))
    if not scorer.languages:
        return docs
    name, share = common.free_name(docs, "__lang"), common.free_name(docs, "__share")
    found = identify(docs, scorer, outputs=(name, share))
    return found.filter(is_kept(F.col(name), F.col(share))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scorer = train(learnable(docs))
    return identify(docs.select("doc_id", "text"), scorer).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
