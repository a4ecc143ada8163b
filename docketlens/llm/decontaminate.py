"""Benchmark decontamination by template canonicalisation.

Every text becomes a sequence of template tokens: numbers, units after a number and capitalised
words inside a sentence turn into typed placeholders, other words are lower-cased and stripped of
outer punctuation, bare punctuation is dropped. Windows of five template tokens are hash-joined
between documents and benchmark items. On one alignment each slot (the value behind a placeholder)
of the item must stand for one value of the document; several may stand for the same. A window that
changes a slot with more than one value does not count, the other windows of the alignment do: as
``exact`` if all values of their alignments are equal and as ``reparameterised`` if some differ.

Window hashes of the documents first meet a bitmap of the benchmark's hashes, whose size is bounded
(``max_bits``), so only windows that very likely match are shuffled; the join then compares hash
and template text, so the bitmap never decides. Beyond its bound the bitmap only lets more through.

An item counts from half of its windows on (``min_coverage``), an item of few windows (``few_windows``) only
if all of them match, since one generic window is no copy of it.

Windows need ``min_literals`` words that are no placeholders; an item shorter than the window is one
window of its own length. An item with at most one such window is also looked for word by word: its plain
windows (lower-cased words, no placeholders, no minimum) are joined in the same way, and the better of
the two coverages counts. A line break may start a sentence or not, so a capitalised word after it is
read both as a word and as a name. Null and empty texts have no windows. Each row is judged by itself, also among
rows that share a ``doc_id`` or have none. Repeated items are reported one by one. An empty benchmark or an
empty corpus gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, map_in_arrow
from . import common

NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet g kg mg lb lbs "
    "oz ton tons gram grams ml l liter liters litre litres s sec min h hr hour hours day days week "
    "weeks month months year years minute minutes second seconds usd eur gbp dollar dollars cent "
    "cents euro euros pound pounds percent degrees hz khz mhz ghz w kw v volts kb mb gb tb mph kmh "
    "kph km/h m/s".split()
)
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»…–—¿¡"
_ENDS = (".", "!", "?", ":", ";")
#: Stands for a line break among the tokens of a text; bare punctuation, so it is dropped later.
_LINE = "¿¡."
#: Before the words of a plain window; no template has such a token.
_PLAIN = "= "
LITERAL, NUMBER, CAPITAL, UNIT, EMPTY = range(5)
_PRIME = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class TemplateOptions:
    window: int = 5
    min_literals: int = 3
    min_coverage: float = 0.5
    #: An item of at most so many windows counts only if all of them match.
    few_windows: int = 3
    max_bits: int = 27
    vocabulary: int = 1 << 19


def _word_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text, 7)


PLACEHOLDER = {NUMBER: "<num>", CAPITAL: "<name>", UNIT: "<unit>"}
_PLACE_HASH = np.array(
    [0] + [_word_hash(PLACEHOLDER[k]) for k in (NUMBER, CAPITAL, UNIT)] + [0], dtype=np.uint64
)


class _Words(dict):
    """Raw token -> code, with the attributes of each code in growing arrays."""

    def __init__(self) -> None:
        self.kind, self.ends, self.hash = array("B"), array("B"), array("Q")
        self.core: list[str] = []

    def __missing__(self, raw: str) -> int:
        core = raw.strip(_EDGES)
        low = core.lower()
        if not core:
            kind = EMPTY
        elif core[0].isdigit() or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif core[0].isupper() and not (len(core) > 1 and core.isupper()):
            kind = CAPITAL
        else:
            kind = LITERAL
        tail = raw.rstrip("\"')]}”’»*#%&$")
        self.kind.append(kind)
        self.ends.append(raw != _LINE and tail.endswith(_ENDS))
        self.hash.append(_word_hash(low))
        self.core.append(low)
        self[raw] = code = len(self.core) - 1
        return code


def _hashed(tokens: np.ndarray, good: np.ndarray, size: int, seed: np.uint64, wanted) -> tuple:
    """Starts of the ``good`` windows that are ``wanted``, and their hashes."""
    n = len(good)
    every = 2 * np.count_nonzero(good) > n
    at = np.arange(n) if every else np.flatnonzero(good)
    h = np.full(len(at), seed, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(_PRIME) + (tokens[k : k + n] if every else tokens[at + k])
    h ^= h >> np.uint64(32)
    h *= np.uint64(_PRIME)
    kept = good[at]
    if wanted is not None:
        kept = kept & wanted(h)
    return at[kept], h[kept]


class Templates:
    """Template windows of ``sizes`` and plain windows of ``plain_sizes``; one instance per task."""

    def __init__(self, options: TemplateOptions, sizes: list[int], plain_sizes: list[int] = ()) -> None:
        self.options, self.sizes, self.plain_sizes, self.words = options, sizes, plain_sizes, _Words()

    def windows(self, texts: list[str | None], wanted=None):
        """Per text run and window size: (text index, position, hash, maker of (template, slots)).

        ``wanted`` maps an array of hashes to a mask of those worth keeping.
        """
        if len(self.words) > self.options.vocabulary:
            self.words = _Words()
        words = self.words
        for a, b in common.runs_of([len(t) if t else 0 for t in texts]):
            line = words[_LINE]
            parts = [
                np.fromiter(map(words.__getitem__, raw), dtype=np.int64, count=len(raw))
                for raw in (f" {_LINE} ".join((t or "").splitlines()).split() for t in texts[a:b])
            ]
            codes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            if not len(codes):
                continue
            owner = np.repeat(np.arange(a, b), [len(p) for p in parts])
            kinds = np.frombuffer(words.kind, dtype=np.uint8)[codes]
            ends = np.frombuffer(words.ends, dtype=np.uint8)[codes].astype(bool)
            starts = np.r_[True, ends[:-1] | (owner[1:] != owner[:-1])]
            full = kinds != EMPTY
            broken = np.r_[False, codes[:-1] == line]
            full = kinds != EMPTY
            # A dropped token passes its sentence end or line break on to the word after it.
            opened, lines = np.cumsum(starts), np.cumsum(starts | broken)
            codes, kinds, owner, opened, lines = (x[full] for x in (codes, kinds, owner, opened, lines))
            if not len(codes):
                continue
            fresh = np.r_[True, opened[1:] != opened[:-1]]
            after_line = np.r_[True, lines[1:] != lines[:-1]]
            after_number = np.r_[False, (kinds[:-1] == NUMBER) & (owner[1:] == owner[:-1])]
            either = (kinds == CAPITAL) & after_line & ~fresh
            kinds = np.where((kinds == CAPITAL) & after_line, LITERAL, kinds)
            kinds = np.where((kinds == UNIT) & ~after_number, LITERAL, kinds)
            plain = np.frombuffer(words.hash, dtype=np.uint64)[codes]
            readings = [(kinds, None)]
            if either.any():
                readings.append((np.where(either, CAPITAL, kinds), np.r_[0, np.cumsum(either)]))
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            for read, other in readings:
                hashes = np.where(read == LITERAL, plain, _PLACE_HASH[read])
                literal = np.r_[0, np.cumsum(read == LITERAL)]
                for size in self.sizes:
                    n = len(codes) - size + 1
                    if n <= 0:
                        continue
                    good = (owner[:n] == owner[size - 1 :]) & (
                        literal[size:] - literal[:n] >= self.options.min_literals
                    )
                    if other is not None:
                        good &= other[size:] > other[:n]
                    at, h = _hashed(hashes, good, size, np.uint64(size), wanted)

                    def show(i, size=size, codes=codes, read=read):
                        pairs = list(zip(codes[i : i + size].tolist(), read[i : i + size].tolist(),
                                         strict=True))
                        template = " ".join(PLACEHOLDER.get(k) or words.core[c] for c, k in pairs)
                        slots = "\x1f".join(words.core[c] for c, k in pairs if k != LITERAL)
                        return template, slots

                    if len(at):
                        yield owner[at], place[at], h, [show(int(i)) for i in at]
            for size in self.plain_sizes:
                n = len(codes) - size + 1
                if n <= 0:
                    continue
                at, h = _hashed(plain, owner[:n] == owner[size - 1 :], size, ~np.uint64(size), wanted)
                shown = [(_PLAIN + " ".join(words.core[c] for c in codes[i : i + size].tolist()), "")
                         for i in at.tolist()]
                if wanted is not None:
                    # A text's plain window says the same wherever it stands.
                    once = {(o, t): k for k, (o, (t, _)) in enumerate(zip(owner[at].tolist(), shown, strict=True))}
                    kept = np.array(sorted(once.values()), dtype=np.int64)
                    at, h, shown = at[kept], h[kept], [shown[k] for k in kept]
                if len(at):
                    yield owner[at], place[at], h, shown

    def length(self, text: str | None) -> int:
        return sum(self.words.kind[self.words[w]] != EMPTY for w in (text or "").split())


WINDOW_SCHEMA = "position long, hash long, template string, slots string"


def _window_rows(
    df: DataFrame, options: TemplateOptions, sizes: list[int], plain_sizes: list[int], bitmap=None
) -> DataFrame:
    """``(row, doc_id, text)`` rows to template and plain windows, those outside the bitmap left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Templates(options, sizes, plain_sizes)
        wanted = None
        if bitmap is not None:
            bits, packed = bitmap.value
            filled = np.frombuffer(packed, dtype=np.uint64)

            def wanted(h):
                at = h >> np.uint64(64 - bits)
                return (filled[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            rows, ids = batch.column(common.ROW), batch.column("doc_id")
            for owner, place, h, shown in maker.windows(batch.column("text").to_pylist(), wanted):
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [rows.take(at), ids.take(at), pa.array(place), pa.array(h.view(np.int64)),
                     pa.array([t for t, _ in shown]), pa.array([s for _, s in shown])],
                    names=[common.ROW, "doc_id", "position", "hash", "template", "slots"],
                )

    key = df.select(common.ROW, "doc_id").schema
    return df.transform(map_in_arrow, run, T.StructType(key.fields + T.StructType.fromDDL(WINDOW_SCHEMA).fields))


def item_windows(items: DataFrame, options: TemplateOptions) -> DataFrame:
    """Windows of the items at their own size: full windows, or the whole of a shorter item.

    Items with at most one template window also give their ``plain`` windows.
    """
    full = options.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Templates(options, [full])
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            lengths = [maker.length(t) for t in texts]
            seen: list[set[int]] = [set() for _ in texts]

            def made(own, size, plain):
                maker.sizes, maker.plain_sizes = ([], [size]) if plain else ([size], [])
                for owner, place, h, shown in maker.windows([texts[i] for i in own]):
                    rows = [own[int(i)] for i in owner]
                    for i, at in zip(rows, place.tolist(), strict=True):
                        seen[i].add(at)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows)), pa.array(place), pa.array(h.view(np.int64)),
                         pa.array([t for t, _ in shown]), pa.array([s for _, s in shown]),
                         pa.array([size] * len(place), pa.int32()), pa.array([plain] * len(place))],
                        names=["id", "position", "hash", "template", "slots", "size", "plain"],
                    )

            for size in sorted({min(full, n) for n in lengths} - {0}):
                own = [i for i, n in enumerate(lengths) if min(full, n) == size]
                yield from made(own, size, False)
                few = [i for i in own if len(seen[i]) <= 1]
                yield from made(few, size, True)

    return items.select(F.col("item_id").alias("id"), "text").transform(
        map_in_arrow, run, f"id long, {WINDOW_SCHEMA}, size int, plain boolean"
    )


def _bitmap(windows: DataFrame, options: TemplateOptions) -> tuple[int, bytes]:
    """Packed bits of the benchmark's hashes; at most ``2**max_bits`` bits (16 MB).

    The filled words come to the driver as Arrow columns of 16 bytes a word, so at most twice the bitmap.
    """
    n = windows.count()
    bits = min(options.max_bits, max(16, (64 * n).bit_length()))
    at = F.shiftrightunsigned("hash", 64 - bits)
    words = (
        windows.select(F.shiftrightunsigned(at, 6).alias("word"),
                       F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")
                       .alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("filled")).toArrow()
    )
    packed = np.zeros(1 << (bits - 6), dtype=np.int64)
    packed[words.column("word").to_numpy()] = words.column("filled").to_numpy()
    return bits, packed.tobytes()


def contamination(
    docs: DataFrame, items: DataFrame, options: TemplateOptions = TemplateOptions()
) -> DataFrame:
    """``(doc_id, text)`` against ``(item_id, text)``: one row per contaminated row of ``docs`` and item.

    Columns: ``doc_id, item_id, matched_windows, item_windows, coverage, kind``.
    """
    return _row_contamination(common.with_row(docs.select("doc_id", "text")), items, options).drop(common.ROW)


def _row_contamination(docs: DataFrame, items: DataFrame, options: TemplateOptions) -> DataFrame:
    """``contamination`` of numbered rows, with the row's number."""
    spark = docs.sparkSession
    # Items are told apart by their number, since ids may repeat or be missing.
    numbered = cut_lineage(items.select(F.monotonically_increasing_id().alias("number"), "item_id", "text"))
    bench = cut_lineage(item_windows(numbered.select(F.col("number").alias("item_id"), "text"), options))
    sizes = sorted((r["size"], r["plain"]) for r in bench.select("size", "plain").distinct().collect())
    shared = spark.sparkContext.broadcast(_bitmap(bench, options))
    found = _window_rows(
        docs.select(common.ROW, "doc_id", "text"), options,
        [s for s, plain in sizes if not plain], [s for s, plain in sizes if plain], shared,
    )
    totals = bench.groupBy("id", "plain").agg(F.count_distinct("position").alias("item_windows"))
    joined = found.alias("d").join(
        bench.alias("b"),
        (F.col("d.hash") == F.col("b.hash")) & (F.col("d.template") == F.col("b.template")),
    ).select(
        f"d.{common.ROW}", "d.doc_id", F.col("b.id").alias("number"), "b.plain",
        (F.col("d.position") - F.col("b.position")).alias("alignment"),
        F.col("b.position").alias("position"),
        F.arrays_zip(F.split("b.slots", "\x1f").alias("i"), F.split("d.slots", "\x1f").alias("d"))
        .alias("slots"),
    )
    key = (common.ROW, "doc_id", "number")
    aligned = joined.groupBy(*key, "plain", "alignment").agg(
        F.collect_set(F.struct("position", "slots")).alias("windows")
    )
    pairs = F.array_sort(F.array_distinct(F.flatten(F.transform("windows", lambda w: w["slots"]))))
    # Item values with more than one value in the document: neighbours among the sorted pairs.
    torn = F.transform(
        F.filter("pairs", lambda p, k: (k > 0) & (F.get("pairs", k - 1)["i"] == p["i"])), lambda p: p["i"]
    )
    whole = F.filter("windows", lambda w: F.forall(
        w["slots"], lambda s: (s["i"] == s["d"]) | ~F.array_contains("torn", s["i"])
    ))
    # Both branches read ``torn``, so the optimiser does not move it into the lambda.
    counting = F.when(F.size("torn") == 0, F.col("windows")).otherwise(whole)
    per_item = (
        aligned.withColumn("pairs", pairs).withColumn("torn", torn)
        .withColumn("positions", F.transform(counting, lambda w: w["position"]))
        .withColumn("same", F.forall("pairs", lambda s: s["i"] == s["d"]))
        .filter(F.size("positions") > 0)
        .groupBy(*key, "plain")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("positions")))).cast("long")
            .alias("matched_windows"),
            F.bool_and("same").alias("same"),
        )
    )
    kind = F.when(F.col("best.same"), "exact").otherwise("reparameterised")
    covered = (
        per_item.join(
            totals.select(F.col("id").alias("item"), F.col("plain").alias("of_plain"), "item_windows"),
            (F.col("number") == F.col("item")) & (F.col("plain") == F.col("of_plain")),
        )
        .withColumn("coverage", F.col("matched_windows") / F.col("item_windows"))
        .filter((F.col("coverage") >= options.min_coverage)
                & ((F.col("item_windows") > options.few_windows) | (F.col("coverage") == 1)))
    )
    best = F.max(F.struct("coverage", "same", "matched_windows", "item_windows"))
    judged = covered.groupBy(*key).agg(best.alias("best"))
    return judged.join(numbered.select("number", "item_id"), "number").select(
        common.ROW, "doc_id", "item_id", "best.matched_windows", "best.item_windows", "best.coverage",
        kind.alias("kind"),
    )


def uncontaminated(
    docs: DataFrame, items: DataFrame, options: TemplateOptions = TemplateOptions()
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, whatever their ids."""
    rows = common.with_stored_row(docs, "decontaminate")
    found = _row_contamination(common.columns_of(rows, "doc_id", "text"), items, options)
    hit = found.select(common.ROW).distinct()
    return rows.join(hit, common.ROW, "left_anti").select(f"{common.DOC}.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(
        common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    )
