"""Quality rules as a short-circuit cascade.

Every rule rejects a text or lets it pass. On a bounded, hash-chosen sample one task measures each
rule's time and how many texts it rejects; the rules then run in order of rejections per second, and
a text leaves the cascade at its first rejection. The order changes the time, never the verdict,
since a text is kept only if no rule rejects it.

A null text counts as empty (no words) and is rejected. Words are runs of anything but space, tab and
the line controls U+0009 to U+000D. Whole texts are measured; repeated rows repeat their result. An
empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_in_arrow
from . import common

_SPACES = " \t\n\x0b\x0c\r"
_BYTE_SPACES = _SPACES.encode()
_SYMBOLS = "#*$%&|<>"


class _Codes(dict):
    def __missing__(self, word):
        self[word] = code = len(self)
        return code


class Text:
    """A text's measures, each computed when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(_BYTE_SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words - 2
        if n < 2:
            return 0
        codes = _Codes()
        c = np.fromiter(map(codes.__getitem__, self.words), dtype=np.int64, count=n + 2)
        m = len(codes)
        keys = c[:-2] * m + c[1:-1]
        if m > 2_000_000:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * m + c[2:]
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        equal = ranked[1:] == ranked[:-1]
        if not equal.any():
            return 0
        twice = order[np.r_[equal, False] | np.r_[False, equal]]
        covered = np.zeros(n + 2, dtype=bool)
        for k in range(3):
            covered[twice + k] = True
        return int(covered.sum())

    @cached_property
    def lettered_words(self) -> int:
        return sum(1 for w in self.text.split() if any(map(str.isalpha, w)))

    @cached_property
    def shouted_words(self) -> int:
        return sum(map(str.isupper, self.text.split()))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


# --- parameters: base rules of the contract ------------------------------------------------------
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
# --- parameters: the other rules -----------------------------------------------------------------
MORE_RULES = (
    Rule("symbols", lambda t: 4 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 7 * len(t.lines)),
    Rule("unlettered_words", lambda t: 2 * t.lettered_words < t.n_words),
    Rule("shouting", lambda t: 2 * t.shouted_words > t.n_words),
)
RULES = BASE_RULES + MORE_RULES


def estimate(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[dict]:
    """Per rule: seconds and rejections on about ``sample_rows`` texts, best rejection per cost first."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, rows = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                rows += 1
                for i, rule in enumerate(rules):
                    fresh = Text(text)
                    began = time.perf_counter()
                    hits[i] += rule.rejects(fresh)
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.name for r in rules]), pa.array(spent), pa.array(hits, pa.int64()),
             pa.array([rows] * len(rules), pa.int64())],
            names=["rule", "seconds", "rejected", "rows"],
        )

    total = df.count()
    share = min(1.0, sample_rows / max(1, total))
    sample = df.filter(common.sample_share(F.col("doc_id"), "quality") < share).select("text")
    found = sample.repartition(1).transform(
        map_in_arrow, measure, "rule string, seconds double, rejected long, rows long"
    ).collect()
    by_rule = {r["rule"]: r.asDict() for r in found}
    place = {r.name: i for i, r in enumerate(rules)}
    listed = [by_rule.get(r.name, {"rule": r.name, "seconds": 0.0, "rejected": 0, "rows": 0}) for r in rules]
    # With no sampled row the given order stays.
    return sorted(
        listed, key=lambda r: (-(r["rejected"] / (r["seconds"] + 1e-9)), place[r["rule"]])
    )


def ordered(rules: tuple[Rule, ...], estimates: list[dict]) -> tuple[Rule, ...]:
    by_name = {r.name: r for r in rules}
    return tuple(by_name[e["rule"]] for e in estimates)


def cascade(df: DataFrame, rules: tuple[Rule, ...], text: str = "text",
            measures: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``kept``, ``rejected_by`` (the first rule that rejected) and ``rules_run``.

    ``measures`` adds long columns of ``Text``; those that a rule computed are not computed again.
    """

    def start():
        def compute(columns, rows):
            kept, by, run = [], [], []
            extra: list[list[int]] = [[] for _ in measures]
            for value in columns[text].to_pylist():
                measured = Text(value)
                hit = None
                for n, rule in enumerate(rules, 1):
                    if rule.rejects(measured):
                        hit = rule.name
                        break
                kept.append(hit is None)
                by.append(hit)
                run.append(n)
                for column, name in zip(extra, measures, strict=True):
                    column.append(getattr(measured, name))
            return [kept, by, run, *extra]

        return compute

    outputs = "kept boolean, rejected_by string, rules_run int" + "".join(
        f", `{m}` long" for m in measures
    )
    return common.append_columns(df, outputs, start, (text,))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = ordered(RULES, estimate(docs))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return cascade(docs, rules, measures=MEASURES).select(
        "doc_id", *MEASURES, failed.alias("base_failed"), "kept"
    )
