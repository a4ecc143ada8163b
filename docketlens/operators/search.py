"""Filters, scopes, paging and facets over meetings and documents.

Every filter is a column predicate or a semi join, so it reaches the scan or the join; nothing is
collected. Document rows carry ``companies``, ``specifications``, ``releases`` and ``work_items`` arrays
(see ``document_records``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text


@dataclass(frozen=True)
class TemporalScope:
    """At most one of: named meetings, the last ``last_k`` meetings, months, or a date interval."""

    meeting_ids: tuple[str, ...] = ()
    last_k: int | None = None
    last_months: int | None = None
    starts: str | None = None
    ends: str | None = None

    def __post_init__(self) -> None:
        chosen = [bool(self.meeting_ids), self.last_k is not None, self.last_months is not None,
                  self.starts is not None or self.ends is not None]
        if sum(chosen) > 1:
            raise ValueError("choose one temporal selector")
        if self.starts and self.ends and self.starts > self.ends:
            raise ValueError("the interval must start before it ends")


def active_version(versions: DataFrame, preview: str | None = None) -> str:
    """The previewed version, else the active one; neither is an error. Reads one row."""
    wanted = F.col("is_active") if preview is None else F.col("id") == preview
    found = versions.filter(wanted).select("id").orderBy("id").head(1)
    if not found:
        raise ValueError("there is no such dataset version")
    return found[0]["id"]



def meeting_order() -> list[Column]:
    return [F.desc_nulls_last("ends_on"), F.desc("number"), F.asc("id")]


def meetings_in(meetings: DataFrame, scope: TemporalScope = TemporalScope(),
                groups: tuple[str, ...] = (), as_of: str | None = None) -> DataFrame:
    """Meetings of the groups and the temporal scope; months have 31 days and end at ``as_of``."""
    found = meetings.filter(F.col("working_group_id").isin(*groups)) if groups else meetings
    if scope.meeting_ids:
        found = found.filter(F.col("id").isin(*scope.meeting_ids))
    if scope.last_months is not None:
        found = found.filter(F.col("ends_on") >= F.date_sub(F.lit(as_of).cast("date"), 31 * scope.last_months))
    if scope.starts is not None:
        found = found.filter(F.col("ends_on") >= F.lit(scope.starts).cast("date"))
    if scope.ends is not None:
        found = found.filter(F.col("starts_on") <= F.lit(scope.ends).cast("date"))
    if scope.last_k is not None:
        found = found.orderBy(*meeting_order()).limit(scope.last_k)
    return found


def undated(meetings: DataFrame) -> DataFrame:
    return meetings.filter(F.col("starts_on").isNull() | F.col("ends_on").isNull())


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page with ``has_more``, known from a single row of look-ahead."""
    ahead = rows.orderBy(*order).offset(offset).limit(limit + 1)
    place = F.row_number().over(W.orderBy(*order))
    return (
        ahead.withColumn("_place", place)
        .withColumn("has_more", F.count(F.lit(1)).over(W.partitionBy()) > limit)
        .filter(F.col("_place") <= limit).drop("_place")
    )


def document_records(raw: DataFrame) -> DataFrame:
    """Raw spreadsheet fields to document records with normalised status and list columns."""
    return raw.withColumns({
        "status": text.normalize_status(F.col("status_raw")),
        "companies": F.array_distinct(text.organizations(F.col("source"))),
        "specifications": text.split_multi_value(F.col("specifications_text")),
        "releases": text.split_multi_value(F.col("releases_text")),
        "work_items": text.split_multi_value(F.col("work_items_text")),
    })


def with_text(columns: list[str], needle: str, mode: str = "fields") -> Column:
    """Case-insensitive literal search in any of the columns, or in all of them joined."""
    low = F.lit(needle.strip().lower())
    if mode == "concat":
        return F.contains(F.lower(F.concat_ws(" ", *columns)), low)
    return reduce(lambda a, b: a | b,
                  [F.coalesce(F.contains(F.lower(F.col(c)), low), F.lit(False)) for c in columns])


def combined(tests: list[Column], match: str) -> Column:
    """All or any of the tests; no test lets everything through."""
    if not tests:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if match == "all" else (lambda a, b: a | b), tests)


def with_substrings(companies: tuple[str, ...] = (), releases: tuple[str, ...] = (),
                    specifications: tuple[str, ...] = (), topics: tuple[str, ...] = (),
                    match: str = "all") -> Column:
    """Substring facets, each on its own column."""
    tests = [F.contains(F.lower("source"), F.lit(c.lower())) for c in companies]
    tests += [text.list_contains_text(F.col("releases"), r) for r in releases]
    tests += [text.list_contains_text(F.col("specifications"), s) for s in specifications]
    tests += [F.contains(F.lower("agenda_description"), F.lit(t.lower())) for t in topics]
    return combined([F.coalesce(t, F.lit(False)) for t in tests], match)


def facet_ids(documents: DataFrame) -> DataFrame:
    """Canonical-id arrays of the three facets."""
    ids = lambda c: F.array_distinct(F.transform(c, text.canonical_identifier))
    topic = F.when(F.coalesce("agenda_description", F.lit("")) != "",
                   F.array(text.canonical_identifier(F.col("agenda_description"))))
    return documents.withColumns({
        "company_ids": ids(F.col("companies")),
        "topic_ids": F.coalesce(topic, F.expr("cast(array() as array<string>)")),
        "specification_ids": ids(F.col("specifications")),
    })


def with_facets(companies: tuple[str, ...] = (), topics: tuple[str, ...] = (),
                specifications: tuple[str, ...] = (), match: str = "all") -> Column:
    """Canonical-id facets over ``facet_ids`` columns."""
    tests = [F.array_contains("company_ids", c) for c in companies]
    tests += [F.array_contains("topic_ids", t) for t in topics]
    tests += [F.array_contains("specification_ids", s) for s in specifications]
    return combined(tests, match)


def of_meetings(documents: DataFrame, meetings: DataFrame) -> DataFrame:
    return documents.join(meetings.select(F.col("id").alias("meeting_id")), "meeting_id", "left_semi")


def decisions() -> Column:
    return F.col("status").isin(*K.DECISION_STATUSES)


def actionable() -> Column:
    return ~F.col("status").isin(*K.NO_ARCHIVE_STATUSES)


def by_id(rows: DataFrame, wanted: str) -> DataFrame:
    """Case-insensitive lookup of one id."""
    return rows.filter(F.lower("id") == wanted.lower())


def scoped_documents(documents: DataFrame, document_ids: tuple[str, ...] = (),
                     meeting_ids: tuple[str, ...] = ()) -> DataFrame:
    """Ids of the named documents and of the meetings' documents; an empty scope stays empty."""
    return documents.filter(
        F.col("id").isin(*document_ids) | F.col("meeting_id").isin(*meeting_ids)
    ).select("id").distinct()


def facet_options(documents: DataFrame, labels: Column, needle: str, limit: int) -> DataFrame:
    """Options of one facet: id, first label, number of documents; exact, prefix, then other matches.

    ``labels`` is an array column; ``seq`` orders documents for the first label.
    """
    low = needle.strip().lower()
    each = documents.select(
        "id", "seq", F.explode(F.array_distinct(F.filter(F.transform(labels, text.strip),
                                                         lambda v: v != ""))).alias("label")
    ).withColumn("option", text.canonical_identifier(F.col("label")))
    options = each.groupBy("option").agg(
        F.min_by("label", F.struct("seq", "label")).alias("label"),
        F.count_distinct("id").alias("tdoc_count"),
    )
    shown = F.lower("label")
    rank = (
        F.when((shown == low) & F.lit(low != ""), 0).when(F.startswith(shown, F.lit(low)), 1).otherwise(2)
    )
    return (
        options.filter(F.contains(shown, F.lit(low)))
        .orderBy(rank, F.desc("tdoc_count"), shown, "option").limit(limit)
        .select(F.col("option").alias("id"), "label", "tdoc_count")
    )


def with_counts(meetings: DataFrame, documents: DataFrame) -> DataFrame:
    """Meetings with their number of documents, 0 if none."""
    counts = documents.groupBy(F.col("meeting_id").alias("id")).agg(F.count(F.lit(1)).alias("tdoc_count"))
    return meetings.join(counts, "id", "left").withColumn(
        "tdoc_count", F.coalesce("tdoc_count", F.lit(0).cast("long"))
    )


def counted(values: DataFrame, column: str, name: str) -> DataFrame:
    return values.groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def most_common(values: DataFrame, keys: list[str], column: str, limit: int) -> DataFrame:
    """The ``limit`` most frequent values per key; ties go to the value seen first (``seq``)."""
    counts = values.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    order = W.partitionBy(*keys).orderBy(F.desc("n"), "first", column)
    return (
        counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
        .drop("first")
    )


def grouped_decisions(documents: DataFrame) -> DataFrame:
    """Decided documents with their place within meeting and status, in order of ``seq``.

    Rows instead of lists, so a meeting of any size stays a sorted stream of rows.
    """
    order = W.partitionBy("meeting_id", "status").orderBy("seq", "id")
    return documents.filter(decisions()).select(
        "meeting_id", "status", F.row_number().over(order).alias("place"), "id"
    )


def ordered_evidence(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct ``evidence_id`` values per key with the place of their first occurrence."""
    first = rows.groupBy(key, "evidence_id").agg(F.min(order).alias("_first"))
    place = F.row_number().over(W.partitionBy(key).orderBy("_first", "evidence_id"))
    return first.select(key, "evidence_id", place.alias("place"))


def traced(documents: DataFrame, meetings: DataFrame, columns: list[str], topic: str) -> DataFrame:
    """Per meeting the number of documents on a topic: ``id, ends_on, n``."""
    hits = documents.filter(with_text(columns, topic)).groupBy(F.col("meeting_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return meetings.select("id", "ends_on").join(hits, "id")


def after_row(order: list[tuple[str, bool]], last: dict) -> Column:
    """Rows that come behind ``last`` in ``order``: pairs of column and whether it descends; nulls come last.

    The columns must tell all rows apart, else rows equal to ``last`` are left out.
    """
    out = F.lit(False)
    for name, descending in reversed(order):
        value, known = F.col(name), last[name]
        if known is None:
            out = value.isNull() & out
            continue
        beyond = value < F.lit(known) if descending else value > F.lit(known)
        out = value.isNull() | beyond | ((value == F.lit(known)) & out)
    return F.coalesce(out, F.lit(False))


def keyset_page(rows: DataFrame, order: list[tuple[str, bool]], size: int, last: dict | None = None) -> DataFrame:
    """The ``size`` rows of ``order`` that follow ``last`` (the key of the page before), with ``has_more``.

    Seeking by key costs the same for every page: no row before it is sorted or counted, and the best rows are
    kept per task.
    """
    rest = rows if last is None else rows.filter(after_row(order, last))
    keys = [F.desc_nulls_last(n) if descending else F.asc_nulls_last(n) for n, descending in order]
    ahead = rest.orderBy(*keys).limit(size + 1)
    place = F.row_number().over(W.orderBy(*keys))  # of at most size + 1 rows
    numbered = ahead.withColumn("_place", place).withColumn("has_more", F.max("_place").over(W.partitionBy()) > size)
    return numbered.filter(F.col("_place") <= size).drop("_place")
