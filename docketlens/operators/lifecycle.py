"""Dataset lifecycle: artifact choice, reconciliation, coverage, readiness and back-fill."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text
from .search import actionable, undated


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def latest_observation(observations: DataFrame) -> DataFrame:
    """Newest observation per URL; ties by id, so the result is the same on every run."""
    return first_of(observations, ["source_url"], [F.desc("observed_at"), F.desc("event_id")])


def canonical_entries(entries: DataFrame) -> DataFrame:
    """Entries with ``is_canonical``: per document a ``/docs/`` URL first, then the greatest URL."""
    order = [F.desc(F.contains(F.lower("source_url"), F.lit("/docs/"))), F.desc("source_url")]
    place = F.row_number().over(W.partitionBy("document_id").orderBy(*order))
    return entries.withColumn("is_canonical", place == 1)


def chosen_member(members: DataFrame, keys: list[str]) -> DataFrame:
    """The workbook of a package: ``index`` names first, then ``tdoc`` or ``agenda``, then the name."""
    name = F.lower("filename")
    priority = (
        F.when(F.contains(name, F.lit("index")), 2)
        .when(F.contains(name, F.lit("tdoc")) | F.contains(name, F.lit("agenda")), 1).otherwise(0)
    )
    return first_of(members, keys, [F.desc(priority), F.desc(name)])


def chosen_report(reports: DataFrame, keys: list[str]) -> DataFrame:
    """A report without ``skeleton`` if there is one, then the greatest natural key."""
    skeleton = F.contains(F.lower("filename"), F.lit("skeleton"))
    return first_of(reports, keys, [F.asc(skeleton), F.desc(text.natural_key(F.col("filename")))])


def completed_meetings(meetings: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """The latest ``k`` meetings that have a document list and archives, oldest first.

    ``kinds`` has ``meeting_id, kind``.
    """
    have = kinds.groupBy(F.col("meeting_id").alias("id")).agg(
        F.bool_or(F.col("kind") == "tdoc_list").alias("listed"),
        F.bool_or(F.col("kind") == "tdoc").alias("archived"),
    ).filter("listed and archived")
    latest = meetings.join(have.select("id"), "id", "left_semi").orderBy(
        F.desc_nulls_last("ends_on"), F.desc("number")
    ).limit(k)
    return latest.orderBy(F.asc_nulls_first("ends_on"), "number")


def final_ready(reports: DataFrame) -> DataFrame:
    """Per meeting ``final_ready`` if any report is neither draft nor skeleton."""
    return reports.groupBy("meeting_id").agg(
        F.when(F.bool_or(~text.is_draft(F.col("filename"))), "final_ready")
        .otherwise("provisional_ready").alias("readiness")
    )


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows refreshed by incoming ones of the same key, plus new ones."""
    fresh = first_of(incoming, keys, [F.desc("observed_at"), F.desc("event_id")])
    kept = stored.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))


def new_rows(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not stored yet, each key once."""
    return incoming.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def owned(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows of documents without an owner or owned by the row's meeting; ``owners``: id, owner."""
    joined = rows.join(owners, "id", "left")
    return joined.filter(F.col("owner").isNull() | (F.col("owner") == F.col("meeting_id"))).drop("owner")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order (later sheets replace earlier ones)."""
    return first_of(rows, [key], [F.desc(order)])


def archive_match(documents: DataFrame, archives: DataFrame) -> DataFrame:
    """Metadata rows against archives: ``matched``, ``missing`` (no archive) or ``orphan``."""
    rows = documents.select(F.upper("id").alias("id"), F.lit(True).alias("in_rows")).distinct()
    files = archives.select(
        text.document_id_of(F.col("filename")).alias("id"), F.lit(True).alias("in_files")
    ).distinct()
    state = (
        F.when(F.col("in_rows") & F.col("in_files"), "matched")
        .when(F.col("in_rows"), "missing").otherwise("orphan")
    )
    return rows.join(files, "id", "full").select("id", state.alias("state"))


def pending(artifacts: DataFrame) -> DataFrame:
    """Artifacts that still need work."""
    return artifacts.filter(
        F.coalesce(~F.col("parse_status").isin(*K.SETTLED_PARSE_STATUSES), F.lit(True))
    )


def coverage(documents: DataFrame, archives: DataFrame) -> DataFrame:
    """Per meeting: documents, archived share, actionable documents and their archived share."""
    files = archives.select(
        text.document_id_of(F.col("filename")).alias("key"), F.lit(1).alias("archived")
    ).distinct()
    joined = documents.withColumn("key", F.upper("id")).join(files, "key", "left").withColumns(
        {"archived": F.coalesce("archived", F.lit(0)), "wanted": actionable().cast("int")}
    )
    sums = joined.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("tdocs"), F.sum("archived").alias("archived"),
        F.sum("wanted").alias("actionable"),
        F.sum(F.col("wanted") * F.col("archived")).alias("actionable_archived"),
    )
    ratio = text.guarded_ratio
    return sums.select(
        "meeting_id", "tdocs", "actionable", ratio(F.col("archived"), F.col("tdocs")).alias("archive_ratio"),
        ratio(F.col("actionable_archived"), F.col("actionable")).alias("actionable_ratio"),
    )


def readiness(meetings: DataFrame, documents: DataFrame, artifacts: DataFrame, bodies: DataFrame,
              state: str = "validated", minimum: float = K.MIN_INGESTION_COVERAGE) -> DataFrame:
    """One row of activation metrics with its failed rules.

    ``artifacts`` has ``meeting_id, kind, filename, parse_status``; ``bodies`` lists parsed documents.
    """
    reports = F.when((F.col("kind") == "report") & (F.col("parse_status") == "parsed"), F.col("meeting_id"))
    invalid = ~F.col("parse_status").isin(*K.SETTLED_PARSE_STATUSES)
    files = artifacts.filter(F.col("kind") == "tdoc").groupBy(
        text.document_id_of(F.col("filename")).alias("key")
    ).agg(F.bool_or(F.col("parse_status") == "quarantined").alias("quarantined"))
    parsed = bodies.select(F.upper("document_id").alias("key"), F.lit(True).alias("parsed")).distinct()
    joined = (
        documents.select(F.upper("id").alias("key"), actionable().alias("wanted"))
        .join(files.withColumn("archived", F.lit(True)), "key", "left").join(parsed, "key", "left")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    parts = [
        meetings.agg(F.count(F.lit(1)).alias("meetings")),
        undated(meetings).agg(F.count(F.lit(1)).alias("undated_meetings")),
        artifacts.agg(F.count_distinct(reports).alias("report_meetings"), F.count_if(invalid).alias("invalid_artifacts")),
        joined.agg(
            F.count(F.lit(1)).alias("tdocs"), F.count_if("wanted").alias("actionable_tdocs"),
            F.count_if(F.col("wanted") & yes("archived")).alias("archived_actionable"),
            F.count_if(F.col("wanted") & (yes("parsed") | yes("quarantined"))).alias("handled_actionable"),
        ),
    ]
    # Each part is one row; the rows are stacked and folded into one.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    one = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    ratio = text.guarded_ratio
    rated = one.withColumns({
        "archive_coverage": ratio(F.col("archived_actionable"), F.col("actionable_tdocs")),
        "body_coverage": ratio(F.col("handled_actionable"), F.col("actionable_tdocs")),
    })
    rules = {
        "state": F.lit(state != "validated"),
        "empty": (F.col("meetings") == 0) | (F.col("tdocs") == 0),
        "undated": F.col("undated_meetings") > 0,
        "reports": F.col("report_meetings") != F.col("meetings"),
        "parse_status": F.col("invalid_artifacts") > 0,
        "archive_coverage": F.col("archive_coverage") < minimum,
        "body_coverage": F.col("body_coverage") < minimum,
    }
    failed = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda e: e.isNotNull())
    return rated.withColumn("errors", F.array_join(failed, ",")).withColumn("ready", F.col("errors") == "")


def reconciled(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys ``(source_url, sha256)`` of both sides with ``matched``, ``missing`` or ``unexpected``."""
    keys = ["source_url", "sha256"]
    left = expected.select(*keys, F.lit(True).alias("wanted")).distinct()
    right = stored.select(*keys, F.lit(True).alias("found")).distinct()
    state = (
        F.when(F.col("wanted") & F.col("found"), "matched").when(F.col("wanted"), "missing")
        .otherwise("unexpected")
    )
    return left.join(right, keys, "full").select(*keys, state.alias("state"))


def filled_dates(meetings: DataFrame, found: DataFrame) -> DataFrame:
    """Meetings with missing dates taken from ``found`` (meeting_id, starts_on, ends_on).

    ``conflict`` marks a known date that differs from the found one; the known one stays.
    """
    new = found.select(F.col("meeting_id").alias("id"), F.col("starts_on").alias("new_start"),
                       F.col("ends_on").alias("new_end"))
    conflict = F.coalesce(F.col("starts_on") != F.col("new_start"), F.lit(False)) | F.coalesce(
        F.col("ends_on") != F.col("new_end"), F.lit(False)
    )
    return meetings.join(new, "id", "left").withColumn("conflict", conflict).withColumns({
        "starts_on": F.coalesce("starts_on", "new_start"), "ends_on": F.coalesce("ends_on", "new_end"),
    }).drop("new_start", "new_end")


def combined_runs(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Previous results whose key is not in the current run, and the current ones."""
    return previous.join(current.select(key), key, "left_anti").unionByName(current)


def guarded_members(members: DataFrame) -> DataFrame:
    """Archive members with the reason to quarantine them, null if they are safe.

    Columns read: ``filename, encrypted``.
    """
    name = F.lower(F.replace(F.col("filename"), F.lit("\\"), F.lit("/")))
    climbs = F.startswith(name, F.lit("/")) | F.exists(F.split(name, "/"), lambda p: p == "..")
    reason = (
        F.when(F.col("encrypted"), "encrypted").when(climbs, "path traversal")
        .when(F.endswith(name, F.lit("vbaproject.bin")) | F.rlike(name, F.lit(r"\.(?:docm|xlsm|pptm)$")), "macros")
    )
    return members.withColumn("reason", reason)


def routed(documents: DataFrame, members: DataFrame) -> DataFrame:
    """Parse status per document from its guarded members and its text.

    ``documents``: ``document_id, supported, text``; ``members``: ``document_id, reason``. An unsafe
    archive is ``quarantined``, an unsupported file ``not_applicable``, a text without words ``failed``.
    """
    unsafe = members.filter("reason is not null").groupBy("document_id").agg(F.min("reason").alias("reason"))
    joined = documents.join(unsafe, "document_id", "left")
    empty = text.word_count(F.coalesce("text", F.lit(""))) == 0
    status = (
        F.when(F.col("reason").isNotNull(), "quarantined").when(~F.col("supported"), "not_applicable")
        .when(empty, "failed").otherwise("parsed")
    )
    return joined.select(
        "document_id", status.alias("parse_status"),
        F.when(status == "failed", "document has no text").otherwise(F.col("reason")).alias("parse_error"),
    )


def created(versions: DataFrame, version: str) -> DataFrame:
    """Versions with ``version`` added as ``building``; an active version cannot be opened again."""
    same = versions.filter(F.col("id") == version).select("is_active").head(1)
    if same and same[0]["is_active"]:
        raise ValueError(f"dataset version {version} is active and cannot change")
    row = versions.sparkSession.range(1).select(
        F.lit(version).alias("id"), F.lit("building").alias("state"), F.lit(False).alias("is_active")
    )
    return versions.select("id", "state", "is_active").filter(F.col("id") != version).unionByName(row)


def not_yet_stored(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Manifest entries to fetch: not downloaded, or downloaded but not in the store."""
    have = stored.select("sha256", F.lit(True).alias("_have")).distinct()
    joined = entries.join(have, "sha256", "left")
    done = (F.col("status") == "downloaded") & F.coalesce("_have", F.lit(False))
    return joined.filter(~F.coalesce(done, F.lit(False))).drop("_have")


def first_dates(rows: DataFrame, found: Column) -> DataFrame:
    """Per meeting the dates of its first dated text; rows carry ``meeting_id`` and ``place``."""
    dated = rows.select("meeting_id", "place", found.alias("d")).filter("d is not null")
    return dated.groupBy("meeting_id").agg(F.min_by("d", "place").alias("d")).select("meeting_id", "d.*")
