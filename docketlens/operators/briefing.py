"""Meeting briefings for all meetings at once, and audits of claims and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text
from .search import most_common


def totals(documents: DataFrame) -> DataFrame:
    """Per meeting and status: documents, and the meeting's total."""
    counts = documents.groupBy("meeting_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(W.partitionBy("meeting_id")))


def hot_topics(documents: DataFrame, limit: int = 10) -> DataFrame:
    return most_common(
        documents.filter(F.coalesce("agenda_description", F.lit("")) != ""),
        ["meeting_id"], "agenda_description", limit,
    )


def company_activity(documents: DataFrame, limit: int = 10) -> DataFrame:
    """The most active names of the source field, split on commas only."""
    names = F.filter(F.transform(F.split("source", ","), text.strip), lambda v: v != "")
    return most_common(
        documents.select("meeting_id", "seq", F.explode(names).alias("company")),
        ["meeting_id"], "company", limit,
    )


def affected_specifications(documents: DataFrame) -> DataFrame:
    return (
        documents.select("meeting_id", F.explode("specifications").alias("specification"))
        .groupBy("meeting_id", "specification").agg(F.count(F.lit(1)).alias("n"))
    )


def revision_pairs(documents: DataFrame) -> DataFrame:
    """Per meeting the documents that a later one revises."""
    later = documents.filter(F.col("revised_from").isNotNull()).select(
        F.col("revised_from").alias("id"), F.col("id").alias("revised_to")
    )
    return documents.join(later, "id").select("meeting_id", "id", "revised_to")


def envelope(documents: DataFrame, meetings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per meeting: completeness, confidence and the number of documents without evidence."""
    have = evidence.select("id", F.lit(1).alias("has")).distinct()
    rows = documents.join(have, "id", "left").groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("tdocs"), F.count("has").alias("with_evidence")
    )
    joined = meetings.select(F.col("id").alias("meeting_id"), "readiness").join(rows, "meeting_id", "left")
    n, ok = F.coalesce("tdocs", F.lit(0)), F.coalesce("with_evidence", F.lit(0))
    late = F.col("readiness") != "final_ready"
    return joined.select(
        "meeting_id", n.alias("tdocs"), (n - ok).alias("without_evidence"),
        F.when(late | (n > ok), "partial").otherwise("complete").alias("completeness"),
        text.guarded_ratio(ok, n).alias("confidence"),
    )


def compared(documents: DataFrame, meeting_ids: tuple[str, ...]) -> DataFrame:
    """Status counts side by side for two or more meetings."""
    if len(set(meeting_ids)) < 2:
        raise ValueError("compare at least two meetings")
    chosen = documents.filter(F.col("meeting_id").isin(*meeting_ids))
    return chosen.groupBy("status").agg(
        *[F.count_if(F.col("meeting_id") == m).alias(m) for m in meeting_ids]
    )


def audited_claims(claims: DataFrame, evidence: DataFrame, numbers: DataFrame, names: DataFrame) -> DataFrame:
    """Claims with what their packet does not support.

    ``claims``: ``claim_id, packet_id, text, evidence_ids, organizations``; the others list what a
    packet allows: ``(packet_id, evidence_id)``, ``(packet_id, number)``, ``(packet_id, organization)``.
    Columns: ``claim_id, problem, value``.
    """
    cited = claims.select("claim_id", "packet_id", F.explode("evidence_ids").alias("evidence_id")).join(
        evidence, ["packet_id", "evidence_id"], "left_anti"
    ).select("claim_id", F.lit("evidence").alias("problem"), F.col("evidence_id").alias("value"))
    said = claims.select(
        "claim_id", "packet_id", F.explode(F.array_distinct(text.numbers(F.col("text")))).alias("number")
    ).join(numbers, ["packet_id", "number"], "left_anti").select(
        "claim_id", F.lit("number").alias("problem"), F.col("number").alias("value")
    )
    each = claims.select("claim_id", "packet_id", "text", F.explode("organizations").alias("organization"))
    unknown = each.join(names, ["packet_id", "organization"], "left_anti")
    unsaid = each.filter(~F.contains("text", F.col("organization")))
    wrong = unknown.select("claim_id", "organization").unionByName(unsaid.select("claim_id", "organization"))
    return cited.unionByName(said).unionByName(
        wrong.select("claim_id", F.lit("organization").alias("problem"), F.col("organization").alias("value"))
    ).distinct()


def merged_topics(extracted: DataFrame, minimum: float = K.TOPIC_MIN_CONFIDENCE) -> DataFrame:
    """Extracted topics merged by name regardless of case.

    Columns read: ``seq, canonical_name, alias, confidence, evidence_id``, one row per alias and
    evidence; the first name stays, confidence is the greatest.
    """
    kept = extracted.filter(F.col("confidence") >= minimum)
    return kept.groupBy(F.lower("canonical_name").alias("key")).agg(
        F.min_by("canonical_name", "seq").alias("canonical_name"), F.max("confidence").alias("confidence"),
        F.count_distinct("alias").alias("aliases"), F.count_distinct("evidence_id").alias("evidence"),
    )
