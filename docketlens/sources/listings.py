"""Listing pages, spreadsheet grids, manifests and plain scans as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text

HREF = r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>'
ANCHOR = r'(?is)<a\s[^>]*>(.*?)</a>'


def absolute(base: Column, href: Column) -> Column:
    """An anchor's address relative to its page."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")),
              F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .otherwise(F.concat(folder, F.when(F.endswith(folder, F.lit("/")), "").otherwise("/"), href))
    )


def links(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` to every anchor in page order: ``(page_id, position, href, target)``."""
    return pages.select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("position", "href")
    ).select("page_id", "position", "href", absolute(F.col("url"), F.col("href")).alias("target"))


def usable_links(found: DataFrame, hosts: tuple[str, ...] = ()) -> DataFrame:
    """Links to https pages on an allowed host; anchors that start as query, fragment or script go."""
    host = F.lower(F.regexp_extract("target", r"^https?://([^/?#:]+)", 1))
    keep = F.startswith("target", F.lit("https://")) & ~F.rlike("href", F.lit(r"^\s*(?:[?#]|javascript:)"))
    if hosts:
        keep = keep & host.isin(*hosts)
    return found.filter(keep).withColumn("host", host)


def last_segment(url: Column) -> Column:
    """Last path segment with percent escapes decoded; a plus sign stays."""
    raw = F.element_at(F.split(F.rtrim(F.regexp_replace(url, r"[?#].*$", ""), F.lit("/")), "/"), -1)
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def listed_meetings(found: DataFrame, pattern: str, group: str) -> DataFrame:
    """Meetings named by listing links ``(position, target)``.

    ``pattern`` must match the whole last segment; its first group is the number and a second one, if
    any, the variant. The last link of a meeting wins.
    """
    name = last_segment(F.col("target"))
    two = pattern.count("(") - pattern.count("(?:") > 1
    whole = f"^(?:{pattern})$"
    variant = text.normalize_variant(F.regexp_extract("name", whole, 2)) if two else F.lit("")
    rows = found.withColumn("name", name).filter(F.rlike("name", F.lit(whole))).select(
        "position", F.col("target"), F.col("name").alias("source_name"),
        F.regexp_extract("name", whole, 1).cast("int").alias("number"), variant.alias("variant"),
    )
    tail = F.when(F.col("variant") != "", F.concat(F.lit("-"), "variant")).otherwise("")
    named = rows.withColumn("id", F.concat(F.lit(f"{group}-"), "number", tail))
    return named.groupBy("id", "number", "variant").agg(
        F.max_by(F.struct("target", "source_name"), F.struct("position", "target")).alias("l")
    ).select("id", F.lit(group).alias("working_group_id"), "number", "variant",
             F.concat(F.rtrim("l.target", F.lit("/")), F.lit("/")).alias("url"), "l.source_name")


#: Name patterns of a group's files, tried in this order; groups bring their own.
FILE_PATTERNS = {
    "agenda": r"(?i)agenda", "tdoc_list": r"(?i)tdoc_?list", "tdoc": r"(?i)^[a-z]\d-\d+", "report": r"(?i)report",
}


def artifact_kind(name: Column, role: Column, patterns: dict[str, str] | None = None) -> Column:
    """Kind of a listed file by name patterns in order, and by the directory's role."""
    kind = F.when(F.lit(False), "")
    for label, pattern in (FILE_PATTERNS if patterns is None else patterns).items():
        found = F.rlike(name, F.lit(pattern))
        if label == "tdoc":
            kind = kind.when(found & (role == "reports"), "report")
        kind = kind.when(found, label)
    return kind.when(role == "reports", "report").otherwise("other")


def listed_artifacts(found: DataFrame) -> DataFrame:
    """Files of listing pages: ``target`` once per page, sorted by lower-cased name."""
    name = last_segment(F.col("target"))
    files = found.filter(~F.endswith("target", F.lit("/"))).withColumn("filename", name)
    role = F.when(F.contains(F.lower("target"), F.lit("/report")), "reports").otherwise("docs")
    once = files.dropDuplicates(["page_id", "target"])
    order = W.partitionBy("page_id").orderBy(F.lower("filename"), "target")
    return once.select(
        "page_id", "target", "filename", artifact_kind(F.col("filename"), role).alias("kind"),
        F.row_number().over(order).alias("place"),
    )


def directory_names(pages: DataFrame) -> DataFrame:
    """Distinct lower-cased anchor texts of each page, a trailing slash left out."""
    tidy = F.transform(
        F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)),
        lambda a: F.rtrim(F.lower(text.strip(F.regexp_replace(a, "<[^>]*>", ""))), F.lit("/")),
    )
    return pages.select("page_id", F.explode(F.array_distinct(F.filter(tidy, lambda a: a != ""))).alias("name"))


def roles_present(names: DataFrame, roles: DataFrame) -> DataFrame:
    """Configured directories ``(role, directory)`` found on each page."""
    return names.join(roles, names["name"] == F.lower(roles["directory"])).select("page_id", "role", "name")


def records_of_grid(grid: DataFrame) -> DataFrame:
    """Long spreadsheet rows ``(sheet, row_no, cells)`` to header-keyed cells of data rows.

    A sheet's header is its first row that names a document id and a title or subject; private sheets
    are skipped. Columns: ``sheet, row_no, column, value``.
    """
    named = grid.filter(~F.lower(text.strip(F.col("sheet"))).isin(*K.PRIVATE_SHEETS)).withColumn(
        "names", F.transform("cells", lambda c: text.normalize_column(F.coalesce(c, F.lit(""))))
    )
    is_header = F.array_contains("names", "tdoc") & (
        F.array_contains("names", "title") | F.array_contains("names", "subject")
    )
    headers = named.filter(is_header).groupBy("sheet").agg(
        F.min("row_no").alias("header_row"), F.min_by("names", "row_no").alias("header")
    )
    return (
        named.join(headers, "sheet").filter(F.col("row_no") > F.col("header_row"))
        .select("sheet", "row_no", F.explode(F.arrays_zip(F.col("header").alias("column"), F.col("cells").alias("value"))).alias("c"))
        .select("sheet", "row_no", F.col("c.column").alias("column"), text.optional_text(F.col("c.value")).alias("value"))
        .filter(F.col("column").isNotNull() & (F.col("column") != "") & F.col("value").isNotNull())
    )


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """Manifest rows ``(schema_version, artifacts map)`` to one row per artifact."""
    return manifests.filter(F.col("schema_version") == 1).select(
        F.explode("artifacts").alias("url", "artifact")
    ).select("url", "artifact.*")


def verified(artifacts: DataFrame, contents: DataFrame) -> DataFrame:
    """Artifacts joined with contents by key; ``intact`` compares the recomputed SHA-256."""
    return artifacts.join(contents, "object_key", "left").select(
        "object_key", "sha256", F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False)).alias("intact")
    )


def not_downloaded(manifests: DataFrame) -> DataFrame:
    """Artifacts of manifests that have not arrived; a manifest with any must not be ingested."""
    return manifest_entries(manifests).filter(~F.coalesce(F.col("status") == "downloaded", F.lit(False)))


def selected_meetings(manifests: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Meetings of ``(selected array, meetings map)``: the selection, else all; ``wanted`` regardless of case."""
    names = F.when(F.size(F.coalesce("selected", F.expr("cast(array() as array<string>)"))) > 0, F.col("selected"))
    each = manifests.select(F.explode(F.coalesce(names, F.map_keys("meetings"))).alias("meeting_id"))
    if wanted:
        each = each.filter(F.lower("meeting_id").isin(*[w.lower() for w in wanted]))
    return each.distinct()


def validated_sources(pages: DataFrame, roles: DataFrame, found: DataFrame) -> DataFrame:
    """Per listing page: roles with a directory, files found and whether the page passes.

    ``found`` are ``listed_artifacts`` of the pages.
    """
    present = roles_present(directory_names(pages), roles).groupBy("page_id").agg(
        F.count_distinct("role").alias("roles")
    )
    files = found.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("artifacts"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds")
    )
    zero = F.lit(0).cast("long")
    return pages.select("page_id").join(present, "page_id", "left").join(files, "page_id", "left").select(
        "page_id", F.coalesce("roles", zero).alias("roles"), F.coalesce("artifacts", zero).alias("artifacts"),
        F.coalesce("kinds", F.lit("")).alias("kinds"), (F.coalesce("artifacts", zero) > 0).alias("passed"),
    )


def wide_records(cells: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Header-keyed cells to one row per data row; of repeated headers the greatest value stays."""
    return cells.groupBy("sheet", "row_no").agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    )
