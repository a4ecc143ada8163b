"""URL filters with dated lists, in DataFrame operations only.

List changes (block, allow, remove) per key become validity intervals by the next change of the same
key. Every capture is looked up under its keys - the host, the host's parent domains, and host plus
path prefixes down to the deepest listed one - and joined as of its fetch time with the intervals
that hold then. Of the active entries the most specific decides: longer prefix, then host, then
nearer domain.

The join is by key with a time condition. A host that holds a third of all captures is one key of the
capture side only; a key has as many list rows as it has dated changes, so adaptive skew handling can
split the captures freely. Captures are never gathered per host.

Hosts are compared in lower case, without user, port and a trailing dot. A null or malformed URL has
decision ``invalid``; a null fetch time is never inside an interval, so the decision is ``unlisted``.
Of several changes of a key at one moment the greatest ``entry_id`` holds. Empty lists leave every
capture ``unlisted``; repeated captures repeat their result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SCOPES = {"prefix": 3, "host": 2, "domain": 1}
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    host = F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def path_segments(url: Column) -> Column:
    """Non-empty segments of the path."""
    return F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")


def validity(changes: DataFrame) -> DataFrame:
    """``(entry_id, scope, key, action, effective_at)`` to intervals ``[active_from, active_to)``.

    A removal ends the interval before it and opens none.
    """
    order = W.partitionBy("scope", "key").orderBy("effective_at", "entry_id")
    return (
        changes.filter(F.col("effective_at").isNotNull() & F.col("key").isNotNull())
        .withColumn("active_to", F.lead("effective_at").over(order))
        .filter((F.col("action") != "remove")
                & (F.col("active_to").isNull() | (F.col("active_to") > F.col("effective_at"))))
        .select("entry_id", "scope", "key", "action", F.col("effective_at").alias("active_from"),
                "active_to")
    )


def capture_keys(host: Column, segments: Column, depth: int) -> Column:
    """All ``(scope, key, weight)`` under which a capture can be listed."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    tails = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.struct(
            F.when(i == 1, "host").otherwise("domain").alias("scope"),
            F.array_join(F.slice(labels, i, n), ".").alias("key"),
            (F.when(i == 1, SCOPES["host"] * 1_000_000).otherwise(SCOPES["domain"] * 1_000_000)
             - i).alias("weight"),
        ),
    )
    most = F.least(F.size(segments), F.lit(depth))
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(0), most), lambda i: i > 0),
        lambda i: F.struct(
            F.lit("prefix").alias("scope"),
            F.concat_ws("/", host, F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("key"),
            (F.lit(SCOPES["prefix"] * 1_000_000) + i).alias("weight"),
        ),
    )
    return F.when(host.isNotNull(), F.concat(tails, prefixes))


def decide(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """``(page_id, url, fetched_at)`` with the list decision at fetch time.

    Columns: ``page_id, url, host, fetched_at, decision, scope, rule_key, active_from``.
    """
    intervals = validity(changes)
    depth = intervals.filter(F.col("scope") == "prefix").agg(
        F.max(F.size(F.split("key", "/")) - 1).alias("depth")
    ).first()["depth"] or 0
    rows = captures.select(
        F.monotonically_increasing_id().alias("row_id"), "page_id", "url", "fetched_at",
        host_of(F.col("url")).alias("host"), path_segments(F.col("url")).alias("segments"),
    )
    keys = rows.select(
        "row_id", "page_id", "url", "host", "fetched_at",
        F.explode_outer(capture_keys(F.col("host"), F.col("segments"), depth)).alias("k"),
    ).select("row_id", "page_id", "url", "host", "fetched_at", "k.*")
    i = intervals.select("scope", "key", "action", "active_from", "active_to")
    asof = (
        (keys["scope"] == i["scope"]) & (keys["key"] == i["key"])
        & (keys["fetched_at"] >= i["active_from"])
        & (i["active_to"].isNull() | (keys["fetched_at"] < i["active_to"]))
    )
    hit = F.struct(
        keys["weight"].alias("weight"), keys["scope"].alias("scope"), keys["key"].alias("key"),
        i["action"].alias("action"), i["active_from"].alias("active_from"),
    )
    joined = keys.join(i, asof, "left").select(
        "row_id", "page_id", "url", "host", "fetched_at",
        F.when(i["action"].isNotNull(), hit).alias("hit"),
    )
    best = joined.groupBy("row_id", "page_id", "url", "host", "fetched_at").agg(F.max("hit").alias("hit"))
    decision = (
        F.when(F.col("host").isNull(), "invalid").when(F.col("hit").isNull(), "unlisted")
        .otherwise(F.col("hit.action"))
    )
    return best.select(
        "page_id", "url", "host", "fetched_at", decision.alias("decision"),
        F.col("hit.scope").alias("scope"), F.col("hit.key").alias("rule_key"),
        F.col("hit.active_from").alias("active_from"),
    )


# The tables have neither fetch times nor lists, so the query derives both from ``pages``: a fetch
# time from the page number and dated changes from digests of hosts, parent domains and first path
# segments.
EPOCH = 1_704_067_200
DAY = 86_400
SPAM_WORDS = ("cheap-pills", "spam-farm")


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", "url", (F.col("page_id") * 900 + EPOCH).cast("long").alias("fetched_at")
    )


def page_list_changes(pages: DataFrame) -> DataFrame:
    """Dated list changes derived from the distinct hosts and first path segments of ``pages``."""
    seen = pages.select(
        host_of(F.col("url")).alias("host"),
        F.try_element_at(path_segments(F.col("url")), F.lit(1)).alias("first"),
    ).filter("host is not null")
    hosts = seen.select("host").distinct().withColumn("d", F.md5("host"))
    digit = lambda at: F.instr(F.lit("0123456789abcdef"), F.substring(F.col("d"), at, 1)) - 1
    day = lambda n: (F.lit(EPOCH) + n * DAY).cast("long")
    spam = F.contains("host", F.lit(SPAM_WORDS[0])) | F.contains("host", F.lit(SPAM_WORDS[1]))

    def change(frame: DataFrame, name: str, scope: str, key: str, action: str, at: Column, when: Column):
        return frame.filter(when).select(
            F.concat(F.lit(name + ":"), F.col(key)).alias("entry_id"), F.lit(scope).alias("scope"),
            F.col(key).alias("key"), F.lit(action).alias("action"), at.alias("effective_at"),
        )

    parents = (
        hosts.select(F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("parent"))
        .filter("parent <> ''").distinct().withColumn("d", F.md5("parent"))
    )
    prefixes = (
        seen.filter("first is not null").select(F.concat_ws("/", "host", "first").alias("prefix"))
        .distinct().withColumn("d", F.md5("prefix"))
    )
    return (
        change(hosts, "h1", "host", "host", "block", day(digit(2) * 30), (digit(1) <= 2) | spam)
        .unionByName(change(hosts, "h2", "host", "host", "remove", day((digit(2) + digit(3)) * 30),
                            digit(1) == 1))
        .unionByName(change(hosts, "h3", "host", "host", "allow", day((digit(2) + digit(3) + 2) * 30),
                            digit(1) == 2))
        .unionByName(change(parents, "d1", "domain", "parent", "block", day(digit(4) * 40), digit(1) <= 5))
        .unionByName(change(prefixes, "p1", "prefix", "prefix", "block", day(digit(5) * 20),
                            digit(1).isin(4, 5)))
        .unionByName(change(prefixes, "p2", "prefix", "prefix", "allow", day(digit(6) * 45), digit(1) == 6))
    )


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return decide(page_captures(pages), page_list_changes(pages))


def _sql_digit(column: str, at: int) -> str:
    return f"(strpos('0123456789abcdef', substr(md5({column}), {at}, 1)) - 1)"


def _sql_day(expression: str) -> str:
    return f"CAST({EPOCH} + ({expression}) * {DAY} AS BIGINT)"


def _sql() -> str:
    h, d, p = "host", "parent", "prefix"
    return f"""
WITH seen AS (
  SELECT page_id, url, CAST(page_id * 900 + {EPOCH} AS BIGINT) AS fetched_at,
    nullif(rtrim(lower(regexp_extract(url, '{_HOST}', 1)), '.'), '') AS host,
    list_filter(string_split(regexp_extract(url, '{_PATH}', 1), '/'), lambda s: s <> '') AS segments
  FROM pages),
hosts AS (SELECT DISTINCT host FROM seen WHERE host IS NOT NULL),
parents AS (SELECT DISTINCT regexp_extract(host, '^[^.]+\\.(.+\\..+)$', 1) AS parent FROM hosts
  WHERE regexp_matches(host, '^[^.]+\\.(.+\\..+)$')),
prefixes AS (SELECT DISTINCT host || '/' || segments[1] AS prefix FROM seen
  WHERE host IS NOT NULL AND len(segments) > 0),
changes AS (
  SELECT 'h1:' || host AS entry_id, 'host' AS scope, host AS key, 'block' AS action,
    {_sql_day(_sql_digit(h, 2) + ' * 30')} AS effective_at
  FROM hosts WHERE {_sql_digit(h, 1)} <= 2 OR host LIKE '%{SPAM_WORDS[0]}%' OR host LIKE '%{SPAM_WORDS[1]}%'
  UNION ALL SELECT 'h2:' || host, 'host', host, 'remove',
    {_sql_day('(' + _sql_digit(h, 2) + ' + ' + _sql_digit(h, 3) + ') * 30')} FROM hosts
  WHERE {_sql_digit(h, 1)} = 1
  UNION ALL SELECT 'h3:' || host, 'host', host, 'allow',
    {_sql_day('(' + _sql_digit(h, 2) + ' + ' + _sql_digit(h, 3) + ' + 2) * 30')} FROM hosts
  WHERE {_sql_digit(h, 1)} = 2
  UNION ALL SELECT 'd1:' || parent, 'domain', parent, 'block', {_sql_day(_sql_digit(d, 4) + ' * 40')}
  FROM parents WHERE {_sql_digit(d, 1)} <= 5
  UNION ALL SELECT 'p1:' || prefix, 'prefix', prefix, 'block', {_sql_day(_sql_digit(p, 5) + ' * 20')}
  FROM prefixes WHERE {_sql_digit(p, 1)} IN (4, 5)
  UNION ALL SELECT 'p2:' || prefix, 'prefix', prefix, 'allow', {_sql_day(_sql_digit(p, 6) + ' * 45')}
  FROM prefixes WHERE {_sql_digit(p, 1)} = 6),
spans AS (
  SELECT *, lead(effective_at) OVER (PARTITION BY scope, key ORDER BY effective_at, entry_id) AS active_to
  FROM changes),
intervals AS (SELECT scope, key, action, effective_at AS active_from, active_to FROM spans
  WHERE action <> 'remove' AND (active_to IS NULL OR active_to > effective_at)),
rows AS (SELECT row_number() OVER () AS row_id, * FROM seen),
labels AS (SELECT *, string_split(host, '.') AS parts FROM rows WHERE host IS NOT NULL),
keys AS (
  SELECT row_id, fetched_at, CASE WHEN i = 1 THEN 'host' ELSE 'domain' END AS scope,
    array_to_string(parts[i:], '.') AS key,
    CASE WHEN i = 1 THEN 2000000 ELSE 1000000 END - i AS weight
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM labels)
  UNION ALL
  SELECT row_id, fetched_at, 'prefix', host || '/' || array_to_string(segments[:i], '/'), 3000000 + i
  FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS i FROM rows WHERE host IS NOT NULL)),
hits AS (
  SELECT k.row_id, k.scope, k.key, i.action, i.active_from,
    row_number() OVER (PARTITION BY k.row_id ORDER BY k.weight DESC, i.active_from DESC) AS place
  FROM keys k JOIN intervals i ON k.scope = i.scope AND k.key = i.key AND k.fetched_at >= i.active_from
    AND (i.active_to IS NULL OR k.fetched_at < i.active_to))
SELECT r.page_id, r.url, r.host, r.fetched_at,
  CASE WHEN r.host IS NULL THEN 'invalid' WHEN h.action IS NULL THEN 'unlisted' ELSE h.action END AS decision,
  h.scope, h.key AS rule_key, h.active_from
FROM rows r LEFT JOIN hits h ON h.row_id = r.row_id AND h.place = 1
"""


OP4_SQL = _sql()
