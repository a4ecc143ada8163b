"""Domain tables derived from the star-schema tables, in SQL that Spark and DuckDB both run.

The library's operators take meetings, documents ("tdocs"), evidence, artifacts and so on. This module
derives them from whole tables: meetings from ``nation``, documents from ``orders`` with their lines,
artifacts and versions from ``orders`` and ``events``. ``{name}`` marks the few functions that the two
dialects write differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SPARK = {
    "day": "date_add(DATE'1996-01-01', CAST({0} AS INT))",
    "set": "array_sort(collect_set({0}))",
    "join": "array_join({0}, '{1}')",
    "sha": "sha2({0}, 256)",
    "text": "CAST({0} AS STRING)",
    "int": "CAST({0} AS INT)",
    "json": "CAST(get_json_object({0}, '$.k') AS BIGINT)",
    "epoch": "unix_micros({0})",
}
DUCK = {
    "day": "(DATE '1996-01-01' + CAST({0} AS INTEGER))",
    "set": "list_sort(list(DISTINCT {0}))",
    "join": "array_to_string({0}, '{1}')",
    "sha": "sha256({0})",
    "text": "CAST({0} AS VARCHAR)",
    "int": "CAST({0} AS INTEGER)",
    "json": "CAST(json_extract_string({0}, '$.k') AS BIGINT)",
    "epoch": "epoch_us({0})",
}


def _say(dialect: dict[str, str], name: str, *parts: str) -> str:
    return dialect[name].format(*parts)


def definitions(dialect: dict[str, str]) -> dict[str, str]:
    """Name -> SQL of each derived table, in an order in which each uses only earlier ones."""
    s = lambda name, *parts: _say(dialect, name, *parts)
    key = s("text", "n_nationkey")
    meetings = f"""
SELECT concat('WG', {s('text', 'n_regionkey')}, '-', {key}) AS id,
  concat('WG', {s('text', 'n_regionkey')}) AS working_group_id, n_nationkey AS number,
  CASE WHEN n_nationkey % 5 = 0 THEN 'bis' ELSE '' END AS variant, n_name AS name,
  concat('https://archive.example.org/WG', {s('text', 'n_regionkey')}, '/', {key}, '/') AS source_url,
  CASE WHEN n_nationkey % 11 <> 0 THEN {s('day', 'n_nationkey * 60')} END AS starts_on,
  CASE WHEN n_nationkey % 11 <> 0 THEN {s('day', 'n_nationkey * 60 + 4')} END AS ends_on,
  CASE WHEN n_nationkey % 3 = 0 THEN 'final_ready' ELSE 'provisional_ready' END AS readiness
FROM nation"""
    lines = f"""
SELECT l_orderkey AS order_key, {s('set', 's_name')} AS suppliers, {s('set', 'p_brand')} AS brands,
  {s('set', 'p_type')} AS types, {s('set', s('text', 'p_size'))} AS sizes, min(p_name) AS part_name
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
GROUP BY l_orderkey"""
    tdocs = f"""
SELECT concat('T-', {s('text', 'o_orderkey')}) AS id, o_orderkey AS seq,
  concat('WG', {s('text', 'n_regionkey')}, '-', {s('text', 'n_nationkey')}) AS meeting_id,
  concat('WG', {s('text', 'n_regionkey')}) AS working_group_id,
  coalesce(part_name, '') AS title,
  CASE o_orderstatus WHEN 'F' THEN ' Agreed ' WHEN 'O' THEN 'not  handled' WHEN 'P' THEN 'Revised'
    ELSE o_orderstatus END AS status_raw,
  CASE o_orderstatus WHEN 'F' THEN 'agreed' WHEN 'O' THEN 'not_treated' WHEN 'P' THEN 'revised'
    ELSE 'unknown' END AS status,
  substr(o_orderpriority, 1, 1) AS agenda_item, o_orderpriority AS agenda_description,
  CASE WHEN suppliers IS NULL THEN '' WHEN o_orderkey % 5 = 0
    THEN concat({s('join', 'suppliers', '? ')}, ', Inc.')
    WHEN o_orderkey % 5 = 1 THEN {s('join', 'suppliers', '; ')}
    ELSE {s('join', 'suppliers', ', ')} END AS source,
  coalesce({s('join', 'brands', '; ')}, '') AS specifications_text,
  coalesce({s('join', 'types', '; ')}, '') AS releases_text,
  coalesce({s('join', 'sizes', '; ')}, '') AS work_items_text,
  CASE WHEN o_orderkey % 9 = 0 THEN {s('text', 'o_orderkey % 1000')} END AS cr_number,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'T-' || {s('text', 'lag(o_orderkey) OVER chain')} END
    AS revised_from,
  o_orderdate AS received
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN lines ON o_orderkey = order_key
WINDOW chain AS (PARTITION BY o_custkey % 50 ORDER BY o_orderkey)"""
    artifacts = f"""
SELECT concat('https://archive.example.org/docs/T-', {s('text', 'o_orderkey')},
    CASE WHEN o_orderkey % 13 = 0 THEN '_r1' ELSE '' END, '.zip') AS source_url,
  concat('t-', {s('text', 'o_orderkey')}, '.zip') AS filename,
  {s('sha', s('text', 'o_orderkey'))} AS sha256,
  concat('T-', {s('text', 'o_orderkey')}) AS document_id, 'tdoc' AS kind,
  CASE WHEN o_orderkey % 101 = 0 THEN 'failed' WHEN o_orderkey % 37 = 0 THEN 'quarantined'
    WHEN o_orderkey % 29 = 0 THEN 'not_applicable' ELSE 'parsed' END AS parse_status,
  o_custkey AS owner_key, o_orderdate AS observed_at
FROM orders WHERE o_orderkey % 17 <> 0"""
    observations = f"""
SELECT event_id, concat('https://archive.example.org/f/', {s('text', 'user_id')}) AS source_url,
  {s('sha', s('text', s('json', 'props') + ' % 7'))} AS sha256, ts AS observed_at, event_type,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'parsed' WHEN 'click' THEN 'parsed'
    WHEN 'signup' THEN 'not_applicable' ELSE 'quarantined' END AS parse_status
FROM events"""
    return {"meetings": meetings, "lines": lines, "tdocs": tdocs, "artifacts": artifacts,
            "observations": observations}


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL with the derived tables that ``names`` lists (and what they need) in front."""
    made = definitions(DUCK)
    wanted = [n for n in made if n in names or (n == "lines" and "tdocs" in names)]
    clauses = [f"{n} AS ({made[n]})" for n in wanted]
    body = body.strip()
    if not clauses:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(clauses) + ", " + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join(clauses) + ", " + body[len("WITH"):]
    return "WITH " + ", ".join(clauses) + " " + body


#: Bytes by Spark's estimate up to which a table goes to every task, as in Spark's default setting.
FITS = 10 << 20


def _fits(table: DataFrame) -> bool:
    return table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= FITS


def _lists_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``lines`` by document id.

    Lines meet before they are gathered: almost every line of a task belongs to another document, so that
    partial lists would be sorted and written for nothing.
    """
    lines, supplier, part = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    fields = ("s_name", "p_brand", "p_type", "p_size")
    supplied = (F.col("l_suppkey") == F.col("s_suppkey"), "inner")
    supplier = supplier.select("s_suppkey", "s_name")
    late = _fits(supplier)
    if not late:
        lines = lines.join(supplier, *supplied)
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).filter("l_orderkey is not null")
    # Lines go by document id but carry the order's key, which is shorter, and the supplier's key if all suppliers fit
    # into every task. The part's name is apart from the other values, so that lines leave it behind where no title
    # is asked for.
    key = F.concat(F.lit("T-"), F.col("l_orderkey").cast("string"))
    moved = joined.select("l_orderkey", "l_suppkey" if late else "s_name", *fields[1:], "p_name").repartition(key)
    if late:
        moved = moved.join(F.broadcast(supplier), *supplied)
    each = moved.select(key.alias("doc_id"), *[F.col(f).cast("string").alias(f) for f in fields], "p_name")
    gathered = each.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("v"), F.min("p_name").alias("part_name"))
    none = F.array(F.lit(None).cast("string"))
    listed = {name: F.sort_array(F.array_except(F.col("v")[field], none))
              for name, field in (("suppliers", "s_name"), ("brands", "p_brand"), ("types", "p_type"), ("sizes", "p_size"))}
    return gathered.select("doc_id", *[made.alias(name) for name, made in listed.items()], "part_name")


def _tdocs(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """``tdocs`` with the chains found on narrow rows; the lists come last, so that rows lie by document id."""
    start, end = query.index("FROM orders"), query.index("WINDOW chain")
    previous = "lag(o_orderkey) OVER chain"
    placed = f"""SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate, n_nationkey, n_regionkey, {previous} AS previous_key
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
{query[end:]}"""
    for table in ("orders", "customer", "nation"):
        placed = _bound(placed, table)
    chained = spark.sql(placed, **{t: read(spark, sf_dir, t) for t in ("orders", "customer", "nation")})
    whole = query[:start].replace(previous, "previous_key")
    # Rows lie by document id but carry the order's key, which is shorter.
    return spark.sql(whole + "FROM {chained} LEFT JOIN {lists} ON concat('T-', CAST(o_orderkey AS STRING)) = doc_id",
                     chained=chained, lists=_lists_of_lines(spark, sf_dir))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; base tables bind as arguments, nothing is registered."""
    made = definitions(SPARK)
    if name == "tdocs":
        return _tdocs(spark, sf_dir, made[name])
    base = {"meetings": ("nation",), "lines": ("lineitem", "supplier", "part"),
            "artifacts": ("orders",), "observations": ("events",)}[name]
    query = made[name]
    frames = {t: read(spark, sf_dir, t) for t in base}
    for table in frames:
        query = _bound(query, table)
    return spark.sql(query, **frames)


def _bound(query: str, table: str) -> str:
    for word in ("FROM", "JOIN"):
        query = query.replace(f"{word} {table}\n", f"{word} {{{table}}}\n")
        query = query.replace(f"{word} {table} ", f"{word} {{{table}}} ")
        if query.endswith(f"{word} {table}"):
            query = query[: -len(table)] + f"{{{table}}}"
    return query
