"""Registered queries over whole tables, each with the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, text
from ..functions.constants import AUTHORITY_RANK
from ..operators import blocks, briefing, graph, lifecycle, retrieval, search
from ..session import stored
from ..sources import listings, texts
from ..streaming import arrivals
from .domain import derive, oracle, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *derived: str) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = oracle(sql, *derived)
        return build

    return add


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_records(derive(spark, sf_dir, "tdocs"))


#: The same records in DuckDB: ``recs`` with ``companies``, ``specs``, ``rels`` and ``items`` lists.
RECS = r"""recs AS (SELECT *,
  CASE WHEN source = '' THEN [] ELSE list_transform(string_split(regexp_replace(
    regexp_replace(source, ', Inc\.$', '@Inc.'), '[?;,] ', '|', 'g'), '|'),
    lambda c: replace(c, '@Inc.', ', Inc')) END AS companies,
  CASE WHEN specifications_text = '' THEN [] ELSE string_split(specifications_text, '; ') END AS specs,
  CASE WHEN releases_text = '' THEN [] ELSE string_split(releases_text, '; ') END AS rels,
  CASE WHEN work_items_text = '' THEN [] ELSE string_split(work_items_text, '; ') END AS items
  FROM tdocs)"""


def _slug(value: str) -> str:
    return rf"regexp_replace(trim(replace(lower({value}), '/', ' ')), '\s+', '-', 'g')"


# --- scalar functions ---------------------------------------------------------------------------


@query("status_normalized", "SELECT id, status FROM tdocs", "tdocs")
def _(spark, sf):
    return derive(spark, sf, "tdocs").select("id", text.normalize_status(F.col("status_raw")).alias("status"))


@query("multi_value_split", f"""WITH {RECS} SELECT id, len(specs) AS specs, len(rels) AS rels,
  array_to_string(items, '|') AS items FROM recs""", "tdocs")
def _(spark, sf):
    split = lambda c: text.split_multi_value(F.col(c))
    return derive(spark, sf, "tdocs").select(
        "id", F.size(split("specifications_text")).cast("long").alias("specs"),
        F.size(split("releases_text")).cast("long").alias("rels"),
        F.array_join(split("work_items_text"), "|").alias("items"),
    )


@query("org_sources", f"WITH {RECS} SELECT id, array_to_string(companies, '|') AS companies FROM recs", "tdocs")
def _(spark, sf):
    return derive(spark, sf, "tdocs").select(
        "id", F.array_join(text.split_organization_sources(F.col("source")), "|").alias("companies")
    )


@query("org_canonical", f"""WITH {RECS}, each AS (SELECT unnest(companies) AS name FROM recs)
  SELECT name, count(*) AS n FROM each GROUP BY name""", "tdocs")
def _(spark, sf):
    names = text.organizations(F.col("source"))
    return derive(spark, sf, "tdocs").select(F.explode(names).alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("organization_aliases", """SELECT s_name AS name, concat('Org ', s_nationkey) AS canonical FROM supplier""")
def _(spark, sf):
    # An alias table instead of the built-in names: every supplier is an alias of its nation's name.
    suppliers = read(spark, sf, "supplier")
    aliases = suppliers.select(
        F.lower("s_name").alias("alias"), F.concat(F.lit("Org "), "s_nationkey").alias("canonical")
    )
    return text.with_canonical_names(suppliers.select(F.col("s_name").alias("name")), "name", aliases).select(
        "name", "canonical"
    )


@query("alias_conflicts", """SELECT lower(substr(p_name, 1, 3)) AS alias, count(DISTINCT p_brand) AS canonicals
  FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def _(spark, sf):
    aliases = read(spark, sf, "part").select(
        F.substring("p_name", 1, 3).alias("alias"), F.col("p_brand").alias("canonical")
    )
    return text.alias_conflicts(aliases)


@query("column_aliases", """SELECT DISTINCT p_type AS raw, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_')
  AS name FROM part""")
def _(spark, sf):
    return read(spark, sf, "part").select(
        F.col("p_type").alias("raw"), text.normalize_column(F.col("p_type")).alias("name")
    ).distinct()


@query("canonical_ids", f"SELECT DISTINCT p_name AS raw, concat('part:', {_slug('p_name')}) AS id FROM part")
def _(spark, sf):
    return read(spark, sf, "part").select(
        F.col("p_name").alias("raw"), text.typed_id("part", text.canonical_identifier(F.col("p_name"))).alias("id")
    ).distinct()


@query("doc_ids", """SELECT filename, upper(regexp_replace(filename, '\\.[^.]*$', '')) AS id,
  regexp_matches(upper(document_id), '^(R2-|R3-|S2-|C1-)') AS valid FROM artifacts""", "artifacts")
def _(spark, sf):
    return derive(spark, sf, "artifacts").select(
        "filename", text.document_id_of(F.col("filename")).alias("id"),
        text.looks_like_document_id(F.col("document_id")).alias("valid"),
    )


@query("natural_keys", """SELECT id, row_number() OVER (PARTITION BY meeting_id ORDER BY seq) AS place FROM tdocs""", "tdocs")
def _(spark, sf):
    from pyspark.sql import Window as W

    order = W.partitionBy("meeting_id").orderBy(text.natural_key(F.col("id")))
    return derive(spark, sf, "tdocs").select("id", F.row_number().over(order).cast("long").alias("place"))


@query("meeting_numbers", """SELECT id, number, variant FROM meetings""", "meetings")
def _(spark, sf):
    full = F.concat("id", F.when(F.col("variant") != "", F.concat(F.lit("-"), "variant")).otherwise(""))
    return derive(spark, sf, "meetings").select(
        "id", text.meeting_number(full).alias("number"),
        text.normalize_variant(text.meeting_variant(full)).alias("variant"),
    )


@query("tokens", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text),
  '[a-z0-9]+(?:[._/-][a-z0-9]+)*')) AS token FROM documents)
  SELECT token, count(*) AS n, count(DISTINCT doc_id) AS documents FROM t GROUP BY token""")
def _(spark, sf):
    each = read(spark, sf, "documents").select("doc_id", F.explode(text.tokenize(F.col("text"))).alias("token"))
    per = each.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


@query("token_estimate", r"""SELECT doc_id, CAST(CASE WHEN w > 0 THEN greatest(1, floor(w * 1.3)) ELSE 0 END AS INTEGER)
  AS tokens FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\s]+')) AS w FROM documents)""")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("word_windows", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS words FROM documents),
  s AS (SELECT doc_id, words, unnest(range(0, greatest(len(words), 1), 100)) AS start FROM w)
  SELECT doc_id, start // 100 AS window_no, sha256(array_to_string(words[start + 1 : start + 100], ' ')) AS digest FROM s""")
def _(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id", F.posexplode(text.word_windows(F.col("text"), 100)).alias("window_no", "w")
    ).select("doc_id", F.col("window_no").cast("long").alias("window_no"), F.sha2("w", 256).alias("digest"))


@query("number_literals", r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d+(?:\.\d+)*\b')) AS value
  FROM documents) SELECT value, count(*) AS n FROM n GROUP BY value""")
def _(spark, sf):
    return read(spark, sf, "documents").select(F.explode(text.numbers(F.col("text"))).alias("value")).groupBy(
        "value"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("paragraph_kinds", """SELECT role, CASE WHEN role = 'system' THEN 'heading' WHEN role = 'user' THEN 'list_item'
    WHEN starts_with(lower(text), 'note:') THEN 'note' WHEN starts_with(lower(text), 'discussion:') THEN 'discussion'
    WHEN starts_with(lower(text), 'agreement:') THEN 'agreement'
    WHEN starts_with(lower(text), 'conclusion:') THEN 'conclusion' ELSE 'paragraph' END AS kind,
  CASE WHEN role = 'user' THEN 2 ELSE 1 END AS level, count(*) AS n FROM conversations GROUP BY ALL""")
def _(spark, sf):
    style = F.when(F.col("role") == "system", "Heading 1").when(F.col("role") == "user", "List 2").otherwise("Body")
    return read(spark, sf, "conversations").select(
        "role", text.paragraph_kind(F.col("text"), style).alias("kind"),
        text.heading_level(F.lower(style)).alias("level"),
    ).groupBy("role", "kind", "level").agg(F.count(F.lit(1)).alias("n"))


@query("content_ids", """SELECT id,
  concat('artifact-', substr(sha256(concat_ws('|', 'v1', source_url, sha256)), 1, 32)) AS artifact,
  concat('evidence-', substr(sha256(concat_ws('|', 'v1', sha256, id)), 1, 24)) AS evidence,
  concat('edge-', substr(sha256(concat_ws('|', 'v1', 'meeting', 'M', 'contains', 'tdoc', id)), 1, 32)) AS stored_edge,
  concat('edge-', substr(sha256(concat_ws('|', 'meeting:M', 'contains', concat('tdoc:', id))), 1, 32)) AS view_edge
  FROM (SELECT *, document_id AS id FROM artifacts)""", "artifacts")
def _(spark, sf):
    a = derive(spark, sf, "artifacts").withColumn("id", F.col("document_id"))
    c = F.col
    return a.select(
        "id", ids.artifact_id(F.lit("v1"), c("source_url"), c("sha256")).alias("artifact"),
        ids.evidence_id(F.lit("v1"), c("sha256"), c("id")).alias("evidence"),
        ids.stored_edge_id(F.lit("v1"), F.lit("meeting"), F.lit("M"), F.lit("contains"), F.lit("tdoc"), c("id"))
        .alias("stored_edge"),
        ids.view_edge_id(F.lit("meeting:M"), F.lit("contains"), F.concat(F.lit("tdoc:"), c("id"))).alias("view_edge"),
    )


@query("excerpts", """SELECT id, concat_ws(' | ', id, nullif(title, ''), status_raw) AS body,
  substr(concat_ws(' | ', id, nullif(title, ''), status_raw), 1, 500) AS excerpt FROM tdocs""", "tdocs")
def _(spark, sf):
    body = text.row_evidence_text(F.col("id"), F.col("title"), F.col("status_raw"))
    return derive(spark, sf, "tdocs").select("id", body.alias("body"), text.excerpt(body).alias("excerpt"))


@query("body_excerpts", "SELECT doc_id, length(text) AS chars, substr(text, 1, 500) AS excerpt FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id", F.length("text").cast("long").alias("chars"), text.excerpt(F.col("text")).alias("excerpt")
    )


@query("cell_texts", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
  CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS flag, CAST(o_orderkey AS VARCHAR) AS whole,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey // 4 AS VARCHAR) ELSE CAST(o_orderkey / 4 AS VARCHAR) END AS quarter
  FROM orders""")
def _(spark, sf):
    c = F.col
    return read(spark, sf, "orders").select(
        "o_orderkey", text.cell_text(c("o_orderdate").cast("date"), "date").alias("day"),
        text.cell_text(c("o_orderkey") % 2 == 0, "boolean").alias("flag"),
        text.cell_text(c("o_orderkey").cast("double"), "double").alias("whole"),
        text.cell_text(c("o_orderkey").cast("double") / 4, "double").alias("quarter"),
    )


@query("optional_texts", """SELECT o_orderkey, nullif(nullif(trim(substr(o_orderpriority, 2, 1)), ''), '-') AS value
  FROM orders""")
def _(spark, sf):
    return read(spark, sf, "orders").select(
        "o_orderkey", text.optional_text(F.substring("o_orderpriority", 2, 1)).alias("value")
    )


@query("meeting_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS starts_on,
  CAST(o_orderdate AS DATE) + 4 AS ends_on FROM orders""")
def _(spark, sf):
    day = F.col("o_orderdate").cast("date")
    form = lambda c: F.date_format(c, "dd/MM/yyyy")
    written = F.concat(F.lit("Athens, "), form(day), F.lit(" to "), form(F.date_add(day, 4)), F.lit(". Agenda"))
    found = dates.parse_meeting_date_range(written)
    return read(spark, sf, "orders").select("o_orderkey", found.alias("d")).select("o_orderkey", "d.*")


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


# A text per order in one of the five written forms, or without dates; the SQL builds the dates directly.
@query("document_dates", """WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS form, CAST(year(o_orderdate) AS BIGINT) AS y, least(month(o_orderdate), 11) AS m FROM orders)
  SELECT o_orderkey, CASE form WHEN 0 THEN make_date(y, m, 5) WHEN 1 THEN make_date(y, m, 28) WHEN 2 THEN make_date(2000 + y % 100, m, 3)
      WHEN 3 THEN make_date(y, m, 10) WHEN 4 THEN make_date(y, m, 11) END AS starts_on,
    CASE form WHEN 0 THEN make_date(y, m, 9) WHEN 1 THEN make_date(y, m + 1, 2) WHEN 2 THEN make_date(2000 + y % 100, m, 7)
      WHEN 3 THEN make_date(y, m, 14) WHEN 4 THEN make_date(y, m, 15) END AS ends_on FROM o""")
def _(spark, sf):
    orders = read(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 6).alias("form"), F.year("o_orderdate").cast("string").alias("y"),
        F.least(F.month("o_orderdate"), F.lit(11)).alias("m"),
    )
    names = F.array(*[F.lit(n) for n in _MONTHS])
    name, after = F.get(names, F.col("m") - 1), F.get(names, F.col("m"))
    forms = {
        0: ("Held 05/%d/%s  to 09/%d/%s in Town", "m", "y", "m", "y"), 1: ("on 28 %s - 2 %s %s.", name, after, "y"),
        2: ("R2-%s00123 Agenda, %s 3rd – 7th", F.substring("y", 3, 2), name), 3: ("from Monday 10 to Friday 14 of %s, %s", name, "y"),
        4: ("Meeting 40: 11-15 %s %s", name, "y"),
    }
    body = F.lit("no dates, only 12 items")
    for form, (pattern, *parts) in forms.items():
        body = F.when(F.col("form") == form, F.format_string(pattern, *parts)).otherwise(body)
    found = dates.parse_meeting_date_range(body)
    return orders.select("o_orderkey", found.alias("d")).select("o_orderkey", "d.starts_on", "d.ends_on")


# --- text sources and blocks --------------------------------------------------------------------


@query("text_paragraphs", r"""SELECT doc_id, 0 AS position,
  sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> ''), ' '))
  AS digest FROM documents WHERE trim(text) <> ''""")
def _(spark, sf):
    plain = texts.decode_bytes(F.col("text").cast("binary"))
    return read(spark, sf, "documents").select(
        "doc_id", F.posexplode(texts.paragraphs(plain)).alias("position", "p")
    ).select("doc_id", "position", F.sha2("p", 256).alias("digest"))


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as block arrays, one block per line."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.transform(
            texts.lines(F.col("text")),
            lambda p: texts.block_struct(F.lit("paragraph"), p, F.expr(texts.NO_PATH)),
        ).alias("blocks"),
    )


_LINES = r"""lines_of AS (SELECT CAST(doc_id AS VARCHAR) AS document_id,
  list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ls FROM documents)"""


@query("source_blocks", f"""WITH {_LINES}, b AS (SELECT document_id, unnest(ls) AS text,
    unnest(range(0, len(ls))) AS block_index FROM lines_of)
  SELECT document_id, CAST(block_index AS INTEGER) AS block_index,
    concat('block-', substr(sha256(concat_ws('|', document_id, block_index, text)), 1, 20)) AS id FROM b""")
def _(spark, sf):
    return texts.explode_source_blocks(line_blocks(spark, sf)).select("document_id", "block_index", "id")


# Greedy packing in recursive SQL: a block closes before it would pass the maximum or once it reaches the
# target, and a line above the maximum is cut into word windows first; one step per element.
@query("evidence_blocks", rf"""WITH RECURSIVE {_LINES}, e AS (SELECT document_id, flatten(list_transform(ls, lambda l:
    CASE WHEN floor(len(regexp_extract_all(l, '[^\s]+')) * 1.3) > 1400 THEN list_transform(range(0, len(regexp_extract_all(l, '[^\s]+')), 1076),
      lambda s: array_to_string(regexp_extract_all(l, '[^\s]+')[s + 1 : s + 1076], ' ')) ELSE [l] END)) AS ls FROM lines_of WHERE len(ls) > 0),
  w AS (SELECT document_id, ls, list_transform(ls,
    lambda l: CAST(greatest(1, floor(len(regexp_extract_all(l, '[^\s]+')) * 1.3)) AS BIGINT)) AS toks FROM e),
  walk AS (
    SELECT document_id, 1 AS i, 1 AS grp, toks[1] AS total, toks[1] >= 1000 AS closed FROM w
    UNION ALL
    SELECT k.document_id, k.i + 1, CASE WHEN k.closed OR k.total + w.toks[k.i + 1] > 1400 THEN k.grp + 1 ELSE k.grp END,
      CASE WHEN k.closed OR k.total + w.toks[k.i + 1] > 1400 THEN w.toks[k.i + 1] ELSE k.total + w.toks[k.i + 1] END,
      CASE WHEN k.closed OR k.total + w.toks[k.i + 1] > 1400 THEN w.toks[k.i + 1] ELSE k.total + w.toks[k.i + 1] END >= 1000
    FROM walk k JOIN w ON k.document_id = w.document_id WHERE k.i < len(w.toks))
  SELECT k.document_id, CAST(k.grp - 1 AS INTEGER) AS block_index, count(*) AS elements,
    sha256(string_agg(w.ls[k.i], chr(10) || chr(10) ORDER BY k.i)) AS digest
  FROM walk k JOIN w ON k.document_id = w.document_id GROUP BY k.document_id, k.grp""")
def _(spark, sf):
    packed = blocks.explode_blocks(blocks.coalesce_blocks(line_blocks(spark, sf)))
    return packed.select(
        "document_id", "block_index",
        F.size(F.split("text", "\n\n")).cast("long").alias("elements"), F.sha2("text", 256).alias("digest"),
    )


@query("chunks", None)
def _(spark, sf):
    made = blocks.build_chunks(blocks.coalesce_blocks(line_blocks(spark, sf)))
    return made.select("id", "document_id", "chunk_index", "token_count", F.sha2("text", 256).alias("digest"))


@query("chunk_words", r"""SELECT CAST(doc_id AS VARCHAR) AS document_id, len(regexp_extract_all(text, '[^\s]+')) AS words
  FROM documents WHERE trim(text) <> ''""")
def _(spark, sf):
    # Chunks hold every word of a document exactly once.
    made = blocks.build_chunks(blocks.coalesce_blocks(line_blocks(spark, sf)))
    return made.groupBy("document_id").agg(F.sum(text.word_count(F.col("text"))).cast("long").alias("words"))


def turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as block rows under role sections."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("block_index"),
        F.array(F.lit("Turns"), F.col("role")).alias("section_path"), "text",
    )


@query("section_tree", """WITH b AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn, role FROM conversations),
  s AS (SELECT document_id, '' AS path, 0 AS depth, turn, 0 AS own FROM b
    UNION ALL SELECT document_id, 'Turns', 1, turn, 0 FROM b
    UNION ALL SELECT document_id, concat('Turns/', role), 2, turn, 1 FROM b)
  SELECT document_id, path, CAST(depth AS INTEGER) AS depth, CAST(min(turn) AS INTEGER) AS start_block_index,
    CAST(max(turn) AS INTEGER) AS end_block_index, CAST(sum(own) AS BIGINT) AS direct_block_count,
    count(*) AS descendant_block_count,
    CASE depth WHEN 0 THEN 1 WHEN 1 THEN (SELECT count(DISTINCT role) FROM b x WHERE x.document_id = s.document_id) ELSE 0 END
      AS child_count,
    concat('section-', substr(sha256(concat(document_id, '|', path)), 1, 20)) AS id
  FROM s GROUP BY document_id, path, depth""")
def _(spark, sf):
    tree = blocks.section_tree(turn_blocks(spark, sf))
    return tree.select(
        "document_id", F.array_join("section_path", "/").alias("path"), "depth", "start_block_index",
        "end_block_index", "direct_block_count", "descendant_block_count", "child_count", "id",
    )


@query("block_page", """WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id)
  SELECT CAST(c.conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS block_index,
    CASE WHEN last >= 4 THEN 'partial' ELSE 'complete' END AS completeness, CASE WHEN last >= 4 THEN 4 END AS next_start
  FROM conversations c JOIN m ON c.conv_id = m.conv_id WHERE turn BETWEEN 2 AND 3""")
def _(spark, sf):
    return blocks.page_of_blocks(turn_blocks(spark, sf), 2, 2).select(
        "document_id", "block_index", "completeness", "next_start"
    )


@query("styled_sections", """WITH s AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'user' THEN turn END) OVER
    (PARTITION BY conv_id ORDER BY turn) AS head FROM conversations WHERE trim(text) <> '')
  SELECT CAST(s.conv_id AS VARCHAR) AS document_id, CAST(row_number() OVER (PARTITION BY s.conv_id ORDER BY s.turn) - 1 AS INTEGER)
    AS block_index, CASE WHEN s.role = 'user' THEN 'heading' ELSE 'paragraph' END AS kind,
    CASE WHEN h.text IS NULL THEN 0 ELSE 1 END AS depth, sha256(coalesce(trim(h.text, chr(10) || ' '), '')) AS section
  FROM s LEFT JOIN conversations h ON h.conv_id = s.conv_id AND h.turn = s.head""")
def _(spark, sf):
    paragraph = F.struct(
        F.col("turn"), F.when(F.col("role") == "user", "Heading 1").otherwise("Body").alias("style"), F.col("text")
    )
    docs = read(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("document_id")).agg(
        F.sort_array(F.collect_list(paragraph)).alias("paragraphs")
    )
    rows = texts.explode_source_blocks(texts.styled_blocks(docs))
    return rows.select(
        "document_id", "block_index", "kind", F.size("section_path").alias("depth"),
        F.sha2(F.array_join("section_path", "/"), 256).alias("section"),
    )


@query("sheet_blocks", """SELECT CAST(s_nationkey AS VARCHAR) AS document_id,
  CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS block_index,
  concat_ws(' | ', s_name, CAST(s_suppkey AS VARCHAR)) AS text FROM supplier WHERE s_suppkey % 3 <> 0""")
def _(spark, sf):
    grid = read(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("string").alias("document_id"), F.lit(0).alias("sheet_no"),
        F.when(F.col("s_suppkey") % 3 == 0, "Registration").otherwise("List").alias("sheet"),
        F.col("s_suppkey").alias("row_no"), F.array("s_name", F.lit(" "), F.col("s_suppkey").cast("string")).alias("cells"),
    )
    return texts.explode_source_blocks(texts.sheet_blocks(grid)).select("document_id", "block_index", "text")


@query("slide_blocks", """WITH p AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, turn // 2) AS t FROM conversations
    WHERE trim(text) <> '')
  SELECT CAST(conv_id AS VARCHAR) AS document_id,
    CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS block_index,
    CASE WHEN turn = t THEN 'heading' ELSE 'list_item' END AS kind, concat('Slide ', turn // 2) AS slide FROM p""")
def _(spark, sf):
    shapes = read(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.floor(F.col("turn") / 2).alias("slide"),
        F.lit(0).alias("shape"), F.col("turn").alias("para"), F.lit(False).alias("is_title"),
        F.lit(True).alias("is_list"), "text", F.lit(None).cast("array<string>").alias("cells"),
    )
    rows = texts.explode_source_blocks(texts.slide_blocks(shapes))
    return rows.select("document_id", "block_index", "kind", F.col("section_path")[0].alias("slide"))


@query("page_blocks", """SELECT CAST(conv_id AS VARCHAR) AS document_id,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS block_index,
  concat('Page ', turn) AS title, CAST(turn AS INTEGER) AS page FROM conversations WHERE trim(text) <> ''""")
def _(spark, sf):
    pages = read(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("page"), "text"
    )
    rows = texts.explode_source_blocks(texts.page_blocks(pages))
    title = F.col("section_path")[0]
    return rows.select("document_id", "block_index", title.alias("title"), text.page_number(title).alias("page"))


@query("member_reindex", """SELECT CAST(conv_id AS VARCHAR) AS document_id,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS block_index, role
  FROM conversations WHERE role <> 'system'""")
def _(spark, sf):
    name = F.when(F.col("role") == "system", "__MACOSX/._a.txt").otherwise(F.concat(F.lit("m"), "turn", F.lit(".txt")))
    members = read(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("member_no"), name.alias("filename"),
        F.array(texts.block_struct(F.col("role"), F.col("role"), F.expr(texts.NO_PATH))).alias("blocks"),
    )
    rows = texts.explode_source_blocks(texts.merge_members(texts.usable_members(members)))
    return rows.select("document_id", "block_index", F.col("kind").alias("role"))


@query("large_documents", """SELECT CAST(conv_id AS VARCHAR) AS document_id, count(*) AS elements FROM conversations
  GROUP BY conv_id HAVING count(*) > 6""")
def _(spark, sf):
    return texts.large_documents(turn_blocks(spark, sf), 6)


@query("group_kinds", """SELECT role, CASE role WHEN 'system' THEN 'table' WHEN 'user' THEN 'body' ELSE 'note' END AS grp,
  count(*) AS n FROM conversations GROUP BY role""")
def _(spark, sf):
    kind = F.when(F.col("role") == "system", "table_row").when(F.col("role") == "user", "list_item").otherwise("note")
    return read(spark, sf, "conversations").select("role", text.group_type(kind).alias("grp")).groupBy("role", "grp").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- meetings, documents, facets ------------------------------------------------------------------


@query("meetings_by_group", "SELECT id, ends_on, number FROM meetings WHERE working_group_id IN ('WG1', 'WG3')", "meetings")
def _(spark, sf):
    return search.meetings_in(derive(spark, sf, "meetings"), groups=("WG1", "WG3")).select("id", "ends_on", "number")


@query("meetings_last_k", "SELECT id, ends_on FROM meetings ORDER BY ends_on DESC NULLS LAST, number DESC, id LIMIT 7",
       "meetings")
def _(spark, sf):
    return search.meetings_in(derive(spark, sf, "meetings"), search.TemporalScope(last_k=7)).select("id", "ends_on")


@query("meetings_months", "SELECT id FROM meetings WHERE ends_on >= DATE '1999-06-30' - 372", "meetings")
def _(spark, sf):
    scope = search.TemporalScope(last_months=12)
    return search.meetings_in(derive(spark, sf, "meetings"), scope, as_of="1999-06-30").select("id")


@query("meetings_overlap", """SELECT id FROM meetings WHERE ends_on >= DATE '1997-01-01' AND starts_on <= DATE '1998-06-01'""",
       "meetings")
def _(spark, sf):
    scope = search.TemporalScope(starts="1997-01-01", ends="1998-06-01")
    return search.meetings_in(derive(spark, sf, "meetings"), scope).select("id")


@query("meetings_undated", "SELECT id FROM meetings WHERE starts_on IS NULL OR ends_on IS NULL", "meetings")
def _(spark, sf):
    return search.undated(derive(spark, sf, "meetings")).select("id")


@query("meetings_with_counts", """SELECT m.id, count(t.id) AS tdoc_count FROM meetings m LEFT JOIN tdocs t
  ON t.meeting_id = m.id GROUP BY m.id""", "meetings", "tdocs")
def _(spark, sf):
    return search.with_counts(derive(spark, sf, "meetings"), derive(spark, sf, "tdocs")).select("id", "tdoc_count")


@query("meetings_page", """SELECT id, true AS has_more FROM (SELECT id FROM meetings
  ORDER BY ends_on DESC NULLS LAST, number DESC, id LIMIT 5 OFFSET 5)""", "meetings")
def _(spark, sf):
    return search.page(derive(spark, sf, "meetings"), search.meeting_order(), 5, 5).select("id", "has_more")


@query("tdoc_text_search", """SELECT id FROM tdocs WHERE contains(lower(id), 'red') OR contains(lower(title), 'red')""", "tdocs")
def _(spark, sf):
    return derive(spark, sf, "tdocs").filter(search.with_text(["id", "title"], "Red")).select("id")


@query("tdoc_text_concat", "SELECT id FROM tdocs WHERE contains(lower(concat_ws(' ', id, title)), '1 blue')", "tdocs")
def _(spark, sf):
    return derive(spark, sf, "tdocs").filter(search.with_text(["id", "title"], "1 Blue", "concat")).select("id")


@query("tdoc_substrings_all", f"""WITH {RECS} SELECT id FROM recs WHERE contains(lower(source), '00001')
  AND len(list_filter(specs, lambda s: contains(lower(s), 'brand#1'))) > 0""", "tdocs")
def _(spark, sf):
    return records(spark, sf).filter(
        search.with_substrings(companies=("00001",), specifications=("Brand#1",))
    ).select("id")


@query("tdoc_substrings_any", f"""WITH {RECS} SELECT id FROM recs WHERE contains(lower(source), '000012')
  OR len(list_filter(rels, lambda s: contains(lower(s), 'promo'))) > 0 OR contains(lower(agenda_description), 'urgent')""",
       "tdocs")
def _(spark, sf):
    return records(spark, sf).filter(
        search.with_substrings(companies=("000012",), releases=("promo",), topics=("urgent",), match="any")
    ).select("id")


@query("tdoc_facets_all", f"""WITH {RECS} SELECT id FROM recs WHERE agenda_description = '1-URGENT'
  AND list_contains(specs, 'Brand#13')""", "tdocs")
def _(spark, sf):
    return search.facet_ids(records(spark, sf)).filter(
        search.with_facets(topics=("1-urgent",), specifications=("brand#13",))
    ).select("id")


@query("tdoc_facets_any", f"""WITH {RECS} SELECT id FROM recs WHERE agenda_description = '5-LOW'
  OR list_contains(specs, 'Brand#25') OR list_contains(companies, 'Supplier#000000007')""", "tdocs")
def _(spark, sf):
    return search.facet_ids(records(spark, sf)).filter(
        search.with_facets(companies=("supplier#000000007",), topics=("5-low",), specifications=("brand#25",), match="any")
    ).select("id")


@query("tdoc_decisions", """SELECT id, status FROM tdocs WHERE status IN ('agreed', 'approved', 'rejected', 'not_pursued',
  'postponed', 'revised')""", "tdocs")
def _(spark, sf):
    return records(spark, sf).filter(search.decisions()).select("id", "status")


@query("tdoc_actionable", """SELECT id FROM tdocs WHERE status NOT IN ('reserved', 'withdrawn', 'revised', 'not_pursued')""",
       "tdocs")
def _(spark, sf):
    return records(spark, sf).filter(search.actionable()).select("id")


@query("tdoc_in_scope", """SELECT id FROM tdocs WHERE meeting_id IN (SELECT id FROM meetings
  ORDER BY ends_on DESC NULLS LAST, number DESC, id LIMIT 3)""", "meetings", "tdocs")
def _(spark, sf):
    chosen = search.meetings_in(derive(spark, sf, "meetings"), search.TemporalScope(last_k=3))
    return search.of_meetings(derive(spark, sf, "tdocs"), chosen).select("id")


@query("tdoc_lookup", "SELECT id, title FROM tdocs WHERE lower(id) = 't-77'", "tdocs")
def _(spark, sf):
    return search.by_id(derive(spark, sf, "tdocs"), "t-77").select("id", "title")


@query("group_scope", """SELECT working_group_id, count(*) AS tdocs, count(DISTINCT meeting_id) AS meetings FROM tdocs
  GROUP BY working_group_id""", "tdocs")
def _(spark, sf):
    documents, meetings = derive(spark, sf, "tdocs").drop("working_group_id"), derive(spark, sf, "meetings")
    joined = documents.join(
        meetings.select(F.col("id").alias("meeting_id"), "working_group_id"), "meeting_id"
    )
    return joined.groupBy("working_group_id").agg(
        F.count(F.lit(1)).alias("tdocs"), F.count_distinct("meeting_id").alias("meetings")
    )


@query("passage_scope", "SELECT id FROM tdocs WHERE id IN ('T-5', 'T-6') OR meeting_id = 'WG1-2'", "tdocs")
def _(spark, sf):
    return search.scoped_documents(derive(spark, sf, "tdocs"), ("T-5", "T-6"), ("WG1-2",))


def _facet_sql(values: str, needle: str, limit: int) -> str:
    return f"""WITH {RECS}, e AS (SELECT DISTINCT id, seq, unnest({values}) AS label FROM recs),
  o AS (SELECT {_slug('label')} AS option, arg_min(label, seq) AS label, count(DISTINCT id) AS tdoc_count FROM e GROUP BY 1)
  SELECT option AS id, label, tdoc_count FROM o WHERE contains(lower(label), '{needle}')
  ORDER BY CASE WHEN lower(label) = '{needle}' AND '{needle}' <> '' THEN 0 WHEN starts_with(lower(label), '{needle}') THEN 1
    ELSE 2 END, tdoc_count DESC, lower(label), option LIMIT {limit}"""


@query("facet_company", _facet_sql("companies", "000000", 25), "tdocs")
def _(spark, sf):
    return search.facet_options(records(spark, sf), F.col("companies"), "000000", 25)


@query("facet_topic", _facet_sql("[agenda_description]", "", 10), "tdocs")
def _(spark, sf):
    return search.facet_options(records(spark, sf), F.array("agenda_description"), "", 10)


@query("facet_spec", _facet_sql("specs", "brand#1", 10), "tdocs")
def _(spark, sf):
    return search.facet_options(records(spark, sf), F.col("specifications"), "Brand#1", 10)


@query("status_counts", "SELECT status, count(*) AS n FROM tdocs GROUP BY status", "tdocs")
def _(spark, sf):
    return search.counted(records(spark, sf), "status", "status")


@query("company_counts", """WITH c AS (SELECT unnest(list_filter(list_transform(string_split(source, ','), lambda v: trim(v)),
    lambda v: v <> '')) AS company FROM tdocs) SELECT company, count(*) AS n FROM c GROUP BY company""", "tdocs")
def _(spark, sf):
    names = F.filter(F.transform(F.split("source", ","), text.strip), lambda v: v != "")
    return search.counted(derive(spark, sf, "tdocs").select(F.explode(names).alias("company")), "company", "company")


@query("topic_counts", "SELECT agenda_description AS topic, count(*) AS n FROM tdocs GROUP BY 1", "tdocs")
def _(spark, sf):
    return search.counted(records(spark, sf), "agenda_description", "topic")


@query("spec_counts", f"WITH {RECS}, s AS (SELECT unnest(specs) AS spec FROM recs) SELECT spec, count(*) AS n FROM s GROUP BY spec",
       "tdocs")
def _(spark, sf):
    return search.counted(records(spark, sf).select(F.explode("specifications").alias("spec")), "spec", "spec")


# --- retrieval --------------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+(?:[._/-][a-z0-9]+)*')"
_LEXICAL = f"""q AS (SELECT item_id AS query_id, lower(trim(text)) AS phrase, list_distinct({_TOKENS.format('text')}) AS toks
    FROM benchmark),
  d AS (SELECT doc_id AS id, lower(text) AS low, {_TOKENS.format('text')} AS toks FROM documents),
  dt AS (SELECT id, tok, least(count(*), 3) AS tf FROM (SELECT id, unnest(toks) AS tok FROM d) GROUP BY id, tok),
  qt AS (SELECT query_id, unnest(toks) AS tok, len(toks) AS n FROM q),
  m AS (SELECT query_id, id, sum(tf) + count(*) / any_value(n) AS s FROM qt JOIN dt USING (tok) GROUP BY query_id, id),
  lex AS (SELECT m.query_id, m.id, m.s + CASE WHEN contains(d.low, q.phrase) THEN 1.0 ELSE 0.0 END AS score
    FROM m JOIN q USING (query_id) JOIN d USING (id)),
  lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM lex)"""
_VECTOR = """vq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0),
  v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  vs AS (SELECT query_id, id, list_cosine_similarity(vq.e, v.e) AS score FROM vq, v),
  vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM vs)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100, against all vectors."""
    return read(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(
        F.col("vec_id").alias("query_id"), "embedding"
    )


@query("lexical_topk", f"WITH {_LEXICAL} SELECT query_id, id, round(score, 6) AS score, rank FROM lr WHERE rank <= 10")
def _(spark, sf):
    best = retrieval.ranked(retrieval.lexical_scores(asked(spark, sf), bodies(spark, sf), 10), 10)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_topk", f"WITH {_VECTOR} SELECT query_id, id, round(score, 6) AS score, rank FROM vr WHERE rank <= 10")
def _(spark, sf):
    best = retrieval.vector_scores(vector_queries(spark, sf), vectors(spark, sf), 10)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_valid", """SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AS valid
  FROM embeddings""")
def _(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", text.vector_is_valid(F.col("embedding"), 64).alias("valid"))


@query("rrf_fused", f"""WITH {_LEXICAL}, other AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id)
    AS rank FROM lex), f AS (SELECT query_id, id, 1.0 / (60 + rank) AS p FROM lr UNION ALL SELECT query_id, id,
    0.5 / (60 + rank) FROM other), s AS (SELECT query_id, id, sum(p) AS score FROM f GROUP BY query_id, id)
  SELECT query_id, id, round(score, 9) AS score FROM s
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10""")
def _(spark, sf):
    scores = stored(retrieval.lexical_scores(asked(spark, sf), bodies(spark, sf)))
    # Equal scores rank by id, so a constant score is the ranking by id.
    by_id = scores.withColumn("score", F.lit(0.0))
    best = retrieval.fused_best([(scores, 1.0), (by_id, 0.5)], 10)
    return best.select("query_id", "id", F.round("score", 9).alias("score"))


_HYBRID_VECTOR = _VECTOR.replace("vec_id % 100 = 0", "vec_id IN (SELECT item_id FROM benchmark)").replace(
    "FROM embeddings),\n  vs", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),\n  vs"
)
_HYBRID = f"""{_LEXICAL}, {_HYBRID_VECTOR},
  f AS (SELECT query_id, id, 1.0 / (60 + rank) AS p FROM lr UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM vr),
  s AS (SELECT query_id, id, sum(p) AS score FROM f GROUP BY query_id, id)"""


def hybrid_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items with the vector of their number, and documents with the vector of theirs."""
    known = vectors(spark, sf_dir)
    queries = asked(spark, sf_dir).join(known.withColumnRenamed("id", "query_id"), "query_id", "left")
    return queries, bodies(spark, sf_dir).join(known, "id", "left")


@query("hybrid_topk", f"""WITH {_HYBRID} SELECT query_id, id, round(score, 9) AS score FROM s
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5""")
def _(spark, sf):
    best = retrieval.hybrid(*hybrid_inputs(spark, sf), k=5)
    return best.select("query_id", "id", F.round("score", 9).alias("score"))


_RANKS = tuple(AUTHORITY_RANK)


def evidence_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two evidence rows per document with their authority's weight."""
    names = F.array(*[F.lit(n) for n in _RANKS])
    pick = lambda by: F.element_at(names, (F.pmod(F.floor(F.col("doc_id") / by), F.lit(6)) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.explode(F.array(pick(1), pick(7))).alias("authority")
    ).select("id", text.authority_weight(F.col("authority")).alias("weight"))


@query("hybrid_authority", f"""WITH {_HYBRID}, w AS (SELECT doc_id AS id,
    greatest([1.0, 0.9, 0.8, 0.7, 0.6, 0.1][doc_id % 6 + 1], [1.0, 0.9, 0.8, 0.7, 0.6, 0.1][(doc_id // 7) % 6 + 1]) AS w FROM documents),
  a AS (SELECT query_id, id, score * w AS score FROM s JOIN w USING (id))
  SELECT query_id, id, round(score, 9) AS score FROM a
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5""")
def _(spark, sf):
    best = retrieval.hybrid(*hybrid_inputs(spark, sf), k=5, evidence=evidence_weights(spark, sf))
    return best.select("query_id", "id", F.round("score", 9).alias("score"))


@query("fulltext_match", f"""WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)
  SELECT doc_id FROM d WHERE (list_contains(t, 'with') OR list_contains(t, 'pour'))
    AND NOT list_contains(t, 'from') AND contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')""")
def _(spark, sf):
    return read(spark, sf, "documents").filter(
        retrieval.matches_fulltext(F.col("text"), 'with or pour -from "of the"')
    ).select("doc_id")


@query("reranked", f"""WITH {_LEXICAL}, c AS (SELECT query_id, id, rank AS position FROM lr WHERE rank <= 5)
  SELECT query_id, id, position, true AS valid, row_number() OVER (PARTITION BY query_id ORDER BY id % 7 DESC, position) AS rank FROM c""")
def _(spark, sf):
    best = retrieval.ranked(retrieval.lexical_scores(asked(spark, sf), bodies(spark, sf), 5), 5).select(
        "query_id", "id", F.col("rank").cast("long").alias("position")
    )
    given = best.select("query_id", "position", (F.col("id") % 7).cast("double").alias("score"))
    return retrieval.reranked(given, best).select(
        "query_id", "id", "position", "valid", F.col("rank").cast("long").alias("rank")
    )


@query("passages_no_query", "SELECT CAST(doc_id AS BIGINT) AS id, 1.0::DOUBLE AS score FROM documents ORDER BY doc_id LIMIT 10")
def _(spark, sf):
    return bodies(spark, sf).orderBy("id").limit(10).select("id", F.lit(1.0).alias("score"))


# --- graph --------------------------------------------------------------------------------------------

_FACTS = f"""{RECS}, facts AS (
  SELECT id AS tdoc_id, meeting_id, seq, 0 AS pos, 'tdoc' AS type, id AS entity, coalesce(nullif(title, ''), id) AS label,
    'contains' AS predicate, false AS placeholder FROM recs
  UNION ALL SELECT id, meeting_id, seq, 1, 'organization', {_slug('c')}, c, 'submitted_by', false
    FROM (SELECT *, unnest(companies) AS c FROM recs)
  UNION ALL SELECT id, meeting_id, seq, 2, 'agenda_item', concat(meeting_id, ':', {_slug('agenda_item')}), agenda_description,
    'belongs_to_agenda', false FROM recs
  UNION ALL SELECT id, meeting_id, seq, 3, 'topic', {_slug('agenda_description')}, agenda_description, 'mentions_topic', false FROM recs
  UNION ALL SELECT id, meeting_id, seq, 4, 'specification', {_slug('c')}, c, 'affects_spec', false FROM (SELECT *, unnest(specs) AS c FROM recs)
  UNION ALL SELECT id, meeting_id, seq, 5, 'release', {_slug('c')}, c, 'targets_release', false FROM (SELECT *, unnest(rels) AS c FROM recs)
  UNION ALL SELECT id, meeting_id, seq, 6, 'work_item', {_slug('c')}, c, 'related_to_work_item', false FROM (SELECT *, unnest(items) AS c FROM recs)
  UNION ALL SELECT id, meeting_id, seq, 7, 'change_request', concat(meeting_id, ':', cr_number), concat('CR ', cr_number),
    'has_change_request', false FROM recs WHERE cr_number IS NOT NULL
  UNION ALL SELECT id, meeting_id, seq, 8, 'tdoc', revised_from, revised_from, 'revises', true FROM recs WHERE revised_from IS NOT NULL)"""
_NODES = """nodes AS (SELECT type, entity, arg_min(label, (placeholder, seq)) AS label, bool_and(placeholder) AS placeholder
    FROM facts GROUP BY type, entity UNION ALL SELECT 'meeting', id, name, false FROM meetings)"""
_EDGES = """edges AS (SELECT DISTINCT CASE WHEN predicate = 'contains' THEN 'meeting' ELSE 'tdoc' END AS source_type,
    CASE WHEN predicate = 'contains' THEN meeting_id ELSE tdoc_id END AS source_id, predicate, type AS target_type,
    entity AS target_id FROM facts)"""


def found_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.facts(records(spark, sf_dir))


def kept_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct facts without labels, for queries that go over them more than once and show no label."""
    return graph.distinct_facts(records(spark, sf_dir))


@query("graph_nodes", f"WITH {_FACTS}, {_NODES} SELECT * FROM nodes", "meetings", "tdocs")
def _(spark, sf):
    return graph.nodes(found_facts(spark, sf), derive(spark, sf, "meetings"))


@query("graph_edges", f"""WITH {_FACTS}, {_EDGES} SELECT *, concat('edge-', substr(sha256(concat_ws('|', 'v1', source_type, source_id,
  predicate, target_type, target_id)), 1, 32)) AS id FROM edges""", "tdocs")
def _(spark, sf):
    return graph.edges(found_facts(spark, sf))


@query("scope_graph_nodes", f"""WITH {_FACTS.replace('FROM tdocs)', "FROM tdocs WHERE working_group_id = 'WG2')")},
  {_NODES.replace('FROM meetings)', "FROM meetings WHERE working_group_id = 'WG2')")}
  SELECT concat(type, ':', entity) AS id, type, entity, label, placeholder AS boundary FROM nodes""", "meetings", "tdocs")
def _(spark, sf):
    meetings = search.meetings_in(derive(spark, sf, "meetings"), groups=("WG2",))
    return graph.scope_nodes(graph.facts(search.of_meetings(records(spark, sf), meetings)), meetings)


@query("scope_graph_edges", f"""WITH {_FACTS.replace('FROM tdocs)', "FROM tdocs WHERE meeting_id = 'WG1-1')")}, {_EDGES}
  SELECT concat('edge-', substr(sha256(concat(source_type, ':', source_id, '|', predicate, '|', target_type, ':', target_id)), 1, 32)) AS id,
    concat(source_type, ':', source_id) AS source, concat(target_type, ':', target_id) AS target, predicate AS type FROM edges""",
       "tdocs")
def _(spark, sf):
    meetings = search.meetings_in(derive(spark, sf, "meetings"), search.TemporalScope(meeting_ids=("WG1-1",)))
    return graph.scope_edges(graph.facts(search.of_meetings(records(spark, sf), meetings)), meetings)


@query("graph_counts", f"""WITH {_FACTS}, {_NODES}, {_EDGES} SELECT (SELECT count(*) FROM nodes) AS nodes,
  (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM tdocs) AS tdocs, (SELECT count(*) FROM meetings) AS meetings""",
       "meetings", "tdocs")
def _(spark, sf):
    found, meetings = kept_facts(spark, sf), derive(spark, sf, "meetings")
    parts = {"nodes": graph.nodes(found, meetings), "edges": graph.edges(found), "tdocs": derive(spark, sf, "tdocs"),
             "meetings": meetings}
    rows = None
    for name, frame in parts.items():
        one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in parts])


@query("graph_orphans", f"""WITH {_FACTS}, {_NODES}, {_EDGES}, kept AS (SELECT * FROM nodes WHERE NOT (type = 'organization'
    AND contains(entity, '00007'))), k AS (SELECT *, concat('edge-', substr(sha256(concat_ws('|', 'v1', source_type, source_id,
    predicate, target_type, target_id)), 1, 32)) AS id FROM edges)
  SELECT id, 'orphan target' AS problem FROM k WHERE NOT EXISTS (SELECT 1 FROM kept WHERE type = target_type AND entity = target_id)
  UNION ALL SELECT id, 'orphan source' FROM k WHERE NOT EXISTS (SELECT 1 FROM kept WHERE type = source_type AND entity = source_id)""",
       "meetings", "tdocs")
def _(spark, sf):
    # A planted fault: some organisations are missing from the nodes.
    found = kept_facts(spark, sf)
    kept = graph.nodes(found, derive(spark, sf, "meetings")).filter(
        ~((F.col("type") == "organization") & F.contains("entity", F.lit("00007")))
    )
    return graph.orphans(graph.edges(found), kept)


@query("containment_check", """SELECT target_id, n FROM (SELECT id AS target_id, 2 AS n, seq FROM tdocs) WHERE seq % 50 = 0""", "tdocs")
def _(spark, sf):
    # A planted fault: every fiftieth document is also contained by a second meeting.
    documents = records(spark, sf)
    twice = documents.filter("seq % 50 = 0").withColumn("meeting_id", F.lit("WG9-99"))
    return graph.containment_faults(graph.edges(graph.facts(documents.unionByName(twice)))).select(
        "target_id", F.col("n").cast("int").alias("n")
    )


@query("graph_bounded", f"""WITH {_FACTS}, {_EDGES} SELECT source_id, predicate, target_id FROM edges WHERE target_type = 'topic'""", "tdocs")
def _(spark, sf):
    found = kept_facts(spark, sf)
    some = graph.nodes(found, derive(spark, sf, "meetings")).filter(
        F.col("type").isin("tdoc", "topic") & ~F.col("placeholder")
    )
    return graph.within(graph.edges(found), some).filter("predicate <> 'revises'").select(
        "source_id", "predicate", "target_id"
    )


@query("revision_stats", """SELECT count(*) AS revision_edges, count(*) FILTER (WHERE p.meeting_id <> t.meeting_id) AS cross_meeting_edges
  FROM tdocs t LEFT JOIN tdocs p ON p.id = t.revised_from WHERE t.revised_from IS NOT NULL""", "tdocs")
def _(spark, sf):
    return graph.revision_stats(derive(spark, sf, "tdocs"))


@query("revision_chains", """WITH RECURSIVE walk AS (SELECT id, id AS root, CAST(1 AS BIGINT) AS depth FROM tdocs WHERE revised_from IS NULL
  UNION ALL SELECT t.id, w.root, w.depth + 1 FROM walk w JOIN tdocs t ON t.revised_from = w.id)
  SELECT id, root, depth, false AS is_cyclic FROM walk""", "tdocs")
def _(spark, sf):
    return graph.chain_places(derive(spark, sf, "tdocs").select("id", F.col("revised_from").alias("previous")))


@query("graph_cycles", """WITH RECURSIVE link AS (SELECT id, CASE WHEN seq = 3 THEN 'T-9' WHEN seq = 9 THEN 'T-3' ELSE revised_from END AS prev
    FROM tdocs), walk AS (SELECT id FROM link WHERE prev IS NULL UNION ALL SELECT l.id FROM walk w JOIN link l ON l.prev = w.id)
  SELECT id FROM link WHERE id NOT IN (SELECT id FROM walk)""", "tdocs")
def _(spark, sf):
    # A planted fault: two documents revise each other.
    previous = F.when(F.col("seq") == 3, "T-9").when(F.col("seq") == 9, "T-3").otherwise(F.col("revised_from"))
    places = graph.chain_places(derive(spark, sf, "tdocs").select("id", previous.alias("previous")))
    return places.filter("is_cyclic").select("id")


@query("longest_chain", """WITH RECURSIVE walk AS (SELECT id, [id] AS path FROM tdocs WHERE revised_from IS NULL
  UNION ALL SELECT t.id, list_append(w.path, t.id) FROM walk w JOIN tdocs t ON t.revised_from = w.id),
  best AS (SELECT path FROM walk ORDER BY len(path) DESC, path LIMIT 1)
  SELECT CAST(unnest(range(0, len(path))) AS INTEGER) AS position, unnest(path) AS id FROM best""", "tdocs")
def _(spark, sf):
    return graph.longest_chain(derive(spark, sf, "tdocs"))


# --- listings, grids, manifests ---------------------------------------------------------------------------

_HREFS = r"""h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>', 1)) AS href FROM pages),
  l AS (SELECT page_id, href, CASE WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1), href)
    ELSE href END AS target FROM h)"""


@query("listing_links", f"WITH {_HREFS} SELECT page_id, href, target, count(*) AS n FROM l GROUP BY ALL")
def _(spark, sf):
    return listings.links(read(spark, sf, "pages")).groupBy("page_id", "href", "target").agg(F.count(F.lit(1)).alias("n"))


@query("listing_usable", rf"""WITH {_HREFS} SELECT page_id, target, lower(regexp_extract(target, '^https?://([^/?#:]+)', 1)) AS host
  FROM l WHERE starts_with(target, 'https://') AND NOT regexp_matches(href, '^\s*(?:[?#]|javascript:)')""")
def _(spark, sf):
    return listings.usable_links(listings.links(read(spark, sf, "pages"))).select("page_id", "target", "host")


@query("listing_artifacts", rf"""WITH {_HREFS}, u AS (SELECT DISTINCT page_id, target, string_split(rtrim(regexp_replace(target, '[?#].*$', ''), '/'), '/')[-1]
    AS filename FROM l WHERE NOT ends_with(target, '/'))
  SELECT page_id, target, filename, CASE WHEN contains(lower(filename), 'agenda') THEN 'agenda'
    WHEN regexp_matches(lower(filename), 'tdoc_?list') THEN 'tdoc_list' WHEN regexp_matches(lower(filename), '^[a-z]\d-\d+')
    THEN CASE WHEN contains(lower(target), '/report') THEN 'report' ELSE 'tdoc' END
    WHEN contains(lower(filename), 'report') OR contains(lower(target), '/report') THEN 'report' ELSE 'other' END AS kind FROM u""")
def _(spark, sf):
    return listings.listed_artifacts(listings.links(read(spark, sf, "pages"))).select("page_id", "target", "filename", "kind")


@query("listing_directories", r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*>(.*?)</a>', 1)) AS t FROM pages)
  SELECT DISTINCT page_id, rtrim(lower(trim(regexp_replace(t, '<[^>]*>', '', 'g'))), '/') AS name FROM a
  WHERE rtrim(lower(trim(regexp_replace(t, '<[^>]*>', '', 'g'))), '/') <> ''""")
def _(spark, sf):
    return listings.directory_names(read(spark, sf, "pages"))


@query("listing_roles", r"""WITH a AS (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(html, '(?is)<a\s[^>]*>(.*?)</a>', 1))) AS name
    FROM pages) SELECT page_id, CASE name WHEN 'the' THEN 'docs' ELSE 'reports' END AS role, name FROM a WHERE name IN ('the', 'and', 'de')""")
def _(spark, sf):
    roles = spark.sql("SELECT * FROM VALUES ('docs', 'The'), ('reports', 'and'), ('reports', 'de') AS r(role, directory)")
    return listings.roles_present(listings.directory_names(read(spark, sf, "pages")), roles)


@query("grid_to_records", """SELECT p_brand AS sheet, p_partkey AS row_no, 'tdoc' AS "column", CAST(p_partkey AS VARCHAR) AS value FROM part
  WHERE p_partkey > 0 UNION ALL SELECT p_brand, p_partkey, 'title', p_name FROM part WHERE p_partkey > 0
  UNION ALL SELECT p_brand, p_partkey, 'spec', p_type FROM part WHERE p_partkey > 0""")
def _(spark, sf):
    part = read(spark, sf, "part")
    rows = part.filter("p_partkey > 0").select(
        F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("row_no"),
        F.array(F.col("p_partkey").cast("string"), "p_name", "p_type").alias("cells"),
    )
    heads = part.select(
        F.col("p_brand").alias("sheet"), F.lit(0).cast("long").alias("row_no"),
        F.array(F.lit("TDoc"), F.lit("Title"), F.lit("Specification")).alias("cells"),
    ).distinct()
    return listings.records_of_grid(rows.unionByName(heads))


@query("member_choice", """SELECT o_custkey AS package, arg_max(f, (p, f)) AS filename FROM (SELECT o_custkey, concat(CASE o_orderkey % 3
    WHEN 0 THEN 'index_' WHEN 1 THEN 'tdoc_' ELSE 'z_' END, o_orderkey) AS f, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS p
    FROM orders) GROUP BY o_custkey""")
def _(spark, sf):
    name = F.concat(
        F.when(F.col("o_orderkey") % 3 == 0, "index_").when(F.col("o_orderkey") % 3 == 1, "tdoc_").otherwise("z_"), "o_orderkey"
    )
    members = read(spark, sf, "orders").select(F.col("o_custkey").alias("package"), name.alias("filename"))
    return lifecycle.chosen_member(members, ["package"])


@query("manifest_entries", """SELECT concat('u', doc_id) AS url, sha256(text) AS sha256, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'downloaded'
  END AS status FROM documents WHERE doc_id % 5 <> 0""")
def _(spark, sf):
    entry = F.struct(
        F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("downloaded").alias("status")
    )
    manifests = read(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1).alias("schema_version"),
        F.create_map(F.concat(F.lit("u"), "doc_id"), entry).alias("artifacts"),
    )
    return listings.manifest_entries(manifests)


@query("artifact_integrity", "SELECT CAST(doc_id AS VARCHAR) AS object_key, doc_id % 4 <> 0 AS intact FROM documents")
def _(spark, sf):
    docs = read(spark, sf, "documents")
    key = F.col("doc_id").cast("string").alias("object_key")
    stated = docs.select(key, F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return listings.verified(stated, docs.select(key, F.col("text").cast("binary").alias("content"))).select("object_key", "intact")


# --- lifecycle ---------------------------------------------------------------------------------------------


@query("artifact_latest", """SELECT source_url, event_id, sha256 FROM observations
  QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY observed_at DESC, event_id DESC) = 1""", "observations")
def _(spark, sf):
    return lifecycle.latest_observation(derive(spark, sf, "observations")).select("source_url", "event_id", "sha256")


@query("canonical_entries", """WITH e AS (SELECT document_id, source_url FROM artifacts UNION ALL SELECT document_id, replace(source_url, '/docs/', '/agenda/')
    FROM artifacts WHERE owner_key % 2 = 0) SELECT document_id, source_url, contains(source_url, '/docs/') AS is_canonical FROM e""", "artifacts")
def _(spark, sf):
    a = derive(spark, sf, "artifacts")
    copies = a.filter("owner_key % 2 = 0").withColumn("source_url", F.replace("source_url", F.lit("/docs/"), F.lit("/agenda/")))
    return lifecycle.canonical_entries(a.unionByName(copies)).select("document_id", "source_url", "is_canonical")


@query("report_choice", """SELECT o_custkey AS meeting_id, max(o_orderkey) FILTER (WHERE o_orderkey % 4 <> 0 OR only_skeleton) AS number
  FROM (SELECT *, bool_and(o_orderkey % 4 = 0) OVER (PARTITION BY o_custkey) AS only_skeleton FROM orders) GROUP BY o_custkey""")
def _(spark, sf):
    name = F.concat(F.lit("report_v"), "o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "_skeleton").otherwise(""), F.lit(".docx"))
    reports = read(spark, sf, "orders").select(F.col("o_custkey").alias("meeting_id"), F.col("o_orderkey").alias("number"), name.alias("filename"))
    return lifecycle.chosen_report(reports, ["meeting_id"]).select("meeting_id", "number")


@query("readiness_labels", """SELECT o_custkey AS meeting_id, CASE WHEN bool_or(o_orderkey % 3 = 0) THEN 'final_ready' ELSE 'provisional_ready' END
  AS readiness FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    name = F.when(F.col("o_orderkey") % 3 == 0, "final_report.docx").otherwise("Draft report.docx")
    return lifecycle.final_ready(read(spark, sf, "orders").select(F.col("o_custkey").alias("meeting_id"), name.alias("filename")))


@query("report_authority", """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'approved_report' WHEN 1 THEN 'draft_report' ELSE 'final_report' END AS authority,
  CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS weight, 'docx_section_block' AS method, count(*) AS n FROM orders GROUP BY ALL""")
def _(spark, sf):
    name = F.element_at(F.array(F.lit("Approved.docx"), F.lit("skeleton.docx"), F.lit("rep.docx")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    authority = text.report_authority(name)
    return read(spark, sf, "orders").select(
        authority.alias("authority"), text.authority_weight(authority).alias("weight"), text.extraction_method(name).alias("method")
    ).groupBy("authority", "weight", "method").agg(F.count(F.lit(1)).alias("n"))


@query("completed_meetings", """WITH k AS (SELECT meeting_id FROM tdocs GROUP BY meeting_id HAVING bool_or(seq % 10 = 0))
  SELECT id FROM meetings WHERE id IN (SELECT meeting_id FROM k) ORDER BY ends_on DESC NULLS LAST, number DESC LIMIT 4""", "meetings", "tdocs")
def _(spark, sf):
    kinds = derive(spark, sf, "tdocs").select("meeting_id", F.explode(F.array(
        F.lit("tdoc"), F.when(F.col("seq") % 10 == 0, "tdoc_list").otherwise("other"))).alias("kind"))
    return lifecycle.completed_meetings(derive(spark, sf, "meetings"), kinds, 4).select("id")


@query("upsert_status", """WITH s AS (SELECT * FROM observations WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY source_url, sha256
    ORDER BY observed_at DESC, event_id DESC) = 1), i AS (SELECT * FROM observations WHERE event_id % 2 = 1 QUALIFY row_number() OVER
    (PARTITION BY source_url, sha256 ORDER BY observed_at DESC, event_id DESC) = 1)
  SELECT source_url, sha256, event_id, parse_status FROM i UNION ALL SELECT source_url, sha256, event_id, parse_status FROM s
  WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.source_url = s.source_url AND i.sha256 = s.sha256)""", "observations")
def _(spark, sf):
    rows = derive(spark, sf, "observations")
    keys = ["source_url", "sha256"]
    stored = lifecycle.first_of(rows.filter("event_id % 2 = 0"), keys, [F.desc("observed_at"), F.desc("event_id")])
    return lifecycle.upserted(stored, rows.filter("event_id % 2 = 1"), keys).select(*keys, "event_id", "parse_status")


@query("insert_if_absent", """SELECT DISTINCT document_id FROM artifacts WHERE owner_key % 3 = 0 AND document_id NOT IN
  (SELECT document_id FROM artifacts WHERE parse_status <> 'parsed')""", "artifacts")
def _(spark, sf):
    a = derive(spark, sf, "artifacts")
    return lifecycle.new_rows(a.filter("parse_status <> 'parsed'"), a.filter("owner_key % 3 = 0"), "document_id").select("document_id")


@query("ownership_guard", """SELECT id, meeting_id FROM tdocs WHERE seq % 3 <> 0 OR meeting_id = 'WG1-1'""", "tdocs")
def _(spark, sf):
    documents = derive(spark, sf, "tdocs").select("id", "meeting_id", "seq")
    owners = documents.filter("seq % 3 = 0").select("id", F.lit("WG1-1").alias("owner"))
    return lifecycle.owned(documents, owners).select("id", "meeting_id")


@query("last_sheet_wins", "SELECT l_orderkey AS id, max(l_linenumber) AS sheet FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("sheet"))
    return lifecycle.last_wins(rows, "id", "sheet")


@query("archive_match", """SELECT coalesce(t.id, a.document_id) AS id, CASE WHEN a.document_id IS NULL THEN 'missing' WHEN t.id IS NULL THEN 'orphan'
  ELSE 'matched' END AS state FROM (SELECT id FROM tdocs WHERE seq % 19 <> 0) t FULL JOIN artifacts a ON t.id = a.document_id""", "tdocs", "artifacts")
def _(spark, sf):
    return lifecycle.archive_match(derive(spark, sf, "tdocs").filter("seq % 19 <> 0"), derive(spark, sf, "artifacts"))


@query("pending_work", "SELECT document_id FROM artifacts WHERE parse_status NOT IN ('parsed', 'quarantined', 'not_applicable')", "artifacts")
def _(spark, sf):
    return lifecycle.pending(derive(spark, sf, "artifacts")).select("document_id")


@query("missing_by_status", """SELECT status, count(*) AS n FROM tdocs WHERE status NOT IN ('reserved', 'withdrawn', 'revised', 'not_pursued')
  AND id NOT IN (SELECT document_id FROM artifacts) GROUP BY status""", "tdocs", "artifacts")
def _(spark, sf):
    wanted = records(spark, sf).filter(search.actionable())
    files = derive(spark, sf, "artifacts").select(F.col("document_id").alias("id"))
    return search.counted(wanted.join(files, "id", "left_anti"), "status", "status")


@query("parsed_and_actionable", """SELECT id FROM tdocs WHERE status NOT IN ('reserved', 'withdrawn', 'revised', 'not_pursued')
  INTERSECT SELECT document_id FROM artifacts WHERE parse_status = 'parsed'""", "tdocs", "artifacts")
def _(spark, sf):
    parsed = derive(spark, sf, "artifacts").filter("parse_status = 'parsed'").select("document_id")
    return records(spark, sf).filter(search.actionable()).select("id").intersect(parsed)


@query("coverage", """SELECT meeting_id, count(*) AS tdocs, count(*) FILTER (WHERE status <> 'revised') AS actionable,
  count(a.document_id) / count(*) AS archive_ratio, CASE WHEN count(*) FILTER (WHERE status <> 'revised') = 0 THEN 0 ELSE
  count(a.document_id) FILTER (WHERE status <> 'revised') / count(*) FILTER (WHERE status <> 'revised') END AS actionable_ratio
  FROM tdocs t LEFT JOIN artifacts a ON a.document_id = t.id GROUP BY meeting_id""", "tdocs", "artifacts")
def _(spark, sf):
    return lifecycle.coverage(records(spark, sf), derive(spark, sf, "artifacts"))


@query("readiness", """WITH w AS (SELECT t.id, t.status <> 'revised' AS wanted, a.document_id IS NOT NULL AS archived, a.parse_status FROM tdocs t
    LEFT JOIN artifacts a ON a.document_id = t.id), c AS (SELECT count(*) AS tdocs, count(*) FILTER (WHERE wanted) AS actionable_tdocs,
    count(*) FILTER (WHERE wanted AND archived) AS a, count(*) FILTER (WHERE wanted AND parse_status IN ('parsed', 'quarantined')) AS h FROM w)
  SELECT (SELECT count(*) FROM meetings) AS meetings, (SELECT count(*) FROM meetings WHERE starts_on IS NULL) AS undated_meetings,
    (SELECT count(*) FROM artifacts WHERE parse_status = 'failed') AS invalid_artifacts, tdocs, actionable_tdocs,
    a / actionable_tdocs AS archive_coverage, h / actionable_tdocs AS body_coverage,
    'undated,reports,parse_status,archive_coverage,body_coverage' AS errors, false AS ready FROM c""", "meetings", "tdocs", "artifacts")
def _(spark, sf):
    a = derive(spark, sf, "artifacts").withColumn("meeting_id", F.col("owner_key").cast("string"))
    parsed = a.filter("parse_status = 'parsed'").select("document_id")
    row = lifecycle.readiness(derive(spark, sf, "meetings"), records(spark, sf), a, parsed)
    return row.select("meetings", "undated_meetings", "invalid_artifacts", "tdocs", "actionable_tdocs", "archive_coverage",
                      "body_coverage", "errors", "ready")


@query("reconcile", """SELECT coalesce(e.source_url, s.source_url) AS source_url, coalesce(e.sha256, s.sha256) AS sha256, CASE WHEN s.sha256 IS NULL
  THEN 'missing' WHEN e.sha256 IS NULL THEN 'unexpected' ELSE 'matched' END AS state FROM (SELECT DISTINCT source_url, sha256 FROM observations
  WHERE event_type <> 'click') e FULL JOIN (SELECT DISTINCT source_url, sha256 FROM observations WHERE event_type <> 'view') s
  ON e.source_url = s.source_url AND e.sha256 = s.sha256""", "observations")
def _(spark, sf):
    rows = derive(spark, sf, "observations")
    return lifecycle.reconciled(rows.filter("event_type <> 'click'"), rows.filter("event_type <> 'view'"))


@query("artifact_counts", "SELECT kind, parse_status, count(*) AS n FROM artifacts GROUP BY kind, parse_status", "artifacts")
def _(spark, sf):
    return derive(spark, sf, "artifacts").groupBy("kind", "parse_status").agg(F.count(F.lit(1)).alias("n"))


@query("outcome_counts", "SELECT parse_status, count(*) AS n FROM observations GROUP BY parse_status", "observations")
def _(spark, sf):
    return search.counted(derive(spark, sf, "observations"), "parse_status", "parse_status")


@query("date_backfill", """SELECT id, CASE WHEN starts_on IS NULL THEN DATE '2001-01-01' + CAST(number AS INTEGER) ELSE starts_on END AS starts_on,
  number % 2 = 0 AND starts_on IS NOT NULL AS conflict FROM meetings""", "meetings")
def _(spark, sf):
    meetings = derive(spark, sf, "meetings")
    new = F.date_add(F.lit("2001-01-01").cast("date"), F.col("number").cast("int"))
    found = meetings.select(
        F.col("id").alias("meeting_id"),
        F.when(F.col("starts_on").isNull() | (F.col("number") % 2 == 0), new).otherwise(F.col("starts_on")).alias("starts_on"),
        F.lit(None).cast("date").alias("ends_on"),
    )
    return lifecycle.filled_dates(meetings, found).select("id", "starts_on", "conflict")


@query("combined_runs", "SELECT id, CASE WHEN number % 2 = 0 THEN 'new' ELSE 'old' END AS run FROM meetings", "meetings")
def _(spark, sf):
    m = derive(spark, sf, "meetings")
    old = m.select("id", F.lit("old").alias("run"))
    return lifecycle.combined_runs(old, m.filter("number % 2 = 0").select("id", F.lit("new").alias("run")), "id")


@query("archive_guards", """SELECT CASE o_orderkey % 5 WHEN 0 THEN 'encrypted' WHEN 1 THEN 'path traversal' WHEN 2 THEN 'macros' END AS reason,
  count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    k = F.col("o_orderkey") % 5
    members = read(spark, sf, "orders").select(
        F.when(k == 1, "../up.txt").when(k == 2, "a/word/vbaProject.bin").otherwise("a/b.txt").alias("filename"), (k == 0).alias("encrypted")
    )
    return lifecycle.guarded_members(members).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("parsed_without_blocks", """SELECT document_id FROM artifacts WHERE parse_status = 'parsed' AND owner_key % 10 = 0""", "artifacts")
def _(spark, sf):
    a = derive(spark, sf, "artifacts")
    with_blocks = a.filter("owner_key % 10 <> 0").select("document_id")
    return a.filter("parse_status = 'parsed'").join(with_blocks, "document_id", "left_anti").select("document_id")


# --- briefings and audits -------------------------------------------------------------------------------------


@query("brief_totals", """SELECT meeting_id, status, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY meeting_id) AS BIGINT) AS total FROM tdocs
  GROUP BY meeting_id, status""", "tdocs")
def _(spark, sf):
    return briefing.totals(records(spark, sf))


def _common_sql(rows: str, column: str, limit: int) -> str:
    return f"""SELECT meeting_id, {column}, n, CAST(place AS INTEGER) AS place FROM (SELECT meeting_id, {column}, count(*) AS n,
      row_number() OVER (PARTITION BY meeting_id ORDER BY count(*) DESC, min(seq), {column}) AS place FROM {rows} GROUP BY meeting_id, {column})
      WHERE place <= {limit}"""


@query("brief_topics", _common_sql("tdocs", "agenda_description", 3), "tdocs")
def _(spark, sf):
    return briefing.hot_topics(records(spark, sf), 3)


@query("brief_companies", """WITH c AS (SELECT meeting_id, seq, unnest(list_filter(list_transform(string_split(source, ','), lambda v: trim(v)),
    lambda v: v <> '')) AS company FROM tdocs) """ + _common_sql("c", "company", 10), "tdocs")
def _(spark, sf):
    return briefing.company_activity(records(spark, sf))


@query("brief_specs", f"""WITH {RECS}, s AS (SELECT meeting_id, unnest(specs) AS specification FROM recs)
  SELECT meeting_id, specification, count(*) AS n FROM s GROUP BY ALL""", "tdocs")
def _(spark, sf):
    return briefing.affected_specifications(records(spark, sf))


@query("brief_revisions", """SELECT t.meeting_id, t.id, n.id AS revised_to FROM tdocs t JOIN tdocs n ON n.revised_from = t.id""", "tdocs")
def _(spark, sf):
    return briefing.revision_pairs(records(spark, sf))


@query("brief_envelope", """SELECT m.id AS meeting_id, count(t.id) AS tdocs, count(t.id) FILTER (WHERE seq % 17 = 0) AS without_evidence,
  CASE WHEN any_value(m.readiness) <> 'final_ready' OR count(t.id) FILTER (WHERE seq % 17 = 0) > 0 THEN 'partial' ELSE 'complete' END AS completeness,
  CASE WHEN count(t.id) = 0 THEN 0 ELSE count(t.id) FILTER (WHERE seq % 17 <> 0) / count(t.id) END AS confidence
  FROM meetings m LEFT JOIN tdocs t ON t.meeting_id = m.id GROUP BY m.id""", "meetings", "tdocs")
def _(spark, sf):
    evidence = derive(spark, sf, "artifacts").select(F.col("document_id").alias("id"))
    return briefing.envelope(records(spark, sf), derive(spark, sf, "meetings"), evidence)


@query("compare_meetings", """SELECT status, count(*) FILTER (WHERE meeting_id = 'WG1-1') AS "WG1-1", count(*) FILTER (WHERE meeting_id = 'WG2-2') AS "WG2-2"
  FROM tdocs WHERE meeting_id IN ('WG1-1', 'WG2-2') GROUP BY status""", "tdocs")
def _(spark, sf):
    return briefing.compared(records(spark, sf), ("WG1-1", "WG2-2"))


@query("claim_audit", f"""WITH {RECS}, c AS (SELECT id AS claim_id, meeting_id AS packet_id, seq, companies,
    concat('In total ', seq % 50, ' items by ', coalesce(companies[1], '-')) AS text FROM recs),
  allowed AS (SELECT DISTINCT meeting_id AS packet_id, CAST(seq % 40 AS VARCHAR) AS number FROM recs),
  names AS (SELECT DISTINCT meeting_id AS packet_id, companies[1] AS organization FROM recs WHERE len(companies) > 0)
  SELECT claim_id, 'evidence' AS problem, claim_id AS value FROM c WHERE seq % 17 = 0
  UNION ALL SELECT claim_id, 'number', v FROM (SELECT DISTINCT claim_id, packet_id, unnest(regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)*\\b')) AS v FROM c) n
    WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.packet_id = n.packet_id AND a.number = n.v)
  UNION ALL SELECT DISTINCT claim_id, 'organization', o FROM (SELECT claim_id, packet_id, text, unnest(companies) AS o FROM c) e
    WHERE NOT contains(text, o) OR NOT EXISTS (SELECT 1 FROM names x WHERE x.packet_id = e.packet_id AND x.organization = e.o)""", "tdocs")
def _(spark, sf):
    rows = records(spark, sf)
    first = F.try_element_at("companies", F.lit(1))
    said = F.concat(F.lit("In total "), F.col("seq") % 50, F.lit(" items by "), F.coalesce(first, F.lit("-")))
    claims = rows.select(
        F.col("id").alias("claim_id"), F.col("meeting_id").alias("packet_id"), said.alias("text"),
        F.array("id").alias("evidence_ids"), F.col("companies").alias("organizations"),
    )
    evidence = derive(spark, sf, "artifacts").select(F.col("document_id").alias("evidence_id")).join(
        rows.select(F.col("id").alias("evidence_id"), F.col("meeting_id").alias("packet_id")), "evidence_id"
    )
    numbers = rows.select(F.col("meeting_id").alias("packet_id"), (F.col("seq") % 40).cast("string").alias("number"))
    known = rows.select(F.col("meeting_id").alias("packet_id"), first.alias("organization")).filter("organization is not null")
    return briefing.audited_claims(claims, evidence, numbers, known)


@query("topic_merge", """WITH x AS (SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN lang ELSE upper(lang) END AS canonical_name, source AS alias,
    doc_id % 100 / 100 AS confidence, doc_id AS evidence_id FROM documents)
  SELECT lower(canonical_name) AS key, arg_min(canonical_name, seq) AS canonical_name, max(confidence) AS confidence,
    count(DISTINCT alias) AS aliases, count(DISTINCT evidence_id) AS evidence FROM x WHERE confidence >= 0.65 GROUP BY 1""")
def _(spark, sf):
    extracted = read(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.upper("lang")).alias("canonical_name"),
        F.col("source").alias("alias"), (F.col("doc_id") % 100 / 100).alias("confidence"), F.col("doc_id").alias("evidence_id"),
    )
    return briefing.merged_topics(extracted)


# --- incremental arrival ------------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    # A file stream reads folders, so a single file is picked by its name.
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir.rstrip("/"))


@query("stream_dedupe", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def _(spark, sf):
    keys = ["user_id", "event_type"]
    once = arrivals.distinct_observations(event_stream(spark, sf).select(*keys), keys)
    kept = arrivals.finished(once, spark, "stream-dedupe")
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("stream_counts", None)
def _(spark, sf):
    timed = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = arrivals.counts_per_window(timed, "1 hour", None, "event_type")
    return arrivals.last_updates(counts, spark, "stream-counts", ["starts", "event_type"])


@query("stream_versions", """SELECT source_url, event_id, sha256 FROM (SELECT *, lag(sha256) OVER (PARTITION BY source_url ORDER BY observed_at, event_id)
  AS b FROM observations) WHERE b IS NULL OR b <> sha256""", "observations")
def _(spark, sf):
    stream = event_stream(spark, sf)
    from .domain import SPARK, definitions

    arriving = spark.sql(definitions(SPARK)["observations"].replace("FROM events", "FROM {events}"), events=stream)
    return arrivals.versions(arriving, spark).select("source_url", "event_id", "sha256")
