"""Registered queries over ingestion, datasets, graph scopes and user-facing analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, text
from ..operators import blocks, cycles, fulltext, graph, lifecycle, retrieval, search, substrings, versions
from ..session import cut_lineage, fresh_path, stored
from ..sources import listings, store
from ..streaming import arrivals, retries
from .domain import derive, read
from .queries import (
    _EDGES, _FACTS, _HREFS, _LEXICAL, _NODES, _TOKENS, QUERIES, RECS, SQL, asked, bodies, event_stream, found_facts, kept_facts, line_blocks, query,
    records, turn_blocks,
)


@query("listing_meetings", r"""SELECT concat('P-', n) AS id, n AS number, count(*) AS pages FROM (SELECT CAST(regexp_extract(
  regexp_replace(url, '[?#].*$', ''), '/(\d+)(?:\.html)?/?$', 1) AS INTEGER) AS n FROM pages WHERE starts_with(url, 'https://')
  AND regexp_matches(regexp_replace(url, '[?#].*$', ''), '/(\d+)(?:\.html)?/?$')) GROUP BY n""")
def _(spark, sf):
    links = read(spark, sf, "pages").select(
        F.col("page_id").alias("position"), F.col("url").alias("target"), F.col("url").alias("href")
    )
    usable = listings.usable_links(links)
    found = listings.listed_meetings(usable, r"(\d+)(?:\.html)?", "P")
    names = usable.withColumn("number", F.regexp_extract(listings.last_segment(F.col("target")), r"^(\d+)(?:\.html)?$", 1).try_cast("int"))
    return found.join(names.groupBy("number").agg(F.count(F.lit(1)).alias("pages")), "number").select("id", "number", "pages")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(
        F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("downloaded").alias("status")
    )
    return read(spark, sf_dir, "documents").select(
        F.lit(1).alias("schema_version"), F.create_map(F.concat(F.lit("u"), "doc_id"), entry).alias("artifacts"),
        F.when(F.col("doc_id") % 2 == 0, F.array("source")).alias("selected"),
        F.create_map(F.concat(F.lit("all-"), "source"), F.lit("x")).alias("meetings"),
    )


@query("manifest_failures", "SELECT concat('u', doc_id) AS url FROM documents WHERE doc_id % 3 = 0")
def _(spark, sf):
    return listings.not_downloaded(manifests(spark, sf)).select("url")


@query("manifest_selected", """SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN source ELSE concat('all-', source) END AS meeting_id FROM documents""")
def _(spark, sf):
    return listings.selected_meetings(manifests(spark, sf))


@query("source_validation", rf"""WITH {_HREFS}, a AS (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(html,
    '(?is)<a\s[^>]*>(.*?)</a>', 1))) AS name FROM pages), r AS (SELECT page_id, count(DISTINCT CASE WHEN name = 'the' THEN 'docs' ELSE 'reports' END) AS roles
    FROM a WHERE name IN ('the', 'and', 'de') GROUP BY page_id), f AS (SELECT page_id, count(DISTINCT target) AS artifacts FROM l
    WHERE NOT ends_with(target, '/') GROUP BY page_id)
  SELECT p.page_id, coalesce(roles, 0) AS roles, coalesce(artifacts, 0) AS artifacts, coalesce(artifacts, 0) > 0 AS passed
  FROM pages p LEFT JOIN r USING (page_id) LEFT JOIN f USING (page_id)""")
def _(spark, sf):
    pages = read(spark, sf, "pages")
    roles = spark.sql("SELECT * FROM VALUES ('docs', 'The'), ('reports', 'and'), ('reports', 'de') AS r(role, directory)")
    found = listings.listed_artifacts(listings.links(pages))
    return listings.validated_sources(pages, roles, found).drop("kinds")


@query("decisions_by_status", """SELECT meeting_id, status, CAST(row_number() OVER (PARTITION BY meeting_id, status ORDER BY seq) AS INTEGER) AS place, id
  FROM tdocs WHERE status IN ('agreed', 'approved', 'rejected', 'not_pursued', 'postponed', 'revised')""", "tdocs")
def _(spark, sf):
    return search.grouped_decisions(records(spark, sf))


@query("evidence_ids_ordered", """SELECT meeting_id, concat('evidence-', substr(sha256(concat_ws('|', 'v1', id, 'row')), 1, 24)) AS evidence_id,
  CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY seq) AS INTEGER) AS place FROM tdocs""", "tdocs")
def _(spark, sf):
    rows = derive(spark, sf, "tdocs").withColumn("evidence_id", ids.evidence_id(F.lit("v1"), F.col("id"), F.lit("row")))
    twice = rows.select("meeting_id", "seq", "evidence_id").unionByName(
        rows.select("meeting_id", (F.col("seq") + 1_000_000_000).alias("seq"), "evidence_id")
    )
    return search.ordered_evidence(twice, "meeting_id", "seq")


@query("spec_changes", f"""WITH {RECS}, s AS (SELECT meeting_id, id, unnest(specs) AS spec FROM recs) SELECT meeting_id, spec, count(*) AS n FROM s
  WHERE contains(lower(spec), 'brand#2') GROUP BY ALL""", "tdocs")
def _(spark, sf):
    rows = records(spark, sf).filter(search.with_substrings(specifications=("Brand#2",)))
    each = rows.select("meeting_id", F.explode("specifications").alias("spec")).filter(F.contains(F.lower("spec"), F.lit("brand#2")))
    return each.groupBy("meeting_id", "spec").agg(F.count(F.lit(1)).alias("n"))


@query("trace_topic", """SELECT m.id, m.ends_on, count(t.id) AS n FROM meetings m JOIN tdocs t ON t.meeting_id = m.id
  WHERE contains(lower(t.agenda_description), 'high') OR contains(lower(t.title), 'high') GROUP BY m.id, m.ends_on""", "meetings", "tdocs")
def _(spark, sf):
    return search.traced(records(spark, sf), derive(spark, sf, "meetings"), ["agenda_description", "title"], "HIGH")


@query("group_graphs", f"""WITH {_FACTS}, g AS (SELECT tdoc_id, meeting_id, type, entity, predicate, split_part(meeting_id, '-', 1) AS wg FROM facts)
  SELECT wg, count(DISTINCT tdoc_id) AS tdocs, count(DISTINCT concat(type, ':', entity)) FILTER (WHERE type NOT IN ('tdoc')) AS entities,
    count(DISTINCT concat(CASE WHEN predicate = 'contains' THEN meeting_id ELSE tdoc_id END, predicate, type, entity)) AS edges,
    count(DISTINCT concat(tdoc_id, entity)) FILTER (WHERE predicate = 'revises') AS revisions FROM g GROUP BY wg""", "tdocs")
def _(spark, sf):
    found = kept_facts(spark, sf).withColumn("wg", F.split("meeting_id", "-")[0])
    # A document's edges are told apart by its id, so they are counted where they lie.
    meeting = F.when(F.col("predicate") == "contains", F.col("meeting_id")).alias("meeting_id")
    edges = graph.told_apart(found, "wg", "tdoc_id", meeting, "predicate", "type", "entity")
    tdocs = graph.told_apart(found.filter("predicate = 'contains'"), "wg", "tdoc_id")
    # Distinct first, so that a popular entity is one row before anything is counted.
    nodes = found.filter("type <> 'tdoc'").select("wg", "type", "entity").distinct()
    one, none = F.lit(1), F.lit(0)
    parts = [edges.select("wg", none.alias("tdocs"), none.alias("entities"), one.alias("edges"),
                          (F.col("predicate") == "revises").cast("int").alias("revisions")),
             tdocs.select("wg", one.alias("tdocs"), none.alias("entities"), none.alias("edges"), none.alias("revisions")),
             nodes.select("wg", none.alias("tdocs"), one.alias("entities"), none.alias("edges"), none.alias("revisions"))]
    return reduce(DataFrame.unionByName, parts).groupBy("wg").agg(
        *[F.sum(name).alias(name) for name in ("tdocs", "entities", "edges", "revisions")]
    )


@query("filtered_graph_counts", f"""WITH {_FACTS} SELECT meeting_id, count(DISTINCT tdoc_id) AS total,
  count(DISTINCT tdoc_id) FILTER (WHERE predicate = 'affects_spec' AND entity = 'brand#13') AS visible FROM facts GROUP BY meeting_id""", "tdocs")
def _(spark, sf):
    rows = search.facet_ids(records(spark, sf))
    return rows.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(search.with_facets(specifications=("brand#13",))).alias("visible")
    )


@query("graph_highlights", """WITH RECURSIVE walk AS (SELECT id, [id] AS path FROM tdocs WHERE revised_from IS NULL
  UNION ALL SELECT t.id, list_append(w.path, t.id) FROM walk w JOIN tdocs t ON t.revised_from = w.id),
  best AS (SELECT path FROM walk ORDER BY len(path) DESC, path LIMIT 1)
  SELECT concat('tdoc:', t.id) AS source, concat('tdoc:', t.revised_from) AS target, list_contains(path, t.id) AND list_contains(path, t.revised_from)
    AS highlighted FROM tdocs t, best WHERE t.revised_from IS NOT NULL""", "tdocs")
def _(spark, sf):
    view = graph.scope_edges(found_facts(spark, sf), derive(spark, sf, "meetings"))
    chain = graph.longest_chain(derive(spark, sf, "tdocs"))
    return graph.highlighted(view, chain).filter("type = 'revises'").select("source", "target", "highlighted")


@query("graph_rebuild", f"""WITH {_FACTS}, {_EDGES} SELECT e.source_id, e.predicate, e.target_id, m.ends_on AS valid_at FROM edges e
  LEFT JOIN tdocs t ON e.source_type = 'tdoc' AND t.id = e.source_id
  LEFT JOIN meetings m ON m.id = CASE WHEN e.source_type = 'meeting' THEN e.source_id ELSE t.meeting_id END""", "meetings", "tdocs")
def _(spark, sf):
    # A second meeting claims every third document; ownership keeps the first one's facts.
    documents, meetings = records(spark, sf), derive(spark, sf, "meetings")
    owners = documents.select("id", F.col("meeting_id").alias("owner"))
    claimed = documents.filter("seq % 3 = 0").withColumn("meeting_id", F.lit("WG9-99"))
    kept = lifecycle.owned(documents.unionByName(claimed), owners)
    return graph.dated(graph.edges(graph.facts(kept)), kept, meetings).select("source_id", "predicate", "target_id", "valid_at")


@query("graph_validation", f"""WITH {_FACTS}, {_NODES}, {_EDGES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
  CAST(0 AS BIGINT) AS faults, CAST(0 AS BIGINT) AS cycles, true AS valid""", "meetings", "tdocs")
def _(spark, sf):
    found = kept_facts(spark, sf)
    return graph.validated(graph.nodes(found, derive(spark, sf, "meetings")), graph.edges(found))


#: Revision links with planted faults: documents with a second, older predecessor, and documents that
#: their own predecessor revises.
_LINKS = """links AS (SELECT id AS src, revised_from AS dst FROM tdocs WHERE revised_from IS NOT NULL
  UNION SELECT t.id, p.revised_from FROM tdocs t JOIN tdocs p ON t.revised_from = p.id WHERE t.seq % 5 = 0 AND p.revised_from IS NOT NULL
  UNION SELECT revised_from, id FROM tdocs WHERE seq % 23 = 0 AND revised_from IS NOT NULL)"""
_STRONG = """reach AS (SELECT src, dst FROM links UNION SELECT r.src, l.dst FROM reach r JOIN links l ON r.dst = l.src),
  strong AS (SELECT a.src AS id, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"""


def planted_links(spark: SparkSession, sf_dir: str, cyclic: bool = True) -> DataFrame:
    tdocs = stored(derive(spark, sf_dir, "tdocs").filter("revised_from is not null").select("id", "seq", "revised_from"), "revisions")
    older = tdocs.select(F.col("id").alias("revised_from"), F.col("revised_from").alias("older"))
    links = tdocs.select(F.col("id").alias("src"), F.col("revised_from").alias("dst")).unionByName(
        tdocs.filter("seq % 5 = 0").join(older, "revised_from").select(F.col("id").alias("src"), F.col("older").alias("dst"))
    )
    if cyclic:
        links = links.unionByName(tdocs.filter("seq % 23 = 0").select(F.col("revised_from").alias("src"), F.col("id").alias("dst")))
    return links.distinct()


@query("graph_validation_cyclic", f"""WITH RECURSIVE {_FACTS}, {_NODES}, {_EDGES}, {_LINKS}, {_STRONG},
  more AS (SELECT src, dst FROM links EXCEPT SELECT source_id, target_id FROM edges WHERE predicate = 'revises')
  SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) + (SELECT count(*) FROM more) AS edges, CAST(0 AS BIGINT) AS faults,
    (SELECT count(DISTINCT component) FROM strong) AS cycles, (SELECT count(*) FROM strong) = 0 AS valid""", "meetings", "tdocs")
def _(spark, sf):
    found = kept_facts(spark, sf)
    planted = planted_links(spark, sf).select(
        F.lit("tdoc").alias("source_type"), F.col("src").alias("source_id"), F.lit("revises").alias("predicate"),
        F.lit("tdoc").alias("target_type"), F.col("dst").alias("target_id"),
    )
    edges = graph.edges(found).drop("id")
    # Planted edges can repeat no others than revisions.
    revisions = stored(edges.filter("predicate = 'revises'").unionByName(planted).distinct(), "revisions")
    edges = edges.filter("predicate <> 'revises'").unionByName(revisions)
    return graph.validated(graph.nodes(found, derive(spark, sf, "meetings")), edges)


@query("revision_components", f"WITH RECURSIVE {_LINKS}, {_STRONG} SELECT id, component FROM strong", "tdocs")
def _(spark, sf):
    return cycles.strong_components(planted_links(spark, sf))


# Which of several cycles is shown is a choice that SQL does not make; tests check that each is one.
@query("cycle_witnesses")
def _(spark, sf):
    links = cut_lineage(planted_links(spark, sf))
    return cycles.witnesses(links, cut_lineage(cycles.strong_components(links)))


@query("revision_places", f"""WITH RECURSIVE {_LINKS[:_LINKS.rindex('UNION')] + ')'},
  walk AS (SELECT id, id AS root, CAST(1 AS BIGINT) AS depth FROM tdocs WHERE id NOT IN (SELECT src FROM links)
    UNION SELECT l.src, w.root, w.depth + 1 FROM walk w JOIN links l ON l.dst = w.id)
  SELECT id, min(root) AS root, max(depth) AS depth, false AS is_cyclic FROM walk GROUP BY id""", "tdocs")
def _(spark, sf):
    every = derive(spark, sf, "tdocs").select("id", F.lit(None).cast("string").alias("previous"))
    links = planted_links(spark, sf, cyclic=False).select(F.col("src").alias("id"), F.col("dst").alias("previous"))
    return graph.chain_places(every.unionByName(links))


@query("search_graph", f"""WITH {_FACTS} SELECT DISTINCT concat('tdoc:', tdoc_id) AS source, predicate, concat(type, ':', entity) AS target FROM facts
  WHERE predicate IN ('submitted_by', 'affects_spec') AND tdoc_id IN (SELECT id FROM tdocs WHERE contains(lower(title), 'rod'))""", "tdocs")
def _(spark, sf):
    hits = records(spark, sf).filter(search.with_text(["title"], "Rod"))
    found = graph.facts(hits).filter(F.col("predicate").isin("submitted_by", "affects_spec"))
    return graph.edges(found).select(
        F.concat("source_type", F.lit(":"), "source_id").alias("source"), "predicate",
        F.concat("target_type", F.lit(":"), "target_id").alias("target"),
    )


@query("chain_evidence", """WITH RECURSIVE walk AS (SELECT id, id AS root, CAST(1 AS BIGINT) AS depth FROM tdocs WHERE revised_from IS NULL
  UNION ALL SELECT t.id, w.root, w.depth + 1 FROM walk w JOIN tdocs t ON t.revised_from = w.id)
  SELECT root, depth, id, concat('evidence-', substr(sha256(concat_ws('|', 'v1', id, 'row')), 1, 24)) AS evidence_id FROM walk""", "tdocs")
def _(spark, sf):
    places = graph.chain_places(derive(spark, sf, "tdocs").select("id", F.col("revised_from").alias("previous")))
    return places.filter("not is_cyclic").select(
        "root", "depth", "id", ids.evidence_id(F.lit("v1"), F.col("id"), F.lit("row")).alias("evidence_id")
    )


@query("document_detail", """WITH n AS (SELECT doc_id, source, len(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '')) AS n
    FROM documents) SELECT CAST(doc_id AS VARCHAR) AS document_id, source, least(n, 3) AS shown, CASE WHEN n > 3 OR n = 0 THEN 'partial' ELSE 'complete' END
    AS completeness FROM n""")
def _(spark, sf):
    rows = line_blocks(spark, sf).select("document_id", F.posexplode("blocks").alias("block_index", "b"))
    page = blocks.page_of_blocks(rows, 0, 3).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("shown"), F.max("completeness").alias("completeness")
    )
    meta = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "source")
    return meta.join(page, "document_id", "left").select(
        "document_id", "source", F.coalesce("shown", F.lit(0).cast("long")).alias("shown"),
        F.coalesce("completeness", F.lit("partial")).alias("completeness"),
    )


@query("section_page", """WITH b AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn, role FROM conversations),
  s AS (SELECT document_id, '' AS path, 0 AS depth, turn FROM b UNION ALL SELECT document_id, 'Turns', 1, turn FROM b
    UNION ALL SELECT document_id, concat('Turns/', role), 2, turn FROM b),
  g AS (SELECT document_id, path, depth, min(turn) AS start FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY document_id
    ORDER BY start, depth, path) AS place, count(*) OVER (PARTITION BY document_id) AS n FROM g)
  SELECT document_id, path, n > 3 AS has_more FROM r WHERE place BETWEEN 2 AND 3""")
def _(spark, sf):
    paged = blocks.page_of_sections(blocks.section_tree(turn_blocks(spark, sf)), 1, 2)
    return paged.select("document_id", F.array_join("section_path", "/").alias("path"), "has_more")


@query("ingest_bodies", None)
def _(spark, sf):
    packed = blocks.coalesce_blocks(line_blocks(spark, sf))
    chunks = blocks.build_chunks(packed)
    evidence = blocks.block_evidence_ids(F.col("block_ids"), F.lit("v1"), F.sha2("document_id", 256))
    return chunks.select("id", "document_id", "chunk_index", F.array_join(evidence, ",").alias("evidence_ids"), "token_count")


@query("chunk_evidence", r"""SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents WHERE trim(text, chr(10) || chr(9) || ' ') <> ''""")
def _(spark, sf):
    # Every document with text has chunks, and each chunk's blocks lead to stored evidence. Blocks and the ids of chunks
    # are read more than once, so both are written.
    packed = stored(blocks.coalesce_blocks(line_blocks(spark, sf)), "packed")
    of_block = blocks.explode_blocks(packed).select(
        F.col("id").alias("block_id"), ids.evidence_id(F.lit("v1"), F.lit("x"), F.col("id")).alias("evidence_id")
    ).distinct()
    chunks = stored(blocks.build_chunks(packed).select("id", "document_id", "block_ids"), "chunks")
    return blocks.chunk_evidence(chunks, of_block).join(chunks.select("id", "document_id").distinct(), "id").select("document_id").distinct()


@query("ingest_metadata", """SELECT concat('D-', p_partkey) AS id, p_name AS title, 'agreed' AS status,
  concat('evidence-', substr(sha256(concat_ws('|', 'v1', sha256(p_brand), concat('D-', p_partkey))), 1, 24)) AS evidence_id FROM part""")
def _(spark, sf):
    part = read(spark, sf, "part")
    rows = part.select(
        F.col("p_brand").alias("sheet"), (F.col("p_partkey") + 1).alias("row_no"),
        F.array(F.concat(F.lit("D-"), "p_partkey"), "p_name", F.lit(" Agreed ")).alias("cells"),
    )
    heads = part.select(
        F.col("p_brand").alias("sheet"), F.lit(0).cast("long").alias("row_no"),
        F.array(F.lit("TDoc number"), F.lit("Title"), F.lit("Result")).alias("cells"),
    ).distinct()
    cells = listings.records_of_grid(rows.unionByName(heads))
    found = listings.wide_records(cells, ("tdoc", "title", "tdoc_status"))
    return found.select(
        F.col("tdoc").alias("id"), "title", text.normalize_status(F.col("tdoc_status")).alias("status"),
        ids.evidence_id(F.lit("v1"), F.sha2("sheet", 256), F.col("tdoc")).alias("evidence_id"),
    )


@query("parse_routing", """SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 11 = 0 THEN 'quarantined' WHEN doc_id % 7 = 0 THEN 'not_applicable'
  WHEN trim(text) = '' THEN 'failed' ELSE 'parsed' END AS parse_status, CASE WHEN doc_id % 11 = 0 THEN 'encrypted'
  WHEN doc_id % 7 <> 0 AND trim(text) = '' THEN 'document has no text' END AS parse_error FROM documents""")
def _(spark, sf):
    docs = read(spark, sf, "documents")
    key = F.col("doc_id").cast("string").alias("document_id")
    members = lifecycle.guarded_members(docs.select(key, F.lit("a.txt").alias("filename"), (F.col("doc_id") % 11 == 0).alias("encrypted")))
    return lifecycle.routed(docs.select(key, (F.col("doc_id") % 7 != 0).alias("supported"), "text"), members)


@query("dates_from_bodies", """SELECT o_custkey AS meeting_id, CAST(min(o_orderdate) AS DATE) AS starts_on, CAST(min(o_orderdate) AS DATE) + 3 AS ends_on
  FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    # The first dated block of a meeting, in document and block order; a block says "from D to D of Month Year"
    # only within a month, so the numeric form is used here.
    day = F.col("o_orderdate").cast("date")
    body = F.concat(F.lit("Venue, "), F.date_format(day, "d/M/yyyy"), F.lit(" to "), F.date_format(F.date_add(day, 3), "d/M/yyyy"))
    rows = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("meeting_id"), F.col("o_orderdate").alias("place"), body.alias("text")
    )
    return lifecycle.first_dates(rows, dates.parse_meeting_date_range(F.col("text")))


@query("dataset_created", """SELECT CASE WHEN r_regionkey = 0 THEN 'v-new' ELSE r_name END AS id, CASE WHEN r_regionkey = 0 THEN 'building' ELSE 'validated' END
  AS state, r_regionkey = 1 AS is_active FROM region""")
def _(spark, sf):
    versions = read(spark, sf, "region").filter("r_regionkey > 0").select(
        F.col("r_name").alias("id"), F.lit("validated").alias("state"), (F.col("r_regionkey") == 1).alias("is_active")
    )
    return lifecycle.created(versions, "v-new")


@query("preview_version", "SELECT count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def _(spark, sf):
    versions = read(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("id"), (F.col("r_regionkey") == 1).alias("is_active"))
    version = search.active_version(versions, preview="2")
    rows = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.filter(F.col("n_regionkey").cast("string") == version).agg(F.count(F.lit(1)).alias("customers"))


@query("resume_downloads", """SELECT document_id FROM artifacts WHERE parse_status = 'failed' OR sha256 NOT IN (SELECT sha256 FROM artifacts WHERE owner_key % 4 <> 0)""",
       "artifacts")
def _(spark, sf):
    a = derive(spark, sf, "artifacts")
    entries = a.withColumn("status", F.when(F.col("parse_status") == "failed", "failed").otherwise("downloaded"))
    return lifecycle.not_yet_stored(entries, a.filter("owner_key % 4 <> 0")).select("document_id")


@query("passages_with_evidence", f"""WITH {_LEXICAL} SELECT query_id, id, round(least(max(score) OVER (PARTITION BY query_id), 1.0), 6) AS confidence,
  concat('e', id % 3, ',f', id) AS evidence_ids FROM lr WHERE rank <= 5""")
def _(spark, sf):
    best = retrieval.ranked(retrieval.lexical_scores(asked(spark, sf), bodies(spark, sf), 5), 5)
    evidence = bodies(spark, sf).select("id", F.posexplode(F.array(
        F.concat(F.lit("e"), F.col("id") % 3), F.concat(F.lit("f"), "id"), F.concat(F.lit("e"), F.col("id") % 3))).alias("position", "evidence_id"))
    return retrieval.with_evidence(best, evidence).select(
        "query_id", "id", F.round("confidence", 6).alias("confidence"), F.array_join("evidence_ids", ",").alias("evidence_ids")
    )


@query("stream_latest", """SELECT source_url, max(observed_at) AS observed_at FROM observations GROUP BY source_url""", "observations")
def _(spark, sf):
    from .domain import SPARK, definitions

    arriving = spark.sql(
        definitions(SPARK)["observations"].replace("FROM events", "FROM {events}"), events=event_stream(spark, sf)
    )
    stored = arrivals.finished(arriving.select("source_url", "observed_at", "event_id"), spark, "stream-latest")
    return lifecycle.latest_observation(stored).select("source_url", "observed_at")


@query("stream_backfill", """WITH f AS (SELECT user_id % 25 AS n, CAST(arg_min(ts, (ts, event_id)) AS DATE) AS d FROM events GROUP BY 1)
  SELECT id, coalesce(starts_on, d) AS starts_on, coalesce(ends_on, d + 4) AS ends_on FROM meetings LEFT JOIN f ON f.n = number""", "meetings")
def _(spark, sf):
    meetings = derive(spark, sf, "meetings")
    stream = event_stream(spark, sf)
    number = meetings.select("number", F.col("id").alias("meeting_id"))
    day = F.col("ts").cast("date")
    found = stream.withColumn("number", (F.col("user_id") % 25).cast("int")).join(number, "number").select(
        "meeting_id", F.struct("ts", "event_id").alias("place"), day.alias("starts_on"), F.date_add(day, 4).alias("ends_on")
    )
    return arrivals.backfilled(found, meetings, spark).select("id", "starts_on", "ends_on")


@query("evidence_runs", """WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS island
    FROM conversations WHERE trim(text) <> ''), r AS (SELECT document_id, role, island, min(turn) AS start, count(*) AS elements,
    sha256(string_agg(trim(text, chr(10) || ' '), chr(10) || chr(10) ORDER BY turn)) AS digest FROM t GROUP BY ALL)
  SELECT document_id, role, CAST(row_number() OVER (PARTITION BY document_id ORDER BY start) - 1 AS INTEGER) AS block_index, digest FROM r""")
def _(spark, sf):
    # Turns are short, so each run of one role becomes one block.
    rows = turn_blocks(spark, sf).withColumns({"kind": F.lit("paragraph"), "table_row": F.lit(None).cast("int")})
    return blocks.coalesce_rows(rows).select(
        "document_id", F.col("section_path")[1].alias("role"), F.col("block_index").cast("int").alias("block_index"),
        F.sha2("text", 256).alias("digest"),
    )


@query("completeness_by_group", """SELECT working_group_id, count(*) AS meetings, count(*) FILTER (WHERE readiness = 'final_ready') AS final FROM meetings GROUP BY 1""",
       "meetings")
def _(spark, sf):
    return derive(spark, sf, "meetings").groupBy("working_group_id").agg(
        F.count(F.lit(1)).alias("meetings"), F.count_if(F.col("readiness") == "final_ready").alias("final")
    )




# --- full-text search for batches -------------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in fulltext.STOP_WORDS)
#: One query per benchmark item from its first five words that are no stop words: a b or "c d" -e.
_BOOLEAN = f"""q AS (SELECT item_id AS query_id, list_filter({_TOKENS.format('text')}, lambda w: NOT list_contains([{_STOPS}], w))[1:5] AS w
    FROM benchmark), d AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS t FROM documents),
  places AS (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS p FROM d),
  every AS (SELECT token FROM places UNION SELECT unnest(w) FROM q), {fulltext.stem_sql('every')},
  spots AS (SELECT id, p, term FROM places JOIN stems USING (token) WHERE token NOT IN ({_STOPS})),
  asked AS (SELECT query_id, unnest(w) AS token, unnest(range(len(w))) AS k FROM q),
  terms AS (SELECT query_id, k, term FROM asked JOIN stems USING (token)),
  hits AS (SELECT DISTINCT query_id, k, id FROM terms JOIN spots USING (term)),
  pairs AS (SELECT DISTINCT a.query_id, x.id FROM terms a JOIN spots x USING (term) JOIN spots y ON y.id = x.id AND y.p = x.p + 1
    JOIN terms b ON b.query_id = a.query_id AND b.term = y.term WHERE a.k = 2 AND b.k = 3)"""


def web_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(text.tokenize(F.col("text")), lambda w: ~w.isin(*fulltext.STOP_WORDS))
    w = lambda i: F.coalesce(F.get(F.col("w"), i), F.lit(""))
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w")).select(
        "query_id", F.concat(w(0), F.lit(" "), w(1), F.lit(' or "'), w(2), F.lit(" "), w(3), F.lit('" -'), w(4)).alias("query")
    )


@query("fulltext_batch", f"""WITH {_BOOLEAN} SELECT query_id, id FROM hits WHERE k < 2 GROUP BY ALL HAVING count(DISTINCT k) = 2
  UNION SELECT query_id, id FROM pairs WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM hits WHERE k = 4)""")
def _(spark, sf):
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return fulltext.matches(web_queries(spark, sf), texts)


# The sweep over the positions has no SQL; the tests compare it with plain code.
@query("fulltext_ranked")
def _(spark, sf):
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    best = retrieval.ranked(fulltext.scores(web_queries(spark, sf), texts), 10)
    return best.select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query("substring_hits", """WITH p AS (SELECT p_partkey AS query_id, lower(string_split(p_name, ' ')[2]) AS phrase FROM part),
  t AS (SELECT doc_id AS id, lower(text) AS text FROM documents), h AS (SELECT DISTINCT phrase, id FROM (SELECT DISTINCT phrase FROM p WHERE phrase <> '') w
    JOIN t ON contains(t.text, w.phrase))
  SELECT query_id, count(*) AS n FROM p JOIN h USING (phrase) GROUP BY query_id""")
def _(spark, sf):
    phrases = read(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"), F.lower(F.get(F.split("p_name", " "), 1)).alias("phrase")
    )
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return substrings.counted(texts, phrases)


# --- versions, stored contents, pages by key --------------------------------------------------------------


@query("version_rows", """SELECT 'v' || CAST(o_orderkey % 3 AS VARCHAR) AS version, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 1""")
def _(spark, sf):
    # Three versions of a table; one is not validated, the second activation supersedes the first.
    root, orders = fresh_path(spark, "versions"), read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for k in range(3):
        rows = orders.filter(F.col("o_orderkey") % 3 == k)
        versions.write_version(rows, root, f"v{k}")
        versions.record_validation(spark, root, f"v{k}", rows.filter(F.lit(k == 2)))
    versions.activate(spark, root, "v0")
    versions.activate(spark, root, "v1")
    return versions.read_version(spark, root)


@query("store_contents", """SELECT substr(sha256(text), 1, 2) AS prefix, count(DISTINCT text) AS contents, sum(DISTINCT strlen(text)) > 0 AS filled
  FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    root = fresh_path(spark, "store")
    blobs = read(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    store.put(blobs.filter("doc_id % 2 = 0"), root)
    store.put(blobs, root)  # holds the first batch again
    return store.stored(spark, root).groupBy("prefix").agg(
        F.count(F.lit(1)).alias("contents"), (F.sum("size") > 0).alias("filled")
    )


@query("store_checked", """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'missing' WHEN doc_id % 10 = 4 THEN 'size' END AS problem FROM documents""")
def _(spark, sf):
    # Planted faults: every tenth content is asked for under another digest or with another size.
    root, docs = fresh_path(spark, "store"), read(spark, sf, "documents")
    store.put(docs.select(F.col("text").cast("binary").alias("content")), root)
    manifest = docs.select(
        "doc_id", F.when(F.col("doc_id") % 10 == 3, F.sha2(F.concat(F.lit("?"), "text"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"),
        (F.octet_length("text") + F.when(F.col("doc_id") % 10 == 4, 1).otherwise(0)).alias("size"),
    )
    return store.checked(spark, root, manifest).select("doc_id", "problem")


@query("tdocs_second_page", """SELECT id, received, true AS has_more FROM (SELECT *, row_number() OVER (ORDER BY received DESC NULLS LAST, id) AS n FROM tdocs)
  WHERE n > 50 AND n <= 100""", "tdocs")
def _(spark, sf):
    order, rows = [("received", True), ("id", False)], derive(spark, sf, "tdocs").select("id", "received")
    last = search.keyset_page(rows, order, 50).orderBy(F.desc_nulls_last("received"), "id").collect()[-1]
    return search.keyset_page(rows, order, 50, last.asDict())


# --- retries ----------------------------------------------------------------------------------------------

_RETRIES = """WITH e AS (SELECT user_id % 97 * 10 + event_id % 10 AS key, ts, event_id, event_type = 'purchase' AS ok FROM events),
  s AS (SELECT key, min((ts, event_id)) AS done FROM e WHERE ok GROUP BY key),
  f AS (SELECT key, ts, event_id, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM e WHERE NOT ok),
  c AS (SELECT f.key, max(n) AS attempts, max(ts) AS last FROM f LEFT JOIN s USING (key) WHERE n <= 5 AND (done IS NULL OR (ts, event_id) < done) GROUP BY f.key),
  k AS (SELECT DISTINCT key FROM e)
  SELECT k.key, CAST(coalesce(attempts, 0) AS INTEGER) AS attempts, CASE WHEN attempts >= 5 THEN 'dead_letter' WHEN done IS NOT NULL THEN 'complete' ELSE 'pending' END AS state,
    CASE WHEN coalesce(attempts, 0) < 5 AND done IS NULL THEN epoch_us(last) + 1000000 * least(3600, CAST(30 * pow(2, attempts) AS BIGINT)) END AS available_us
  FROM k LEFT JOIN s USING (key) LEFT JOIN c USING (key)"""


def _outcomes(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % 97 * 10 + F.col("event_id") % 10).alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        (F.col("event_type") == "purchase").alias("ok"),
    )


@query("retry_states", _RETRIES)
def _(spark, sf):
    found = retries.retry_states(_outcomes(read(spark, sf, "events")), 5)
    return found.select("key", "attempts", "state", F.unix_micros("available_at").alias("available_us"))


@query("stream_retries", _RETRIES)
def _(spark, sf):
    states = retries.retry_stream(_outcomes(event_stream(spark, sf)), 5)
    found = arrivals.last_updates(states, spark, "stream-retries", ["key"])
    return found.select("key", "attempts", "state", F.unix_micros("available_at").alias("available_us"))
