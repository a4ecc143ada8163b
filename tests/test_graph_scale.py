"""Steps of the graph that must not move or look up more rows than needed, and odd values on their way."""

import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from docketlens.functions import text
from docketlens.operators import cycles, graph
from docketlens.plans import dataset_queries, domain
from docketlens.plans.domain import TABLES
from docketlens.session import stored

from .compare import spark_rows, sql_rows


def _documents(spark, rows):
    none = "array<string>"
    return spark.createDataFrame(
        rows, "id string, meeting_id string, seq long, title string, agenda_item string, agenda_description string, "
        f"companies {none}, specifications {none}, releases {none}, work_items {none}, cr_number string, revised_from string",
    )


def test_edges_of_documents_lying_by_id_are_not_shuffled_again(spark):
    rows = [(f"D{i}", "M1", i, "t", "1", "top", ["A", "a"], ["S/1", "s 1"], [], [], None, f"D{i - 1}" if i % 3 else None)
            for i in range(20)]
    documents = _documents(spark, rows + rows[:5])
    edges = graph.edges(graph.facts(documents.repartition("id")))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert edges.count() == edges.distinct().count() == graph.edges(graph.facts(documents)).count()


def test_stored_facts_equal_facts(spark):
    rows = [("D1", "M1", 1, "t", "1", "top", ["A"], ["S"], ["R"], ["W"], "7", None),
            ("D2", "M1", 2, "", None, None, None, None, None, None, None, "D9")]
    documents = _documents(spark, rows)
    assert sorted(graph.stored_facts(documents).collect()) == sorted(graph.facts(documents).collect())


def test_faults_at_shared_and_null_ends(spark):
    edges = spark.createDataFrame(
        [("1", "tdoc", "a", "x", "topic", "hot"), ("2", "tdoc", "b", "x", "topic", "hot"), ("3", "tdoc", "gone", "x", "topic", "gone"),
         ("4", "tdoc", None, "x", "tdoc", "a"), ("5", "topic", "hot", "revises", "tdoc", "a")],
        "id string, source_type string, source_id string, predicate string, target_type string, target_id string",
    )
    nodes = spark.createDataFrame([("tdoc", "a"), ("tdoc", "b"), ("topic", "hot"), ("tdoc", None)], "type string, entity string")
    assert sorted((r["id"], r["problem"]) for r in graph.orphans(edges, nodes).collect()) == [
        ("3", "orphan source"), ("3", "orphan target"), ("4", "orphan source"), ("5", "revises other type")]


def test_slugs_and_parts_equal_plain_rules(spark):
    space = r"[\s\x1c-\x1f]"
    values = ["  A/b  c ", "-x-", "/", " - ", "İ" * 45, "a" * 81, "a b\x1c/c", "x" * 60 + " " * 30 + "y", "é/" * 41]
    lists = [" a ,, b\n c;d ;-", "", ";", " ,\x1c a  , a", "- , -x"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    for row in frame.select("v", text.canonical_identifier(F.col("v")).alias("s"), F.lower("v").alias("low")).collect():
        slug = re.sub(f"{space}+", "-", re.sub(f"^{space}+|{space}+$", "", row["low"].replace("/", " ")))
        assert row["s"] == slug if len(slug) <= 80 else row["s"].startswith(slug[:63] + "-") and len(row["s"]) == 80
    frame = spark.createDataFrame([(v,) for v in lists], "v string")
    for row in frame.select("v", text.split_multi_value(F.col("v")).alias("s")).collect():
        parts = [re.sub(f"^{space}+|{space}+$", "", p) for p in re.split(r"[,;\n]+", row["v"])]
        assert row["s"] == list(dict.fromkeys(p for p in parts if p not in ("", "-")))


def test_short_chains_are_trimmed_without_compression(spark, monkeypatch):
    rows = [(f"{c}-{i}", f"{c}-{i + 1}") for c in range(40) for i in range(c % 5)] + [("0-a", "0-b"), ("0-b", "0-a")]
    called = []
    plain = cycles._compressed
    monkeypatch.setattr(cycles, "_compressed", lambda links: called.append(links.count()) or plain(links))
    found = cycles.strong_components(spark.createDataFrame(rows, "src string, dst string"))
    assert sorted(map(tuple, found.collect())) == [("0-a", "0-a"), ("0-b", "0-a")]
    assert called and max(called) <= 2


def test_pointers_on_cycles_stop_early_with_right_ends(spark, monkeypatch):
    # Many pairs, a cycle of five, a tail of nine into it, a path of six.
    follow = {f"p{i}": f"p{i ^ 1}" for i in range(600)} | {f"c{i}": f"c{(i + 1) % 5}" for i in range(5)}
    follow |= {f"a{i}": f"a{i + 1}" for i in range(8)} | {"a8": "c3"} | {f"z{i}": f"z{i + 1}" for i in range(5)} | {"z5": None}
    written = []
    plain = cycles.stored
    monkeypatch.setattr(cycles, "stored", lambda df, *a: written.append(1) or plain(df, *a))
    rows = {r["id"]: r for r in cycles.followed(spark.createDataFrame(list(follow.items()), "id string, next string")).collect()}
    assert len(written) < 9
    for start, row in rows.items():
        seen, at = [], start
        while at is not None and at not in seen:
            seen.append(at)
            at = follow[at]
        assert row["cyclic"] == (at is not None)
        if row["cyclic"]:
            assert row["least"] == min(seen) and row["end"] in seen[seen.index(at):]
        else:
            assert (row["end"], row["steps"]) == (seen[-1], len(seen) - 1)
    assert {r["end"] for r in rows.values() if r["cyclic"]} == {i for i in follow if i[0] in "pc"}


def test_distinct_facts_give_the_edges_of_facts_without_a_shuffle(spark):
    rows = [(f"D{i}", "M1", i, "t", "1", "top", ["A", "a", None], ["S/1", "s 1"], [], None, None, f"D{i - 1}" if i % 3 else None)
            for i in range(20)]
    rows += rows[:2] + [("D4", "M2", 4, "t", "2", "top", ["b"], [], [], [], "7", "D3"), (None, "M1", 0, "t", "", "", [], [], [], [], "", "")]
    documents = _documents(spark, rows + rows[-1:])
    plain, found = graph.facts(documents), graph.distinct_facts(documents)
    assert {r["tdoc_id"] for r in found.filter("not alone").collect()} == {"D0", "D1", "D4", None}
    columns = ["tdoc_id", "meeting_id", "type", "entity", "predicate", "placeholder"]
    assert {tuple(r) for r in found.select(columns).collect()} == {tuple(r) for r in plain.select(columns).collect()}
    assert sorted(map(str, graph.edges(found).collect())) == sorted(map(str, graph.edges(plain).collect()))
    # Only documents that share an id are shuffled.
    plan = graph.edges(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "NOT alone" in plan[plan.index("Exchange"):]
    meetings = spark.createDataFrame([("M1", "one")], "id string, name string")
    assert sorted(map(str, graph.nodes(found, meetings).collect())) == sorted(map(str, graph.nodes(plain, meetings).drop("label").collect()))


def test_stored_tables_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {name for name in re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(" "))}

    before = files()
    kept = stored(spark.range(1000).repartition("id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_validated_writes_no_edges(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, name="rows": written.append(set(df.columns)) or stored(df, name))
    edges = spark.createDataFrame([("1", "tdoc", "a", "x", "topic", "t"), ("2", "tdoc", "a", "revises", "tdoc", "a")],
                                  "id string, source_type string, source_id string, predicate string, target_type string, target_id string")
    nodes = spark.createDataFrame([("tdoc", "a")], "type string, entity string")
    assert tuple(graph.validated(nodes, edges).first()) == (1, 2, 1, 1, False)
    assert written and not any("predicate" in columns for columns in written)


def test_planted_links_meet_revisions_only(spark, sf, monkeypatch):
    given = []
    monkeypatch.setattr(graph, "validated", lambda nodes, edges: given.append(edges) or edges)
    dataset_queries.QUERIES["graph_validation_cyclic"](spark, sf)
    plan = given[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "NOT alone" in plan[plan.index("Exchange"):]
    assert given[0].count() == given[0].distinct().count() > 0


def test_lines_leave_part_names_behind_where_no_title_is_asked_for(spark, sf, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, name="rows": written.append(df) or df)
    graph.distinct_facts(dataset_queries.records(spark, sf))
    assert "p_name" not in written[0]._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def doubled(sf, tmp_path_factory):
    """Tables in which every tenth order stands a second time, under another customer and so mostly in another meeting."""
    made, con = tmp_path_factory.mktemp("doubled"), duckdb.connect()
    for table in TABLES:
        again = f"UNION ALL SELECT * REPLACE (o_custkey + 1 AS o_custkey) FROM '{sf}/orders.parquet' WHERE o_orderkey % 10 = 0" if table == "orders" else ""
        con.execute(f"COPY (SELECT * FROM '{sf}/{table}.parquet' {again}) TO '{made}/{table}.parquet' (FORMAT parquet)")
    return str(made)


@pytest.mark.parametrize("name", ["group_graphs", "graph_orphans", "graph_bounded", "graph_validation"])
def test_documents_that_share_an_id(spark, doubled, name):
    columns, rows = spark_rows(dataset_queries.QUERIES[name](spark, doubled))
    assert rows and rows == sql_rows(dataset_queries.SQL[name], doubled, columns)


@pytest.mark.parametrize("fits", [0, 10 << 20])
def test_documents_equal_their_sql_wherever_suppliers_meet_lines(spark, doubled, monkeypatch, fits):
    monkeypatch.setattr(domain, "FITS", fits)
    columns, rows = spark_rows(domain.derive(spark, doubled, "tdocs").drop("received"))
    assert rows == sql_rows(domain.oracle(f"SELECT {', '.join(columns)} FROM tdocs", "tdocs"), doubled, columns)
    # Lines carry the supplier's key, not its name, to their document.
    found = domain._lists_of_lines(spark, doubled)._jdf.queryExecution().optimizedPlan().toString()
    moved = found[found.index("RepartitionByExpression"):].splitlines()[1]
    assert ("s_name" in moved, "l_suppkey" in moved) == ((True, False) if not fits else (False, True))
