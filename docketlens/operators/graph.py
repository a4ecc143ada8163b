"""Typed knowledge graph of documents: facts, validation and revision chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..session import cut_lineage, stored
from . import cycles

_FACT = "array<struct<type:string,entity:string,label:string,predicate:string,placeholder:boolean>>"

#: Type of the entity and whether it is a placeholder, by predicate.
_KINDS = {
    "contains": ("tdoc", False), "submitted_by": ("organization", False), "belongs_to_agenda": ("agenda_item", False),
    "mentions_topic": ("topic", False), "affects_spec": ("specification", False), "targets_release": ("release", False),
    "related_to_work_item": ("work_item", False), "has_change_request": ("change_request", False), "revises": ("tdoc", True),
}


def _fact(predicate: str, entity: Column, label: Column) -> Column:
    kind, placeholder = _KINDS[predicate]
    return F.struct(
        F.lit(kind).alias("type"), entity.alias("entity"), label.alias("label"),
        F.lit(predicate).alias("predicate"), F.lit(placeholder).alias("placeholder"),
    )


def facts(documents: DataFrame) -> DataFrame:
    """One row per related entity of every document.

    Columns: ``tdoc_id, meeting_id, seq, type, entity, label, predicate, placeholder``; the document
    itself is its meeting's ``contains`` fact.
    """
    return listed_facts(gathered_facts(documents))


def stored_facts(documents: DataFrame) -> DataFrame:
    """``facts`` whose values are made once and written per document, for jobs that go over them several times."""
    return listed_facts(stored(gathered_facts(documents), "facts").repartition("tdoc_id"))


def distinct_facts(documents: DataFrame) -> DataFrame:
    """Each document's distinct facts without labels, made once, for jobs that go over them several times.

    Columns: ``tdoc_id, meeting_id, alone, type, entity, predicate, placeholder``. What is written is a row per
    document with its entities. No other document has the id of an ``alone`` one, so that its facts are told apart
    wherever they are read (``told_apart``).
    """
    parts = _parts(lambda predicate, entity, label: entity)
    # Documents that lie by id are counted where they lie.
    counted = documents.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("id")) == 1)
    kept = stored(counted.select(
        F.col("id").alias("tdoc_id"), "meeting_id", "alone", *[F.array_distinct(p).alias(name) for name, p in parts.items()]
    ), "facts")
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("type"), F.lit(predicate).alias("predicate"), F.lit(placeholder).alias("placeholder"),
                 F.col(predicate).alias("entities"))
        for predicate, (kind, placeholder) in _KINDS.items()
    ])
    return kept.select("tdoc_id", "meeting_id", "alone", F.inline(kinds)).select(
        "tdoc_id", "meeting_id", "alone", "type", F.explode("entities").alias("entity"), "predicate", "placeholder"
    )


def told_apart(found: DataFrame, *columns: Column | str) -> DataFrame:
    """The distinct ``columns`` of facts, the document's id and the rest of what makes them distinct among them.

    Of ``distinct_facts`` only those of documents that share an id have to meet.
    """
    if "alone" not in found.columns:
        return found.select(*columns).distinct()
    return found.filter("alone").select(*columns).unionByName(found.filter("not alone").select(*columns).distinct())


def listed_facts(gathered: DataFrame) -> DataFrame:
    return gathered.select("tdoc_id", "meeting_id", "seq", F.posexplode("f").alias("pos", "f")).select(
        "tdoc_id", "meeting_id", "seq", "pos", "f.*"
    )


def gathered_facts(documents: DataFrame) -> DataFrame:
    """``tdoc_id, meeting_id, seq`` and the array ``f`` of a document's facts."""
    nothing = F.expr(f"cast(array() as {_FACT})")
    return documents.select(
        F.col("id").alias("tdoc_id"), "meeting_id", "seq",
        F.concat(*[F.coalesce(p, nothing) for p in _parts(_fact).values()]).alias("f"),
    )


def _parts(make: Callable[[str, Column, Column], Column]) -> dict[str, Column]:
    """By predicate the array of ``make(predicate, entity, label)`` of a document; null or empty where it states none."""

    def given(value: Column) -> Column:
        return F.coalesce(value, F.lit("")) != ""

    def listed(predicate: str, values: Column) -> Column:
        return F.transform(values, lambda v: make(predicate, text.canonical_identifier(v), v))

    item, topic = F.col("agenda_item"), F.col("agenda_description")
    number = F.when(given(item), item).otherwise(topic)
    agenda_id = F.concat("meeting_id", F.lit(":"), text.canonical_identifier(number))
    agenda_label = F.when(given(topic), topic).otherwise(item)
    title = F.when(given(F.col("title")), F.col("title")).otherwise(F.col("id"))
    change_id = F.concat("meeting_id", F.lit(":"), text.canonical_identifier(F.col("cr_number")))
    change_label = F.concat(F.lit("CR "), F.col("cr_number"))
    before = F.col("revised_from")
    made = {
        "contains": F.array(make("contains", F.col("id"), title)),
        "submitted_by": listed("submitted_by", F.col("companies")),
        "belongs_to_agenda": F.when(
            given(item) | given(topic), F.array(make("belongs_to_agenda", agenda_id, agenda_label))),
        "mentions_topic": F.when(given(topic), F.array(make("mentions_topic", text.canonical_identifier(topic), topic))),
        "affects_spec": listed("affects_spec", F.col("specifications")),
        "targets_release": listed("targets_release", F.col("releases")),
        "related_to_work_item": listed("related_to_work_item", F.col("work_items")),
        "has_change_request": F.when(
            given(F.col("cr_number")), F.array(make("has_change_request", change_id, change_label))),
        "revises": F.when(given(before), F.array(make("revises", before, before))),
    }
    return made


def nodes(found: DataFrame, meetings: DataFrame) -> DataFrame:
    """Distinct ``(type, entity, label, placeholder)``; the first fact wins, a real one over a placeholder.

    A popular entity is reduced in each task before the shuffle (``min_by`` combines partially). Facts without
    labels give nodes without labels.
    """
    labelled = "label" in found.columns
    label = [F.min_by("label", F.struct("placeholder", "seq", "pos")).alias("label")] if labelled else []
    chosen = found.groupBy("type", "entity").agg(*label, F.min("placeholder").alias("placeholder"))
    of_meetings = meetings.select(
        F.lit("meeting").alias("type"), F.col("id").alias("entity"), F.col("name").alias("label"),
        F.lit(False).alias("placeholder"),
    ).distinct()
    return chosen.unionByName(of_meetings.select(*chosen.columns))


def edges(found: DataFrame, version: str = "v1") -> DataFrame:
    """Distinct edges with their content-hash id.

    A document's edges are told apart by its id, so facts that already lie by document are not shuffled.
    """
    contains = F.col("predicate") == "contains"
    once = told_apart(
        found, "tdoc_id", F.when(contains, F.col("meeting_id")).alias("meeting_id"), "predicate", "type", "entity"
    )
    return once.select(
        F.when(contains, "meeting").otherwise("tdoc").alias("source_type"),
        F.when(contains, F.col("meeting_id")).otherwise(F.col("tdoc_id")).alias("source_id"),
        "predicate", F.col("type").alias("target_type"), F.col("entity").alias("target_id"),
    ).withColumn(
        "id", ids.stored_edge_id(F.lit(version), F.col("source_type"), F.col("source_id"),
                                 F.col("predicate"), F.col("target_type"), F.col("target_id"))
    )


def orphans(all_edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Edges whose source or target is no node, and ``revises`` edges between other types."""
    return _faults(all_edges, all_nodes).select("id", "problem")


def _faults(all_edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Faulty edges with their ``problem``.

    Many edges share an end, so each distinct end is looked up once; edges then meet only the ends that are missing.
    """
    sides = {side: [F.col(f"{side}_type").alias("type"), F.col(f"{side}_id").alias("entity")] for side in ("source", "target")}
    both = F.explode(F.array(*[F.struct(*columns) for columns in sides.values()])).alias("end")
    ends = all_edges.select(both).select("end.*").distinct()
    missing = stored(ends.join(all_nodes.select("type", "entity").distinct(), ["type", "entity"], "left_anti"), "missing")
    looked = all_edges
    for side in sides:
        gone = missing.select(F.col("type").alias("_type"), F.col("entity").alias("_entity"), F.lit(True).alias(f"_no_{side}"))
        same = F.col(f"{side}_type").eqNullSafe(F.col("_type")) & F.col(f"{side}_id").eqNullSafe(F.col("_entity"))
        looked = looked.join(gone, same, "left").drop("_type", "_entity")
    other = (F.col("predicate") == "revises") & ((F.col("source_type") != "tdoc") | (F.col("target_type") != "tdoc"))
    problems = F.array_compact(F.array(
        F.when(F.col("_no_source"), F.lit("orphan source")), F.when(F.col("_no_target"), F.lit("orphan target")),
        F.when(other, F.lit("revises other type")),
    ))
    return looked.withColumn("problem", F.explode(problems)).drop("_no_source", "_no_target")


def containment_faults(all_edges: DataFrame) -> DataFrame:
    """Documents that not exactly one meeting contains."""
    return (
        all_edges.filter((F.col("predicate") == "contains") & (F.col("target_type") == "tdoc"))
        .groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != 1)
    )


def within(all_edges: DataFrame, some_nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``some_nodes``."""
    known = some_nodes.select("type", "entity").distinct()
    out = all_edges
    for side in ("source", "target"):
        out = out.join(
            known, (F.col(f"{side}_type") == known["type"]) & (F.col(f"{side}_id") == known["entity"]),
            "left_semi",
        )
    return out


def chain_places(links: DataFrame) -> DataFrame:
    """``(id, previous)`` to ``(id, root, depth, is_cyclic)`` with all predecessors kept, see ``cycles.places``."""
    return cycles.places(links)


def revision_links(all_edges: DataFrame) -> DataFrame:
    """``(src, dst)`` of the ``revises`` edges between documents."""
    return all_edges.filter(
        (F.col("predicate") == "revises") & (F.col("source_type") == "tdoc") & (F.col("target_type") == "tdoc")
    ).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


def chain_jumps(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Places of documents with one predecessor each, and per round the predecessor 1, 2, 4, ... steps before.

    Of several predecessors the smallest counts. ``(id, previous)`` to ``(id, root, depth, is_cyclic)`` by pointer doubling.

    ``depth`` counts the documents from the root to the row, root included. After about log2 of the
    longest chain every pointer has left its chain; pointers that have not within log2 of all rows
    are on or behind a cycle. Each round joins and writes the open rows only.
    """
    known = stored(links.select("id").distinct(), "ids")
    places = stored(
        links.join(known.withColumnRenamed("id", "previous"), "previous", "left_semi")
        .groupBy("id").agg(F.min("previous").alias("far"))
        .join(known, "id", "right")
        .select("id", "far", F.lit(1).cast("long").alias("steps"), F.col("id").alias("root")), "chains"
    )
    rounds = max(1, known.count()).bit_length() + 1
    # Rows whose pointer has left its chain are done; they are read again, but neither joined nor written.
    done, still = places.filter("far is null"), places.filter("far is not null")
    jumps = [still.select("id", "far")]
    for _ in range(rounds):
        if not still.limit(1).count():
            break
        ahead = done.unionByName(still).select(
            F.col("id").alias("far"), F.col("far").alias("next"), F.col("steps").alias("more"),
            F.col("root").alias("next_root"),
        )
        moved = stored(still.join(ahead, "far").select(
            "id", F.col("next").alias("far"), (F.col("steps") + F.col("more")).alias("steps"), F.col("next_root").alias("root"),
        ), "chains")
        done, still = done.unionByName(moved.filter("far is null")), moved.filter("far is not null")
        jumps.append(still.select("id", "far"))
    cyclic = F.col("far").isNotNull()
    places = done.unionByName(still).select(
        "id", F.when(~cyclic, F.col("root")).alias("root"), F.when(~cyclic, F.col("steps")).alias("depth"),
        cyclic.alias("is_cyclic"),
    )
    return places, jumps


def revision_stats(documents: DataFrame) -> DataFrame:
    """Revision links and those whose predecessor belongs to another meeting, as one row."""
    before = documents.select(F.col("id").alias("revised_from"), F.col("meeting_id").alias("before_meeting"))
    joined = documents.filter(F.col("revised_from").isNotNull()).join(before, "revised_from", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("revision_edges"),
        F.count_if(F.col("before_meeting") != F.col("meeting_id")).alias("cross_meeting_edges"),
    )


def longest_chain(documents: DataFrame) -> DataFrame:
    """Documents of the longest revision chain in order; ties go to the smallest id sequence.

    The steps of every chain of greatest length are looked up in the jump tables, one join per bit of
    the distance, so a chain of a thousand documents takes ten joins over the tied chains alone.
    """
    places, jumps = chain_jumps(documents.select("id", F.col("revised_from").alias("previous")))
    whole = places.filter(~F.col("is_cyclic"))
    deepest = whole.agg(F.max("depth").alias("depth"))
    here = whole.join(deepest, "depth").select(
        F.col("id").alias("end"), F.col("id"), "depth",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth") - 1)).alias("back"),
    )
    for bit, table in enumerate(jumps):
        wanted = F.when(F.col("back").bitwiseAND(1 << bit) != 0, F.col("h.id"))
        here = here.alias("h").join(table.alias("j"), wanted == F.col("j.id"), "left").select(
            "end", F.when(wanted.isNotNull(), F.col("j.far")).otherwise(F.col("h.id")).alias("id"),
            "depth", "back",
        )
    paths = here.groupBy("end").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("place"), "id"))).alias("path")
    ).withColumn("ids", F.transform("path", lambda p: p["id"]))
    best = paths.orderBy("ids").limit(1)
    return best.select(F.posexplode("ids").alias("position", "id"))


def scope_nodes(found: DataFrame, meetings: DataFrame) -> DataFrame:
    """Nodes of a scope with ``boundary``: predecessors that the scope does not hold."""
    return nodes(found, meetings).select(
        F.concat("type", F.lit(":"), "entity").alias("id"), "type", "entity", "label",
        F.col("placeholder").alias("boundary"),
    )


def scope_edges(found: DataFrame, meetings: DataFrame) -> DataFrame:
    """Edges of a scope with view ids; ``contains`` only from meetings of the scope."""
    plain = edges(found)
    known = meetings.select(F.lit("meeting").alias("source_type"), F.col("id").alias("source_id"))
    kept = plain.filter("source_type <> 'meeting'").unionByName(
        plain.join(known, ["source_type", "source_id"], "left_semi").select(*plain.columns)
    )
    source = F.concat("source_type", F.lit(":"), "source_id")
    target = F.concat("target_type", F.lit(":"), "target_id")
    return kept.select(
        ids.view_edge_id(source, F.col("predicate"), target).alias("id"), source.alias("source"),
        target.alias("target"), F.col("predicate").alias("type"),
    )


def highlighted(view_edges: DataFrame, chain: DataFrame) -> DataFrame:
    """View edges with ``highlighted`` for revisions along the longest chain ``(position, id)``."""
    key = F.concat(F.lit("tdoc:"), "id")
    after = chain.select(key.alias("source"), F.col("position").alias("_later"))
    before = chain.select(key.alias("target"), F.col("position").alias("_earlier"))
    on_chain = (F.col("type") == "revises") & F.col("_later").isNotNull() & F.col("_earlier").isNotNull()
    return (
        view_edges.join(after, "source", "left").join(before, "target", "left")
        .withColumn("highlighted", on_chain).drop("_later", "_earlier")
    )


def dated(all_edges: DataFrame, documents: DataFrame, meetings: DataFrame) -> DataFrame:
    """Edges with ``valid_at``, the end of the meeting that states them."""
    ends = meetings.select(F.col("id").alias("meeting_id"), "ends_on")
    of_document = documents.select(F.col("id").alias("source_id"), "meeting_id").join(ends, "meeting_id", "left")
    by_document = of_document.select("source_id", F.col("ends_on").alias("valid_at"))
    by_meeting = ends.select(F.col("meeting_id").alias("source_id"), F.col("ends_on").alias("valid_at"))
    stated = by_document.withColumn("source_type", F.lit("tdoc")).unionByName(
        by_meeting.withColumn("source_type", F.lit("meeting"))
    )
    return all_edges.join(stated, ["source_type", "source_id"], "left")


def validated(all_nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """One row of graph counts and faults; a valid graph has no fault, no revision cycle and is not empty.

    Edges are many and wide, so they are not written but read several times; they should come from written facts.
    """
    all_edges = all_edges.select("source_type", "source_id", "predicate", "target_type", "target_id")
    all_nodes = stored(all_nodes.select("type", "entity"), "nodes")
    circular = cycles.strong_components(revision_links(all_edges)).select("component").distinct()
    parts = {name: rows.agg(F.count(F.lit(1)).alias("n")) for name, rows in {
        "nodes": all_nodes, "edges": all_edges, "faults": _faults(all_edges, all_nodes), "cycles": circular,
    }.items()}
    rows = None
    for name, one in parts.items():
        named = one.select(F.lit(name).alias("what"), "n")
        rows = named if rows is None else rows.unionByName(named)
    counts = rows.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in parts])
    return counts.withColumn(
        "valid", (F.col("nodes") > 0) & (F.col("edges") > 0) & (F.col("faults") + F.col("cycles") == 0)
    )
