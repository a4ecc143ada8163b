"""Evidence blocks, retrieval chunks and section trees.

Greedy packing depends on order, so it is one fold over a document's own block array. The fold
only records where each group starts; texts are then sliced and joined. Each fold stands behind a
generator, so it is evaluated once. Nothing is shuffled between source blocks and chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids, text
from ..sources.texts import NO_PATH


@dataclass(frozen=True)
class BlockLimits:
    target_tokens: int = 1000
    max_tokens: int = 1400


@dataclass(frozen=True)
class ChunkLimits:
    min_tokens: int = 300
    target_tokens: int = 500
    max_tokens: int = 700


def _slices(items: str, starts: str) -> Column:
    """``items`` cut at the 1-based positions ``starts``."""
    return F.transform(
        starts,
        lambda s, i: F.slice(
            F.col(items), s,
            F.coalesce(F.try_element_at(starts, i + 2), F.size(items) + 1) - s,
        ),
    )


def _fenced(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` and ``columns`` behind a generator, so that the optimiser cannot copy a fold into
    every place that reads its result."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _append_if(opened: Column, starts: Column, pos: Column) -> Column:
    return F.when(opened, F.concat(starts, F.array(pos))).otherwise(starts)


def coalesce_blocks(documents: DataFrame, limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Pack parser blocks into evidence blocks: ``(document_id, blocks)`` in, same shape out.

    Headings and blank blocks carry no text of their own; a heading closes the open group. A group
    holds one section and one group type, closes before it would exceed the maximum and once it
    reaches the target. Oversized blocks are split into word windows first.
    """
    size = text.max_words(limits.max_tokens)

    def element(b: Column, body: Column, n: Column) -> Column:
        return F.struct(
            b["kind"].alias("kind"), body.alias("text"), b["section_path"].alias("section_path"),
            b["table_row"].alias("table_row"), text.tokens_of_words(n).alias("tokens"),
            F.concat_ws(
                "\x01", text.group_type(b["kind"]), F.array_join(b["section_path"], "\x02")
            ).alias("key"),
        )

    # Words are counted once, since the pattern costs more than all the rest.
    counted = F.transform("blocks", lambda b: F.struct(b.alias("b"), text.word_count(b["text"]).alias("n")))
    cut = F.flatten(
        F.transform(
            F.filter(counted, lambda c: c["n"] > 0),
            lambda c: F.when(
                (c["b"]["kind"] != "heading") & (text.tokens_of_words(c["n"]) > limits.max_tokens),
                F.transform(text.word_windows(c["b"]["text"], size), lambda w: element(c["b"], w, text.word_count(w))),
            ).otherwise(F.array(element(c["b"], c["b"]["text"], c["n"]))),
        )
    )
    start = F.expr(
        "named_struct('open', false, 'tokens', 0, 'key', '', 'pos', 0, "
        "'starts', CAST(array() AS array<int>))"
    )

    def step(state: Column, e: Column) -> Column:
        heading = e["kind"] == "heading"
        joins = (
            state["open"] & (state["key"] == e["key"])
            & (state["tokens"] + e["tokens"] <= limits.max_tokens)
        )
        total = F.when(joins, state["tokens"]).otherwise(0) + e["tokens"]
        pos = state["pos"] + 1
        return F.struct(
            (~heading & (total < limits.target_tokens)).alias("open"),
            total.alias("tokens"), e["key"].alias("key"), pos.alias("pos"),
            _append_if(~heading & ~joins, state["starts"], pos).alias("starts"),
        )

    def pack(group: Column) -> Column:
        own = F.filter(group, lambda e: e["kind"] != "heading")
        kinds = F.array_distinct(F.transform(own, lambda e: e["kind"]))
        kind = F.when(F.size(kinds) == 1, kinds[0]).otherwise("paragraph")
        bodies = F.transform(own, lambda e: text.strip(e["text"]))
        return F.struct(
            kind.alias("kind"),
            F.when(own[0]["kind"] == "table_row", F.array_join(bodies, "\n"))
            .otherwise(F.array_join(bodies, "\n\n")).alias("text"),
            own[0]["section_path"].alias("section_path"),
            F.when(kind == "table_row", own[0]["table_row"]).alias("table_row"),
        )

    keep = [c for c in documents.columns if c != "blocks"]
    items = _fenced(documents, keep, {"_items": cut})
    cuts = _fenced(
        items, [*keep, "_items"],
        {"_starts": F.aggregate("_items", start, step, lambda s: s["starts"])},
    )
    staged = _fenced(cuts, keep, {"_packed": F.transform(_slices("_items", "_starts"), pack)})
    identified = F.transform(
        "_packed",
        lambda b, i: F.struct(
            ids.evidence_block_id(
                F.col("document_id"), i, b["kind"], b["section_path"], b["text"]
            ).alias("id"),
            b["kind"].alias("kind"), b["text"].alias("text"),
            b["section_path"].alias("section_path"), b["table_row"].alias("table_row"),
        ),
    )
    return _fenced(staged, keep, {"blocks": identified})


def coalesce_rows(rows: DataFrame, limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Parser blocks as long rows to evidence block rows; the longest run bounds a task's memory.

    Input: ``document_id, block_index, kind, text, section_path, table_row``. Packing never crosses a
    heading or a change of section or group type, so these runs are numbered and packed one by one; a
    document of any length is never gathered as a whole.
    """
    order = W.partitionBy("document_id").orderBy("block_index")
    heading = F.col("kind") == "heading"
    key = F.concat_ws("\x01", text.group_type(F.col("kind")), F.array_join("section_path", "\x02"))
    turned = (F.lag(key).over(order) != key) | heading | F.lag(heading).over(order)
    runs = (
        rows.filter(text.word_count(F.col("text")) > 0)
        .withColumn("run", F.sum(F.coalesce(turned, F.lit(True)).cast("int")).over(
            order.rowsBetween(W.unboundedPreceding, 0)
        ))
        .filter(~heading)
    )
    packed = coalesce_blocks(
        runs.groupBy("document_id", "run").agg(
            F.sort_array(F.collect_list(F.struct("block_index", "kind", "text", "section_path", "table_row")))
            .alias("blocks")
        ), limits,
    )
    placed = packed.select("document_id", "run", F.posexplode("blocks").alias("at", "b")).withColumn(
        "index", F.row_number().over(W.partitionBy("document_id").orderBy("run", "at")) - 1
    )
    fields = [F.col(f"b.{c}").alias(c) for c in ("kind", "text", "section_path", "table_row")]
    return placed.select("document_id", F.col("index").alias("block_index"), *fields).withColumn(
        "id", ids.evidence_block_id(F.col("document_id"), F.col("block_index"), F.col("kind"),
                                    F.col("section_path"), F.col("text"))
    )


def explode_blocks(documents: DataFrame) -> DataFrame:
    """Evidence-block arrays to rows."""
    keep = [c for c in documents.columns if c != "blocks"]
    rows = documents.select(*keep, F.posexplode("blocks").alias("block_index", "b"))
    return rows.select(
        F.col("b.id").alias("id"), *keep, "block_index", F.col("b.kind").alias("kind"),
        F.col("b.text").alias("text"), F.col("b.section_path").alias("section_path"),
        F.col("b.table_row").alias("table_row"),
    )


def build_chunks(documents: DataFrame, limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """Evidence-block arrays to retrieval chunk rows.

    A chunk closes before it would exceed the maximum, at a section change once it has the
    minimum, and once it reaches the target. A block above the maximum becomes its own parts.
    """
    size = text.max_words(limits.max_tokens)
    counted = F.transform(
        "blocks",
        lambda b: F.struct(
            b["id"].alias("id"), b["text"].alias("text"),
            b["section_path"].alias("section_path"), text.word_count(b["text"]).alias("words"),
        ),
    )
    items = F.filter(counted, lambda b: b["words"] > 0)
    start = F.expr(
        "named_struct('open', false, 'words', 0, 'path', CAST(array() AS array<string>), "
        "'pos', 0, 'starts', CAST(array() AS array<int>))"
    )

    def step(state: Column, b: Column) -> Column:
        oversized = text.tokens_of_words(b["words"]) > limits.max_tokens
        fits = text.tokens_of_words(state["words"] + b["words"]) <= limits.max_tokens
        same = state["path"] == b["section_path"]
        small = text.tokens_of_words(state["words"]) < limits.min_tokens
        joins = state["open"] & ~oversized & fits & (same | small)
        total = F.when(joins, state["words"]).otherwise(0) + b["words"]
        pos = state["pos"] + 1
        return F.struct(
            (~oversized & (text.tokens_of_words(total) < limits.target_tokens)).alias("open"),
            total.alias("words"), b["section_path"].alias("path"), pos.alias("pos"),
            _append_if(~joins, state["starts"], pos).alias("starts"),
        )

    def whole(group: Column) -> Column:
        block_ids = F.transform(group, lambda b: b["id"])
        body = F.array_join(F.transform(group, lambda b: b["text"]), "\n")
        return F.array(
            F.struct(
                ids.chunk_id(block_ids).alias("id"), block_ids.alias("block_ids"),
                body.alias("text"), F.element_at(group, -1)["section_path"].alias("section_path"),
                text.tokens_of_words(
                    F.aggregate(group, F.lit(0), lambda n, b: n + b["words"])
                ).alias("token_count"),
            )
        )

    def parts(block: Column) -> Column:
        return F.transform(
            text.word_windows(block["text"], size),
            lambda w, i: F.struct(
                ids.chunk_part_id(block["id"], i + 1, w).alias("id"),
                F.array(block["id"]).alias("block_ids"), w.alias("text"),
                block["section_path"].alias("section_path"),
                text.estimate_tokens(w).alias("token_count"),
            ),
        )

    def cut_group(g: Column) -> Column:
        oversized = text.tokens_of_words(g[0]["words"]) > limits.max_tokens
        return F.when(oversized, parts(g[0])).otherwise(whole(g))

    keep = [c for c in documents.columns if c != "blocks"]
    listed = _fenced(documents, keep, {"_items": items})
    cuts = _fenced(
        listed, [*keep, "_items"],
        {"_starts": F.aggregate("_items", start, step, lambda s: s["starts"])},
    )
    groups = _fenced(cuts, keep, {"_groups": _slices("_items", "_starts")})
    staged = (
        groups.select(*keep, F.flatten(F.transform("_groups", cut_group)).alias("_chunks"))
        .select(*keep, F.posexplode("_chunks").alias("chunk_index", "c"))
    )
    return staged.select(
        F.col("c.id").alias("id"), *keep, "chunk_index", F.col("c.block_ids").alias("block_ids"),
        F.col("c.text").alias("text"), F.col("c.section_path").alias("section_path"),
        F.col("c.token_count").alias("token_count"),
    )


def block_evidence_ids(block_ids: Column, version: Column, sha256: Column) -> Column:
    """Ordered distinct evidence ids of a chunk; the id is a hash, so no lookup is needed."""
    return F.array_distinct(
        F.transform(block_ids, lambda b: ids.evidence_id(version, sha256, b))
    )


def chunk_evidence(chunks: DataFrame, evidence_of_block: DataFrame) -> DataFrame:
    """Chunk ids with their evidence rows by join: ``(id, position, evidence_id)``."""
    pairs = chunks.select("id", F.posexplode("block_ids").alias("position", "block_id"))
    return (
        pairs.join(evidence_of_block, "block_id")
        .groupBy("id", "evidence_id")
        .agg(F.min("position").alias("position"))
    )


def section_tree(blocks: DataFrame) -> DataFrame:
    """Every section prefix of a document with its extent and counts.

    Input rows: ``document_id, block_index, section_path``. Counting is a plain aggregation, so a
    long document is combined before the shuffle.
    """
    tidy = F.filter(
        F.transform(
            F.coalesce(F.col("section_path"), F.expr(NO_PATH)),
            lambda p: text.strip(F.coalesce(p, F.lit(""))),
        ),
        lambda p: p != "",
    )
    leaves = (
        blocks.select("document_id", "block_index", tidy.alias("path"))
        .groupBy("document_id", "path")
        .agg(
            F.min("block_index").alias("lo"), F.max("block_index").alias("hi"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    own = F.col("depth") == F.size("path")
    # A section counts once for its parent; the root's parent row (depth -1) is left out.
    prefixes = leaves.select(
        "document_id", "path", "lo", "hi", "n",
        F.explode(F.sequence(F.lit(0), F.size("path"))).alias("depth"),
    ).select(
        "document_id", F.slice("path", F.lit(1), F.col("depth")).alias("path"), "depth", "lo",
        "hi", "n", F.when(own, F.col("n")).otherwise(0).alias("own"),
    ).groupBy("document_id", "path", "depth").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("own").alias("own"), F.sum("n").alias("n"),
    )
    parent = F.slice("path", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))
    itself = F.struct(
        F.col("path"), F.col("depth"), F.col("lo"), F.col("hi"), F.col("own"), F.col("n"),
        F.lit(0).cast("bigint").alias("children"),
    )
    nothing = F.lit(None).cast("int")
    for_parent = F.struct(
        parent.alias("path"), (F.col("depth") - 1).alias("depth"), nothing.alias("lo"),
        nothing.alias("hi"), F.lit(0).cast("bigint").alias("own"), F.lit(0).cast("bigint").alias("n"),
        F.lit(1).cast("bigint").alias("children"),
    )
    named = (
        prefixes.select("document_id", F.explode(F.array(itself, for_parent)).alias("s"))
        .select("document_id", "s.*").filter(F.col("depth") >= 0)
        .groupBy("document_id", "path", "depth")
        .agg(
            F.min("lo").alias("start_block_index"), F.max("hi").alias("end_block_index"),
            F.sum("own").alias("direct_block_count"), F.sum("n").alias("descendant_block_count"),
            F.sum("children").alias("child_count"),
        )
        .withColumn("title", F.when(F.col("depth") == 0, F.lit("Document")).otherwise(
            F.try_element_at("path", F.lit(-1))
        ))
    )
    return named.select(
        ids.section_id(F.col("document_id"), F.col("path")).alias("id"),
        F.when(F.col("depth") > 0, ids.section_id(F.col("document_id"), parent)).alias("parent_id"),
        "document_id", "title", F.col("path").alias("section_path"), "depth",
        "start_block_index", "end_block_index", "direct_block_count", "descendant_block_count",
        "child_count",
        text.page_number(F.col("title")).alias("page_number"),
    )


SECTION_ORDER = ("start_block_index", "depth", "section_path")


def page_of_blocks(blocks: DataFrame, start: int, limit: int) -> DataFrame:
    """One page of every document's blocks with the completeness of that page.

    Block indexes are dense, so a page is a range; one row of look-ahead tells whether more follow.
    """
    ahead = blocks.filter(F.col("block_index").between(start, start + limit))
    more = F.max("block_index").over(W.partitionBy("document_id")) >= start + limit
    return (
        ahead.withColumn("completeness", F.when(more, "partial").otherwise("complete"))
        .withColumn("next_start", F.when(F.col("completeness") == "partial", F.lit(start + limit)))
        .filter(F.col("block_index") < start + limit)
    )


def page_of_sections(tree: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of every document's sections in tree order with ``has_more``."""
    order = W.partitionBy("document_id").orderBy("start_block_index", "depth", F.array_join("section_path", "/"))
    ahead = tree.withColumn("_place", F.row_number().over(order)).filter(
        F.col("_place").between(offset + 1, offset + limit + 1)
    )
    more = F.max("_place").over(W.partitionBy("document_id")) > offset + limit
    return ahead.withColumn("has_more", more).filter(F.col("_place") <= offset + limit).drop("_place")
