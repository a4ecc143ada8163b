"""Decoded text, styled paragraphs, sheets and slides as block arrays, one row per document.

A document's blocks travel as one array column, so cutting, coalescing and chunking run inside the
row without a shuffle. No document is refused for its size; ``large_documents`` reports the large ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import ids, text

BLOCK_FIELDS = ("kind", "text", "section_path", "table_row")
NO_PATH = "CAST(array() AS array<string>)"
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def block_struct(kind: Column, body: Column, path: Column, row: Column | None = None) -> Column:
    table_row = F.lit(None).cast("int") if row is None else row.cast("int")
    return F.struct(
        kind.alias("kind"), body.alias("text"), path.alias("section_path"),
        table_row.alias("table_row"),
    )


# --- fixed values: Windows-1252 characters of the bytes 0x80 to 0x9F; five bytes have none ---------
_CP1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰",
    0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•",
    0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
_CP1252_UNDEFINED = "[\x81\x8D\x8F\x90\x9D]"


def decode_bytes(content: Column) -> Column:
    """UTF-8 with an optional byte-order mark, else Windows-1252; null for what is not text.

    Null stands for binary content (a NUL byte) and for bytes that neither encoding defines.
    """
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    latin = F.decode(content, "ISO-8859-1")
    western = F.when(
        ~F.rlike(latin, F.lit(_CP1252_UNDEFINED)),
        F.translate(latin, "".join(map(chr, _CP1252)), "".join(_CP1252.values())),
    )
    plain = F.regexp_replace(F.coalesce(utf8, western), "^\\x{FEFF}", "")
    return F.when(F.rlike(plain, F.lit("\\x00")), None).otherwise(plain)


def lines(body: Column) -> Column:
    """Non-blank trimmed lines."""
    return F.filter(F.transform(F.split(body, LINE_BREAK), text.strip), lambda x: x != "")


def paragraphs(body: Column) -> Column:
    """Blank-line separated paragraphs, their lines trimmed and joined by a space."""
    unified = F.regexp_replace(body, LINE_BREAK, "\n")
    cut = F.split(unified, r"(?U)\n(?:(?:[^\S\n]|\x1f)*\n)+")
    joined = F.transform(
        cut,
        lambda p: F.array_join(
            F.filter(F.transform(F.split(p, "\n"), text.strip), lambda x: x != ""), " "
        ),
    )
    return F.filter(joined, lambda p: p != "")


def text_blocks(documents: DataFrame, document_id: Column, body: Column) -> DataFrame:
    """Plain text: one paragraph block per blank-line paragraph."""
    return documents.select(
        document_id.alias("document_id"),
        F.transform(
            paragraphs(body), lambda p: block_struct(F.lit("paragraph"), p, F.expr(NO_PATH))
        ).alias("blocks"),
    )


def gather(
    rows: DataFrame, order: list[str], fields: dict[str, Column], key: str = "document_id",
) -> DataFrame:
    """Long rows to one ordered array per key."""
    packed = F.struct(*[F.col(c) for c in order], *[v.alias(n) for n, v in fields.items()])
    names = list(fields)
    return (
        rows.groupBy(key)
        .agg(F.sort_array(F.collect_list(packed)).alias("_rows"))
        .select(
            key,
            F.transform("_rows", lambda r: F.struct(*[r[n].alias(n) for n in names])).alias(
                "blocks"
            ),
        )
    )


def large_documents(rows: DataFrame, elements: int, key: str = "document_id") -> DataFrame:
    """A report of keys with more than ``elements`` rows; nothing is removed by it."""
    return (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("elements"))
        .filter(F.col("elements") > elements)
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    """``(document_id, page, text)`` rows to paragraph blocks under a ``Page n`` section."""
    per_page = pages.select(
        "document_id", "page", F.posexplode(paragraphs(F.col("text"))).alias("pos", "para")
    )
    fields = {
        "kind": F.lit("paragraph"),
        "text": F.col("para"),
        "section_path": F.array(F.concat(F.lit("Page "), F.col("page").cast("string"))),
        "table_row": F.lit(None).cast("int"),
    }
    return gather(per_page, ["page", "pos"], fields)


def styled_blocks(documents: DataFrame) -> DataFrame:
    """Styled paragraphs, then table rows, to blocks with their heading path.

    Input: ``document_id``, ``paragraphs array<struct<style,text>>`` and optionally
    ``tables array<array<array<string>>>`` (table, row, cell).
    """
    typed = F.transform(
        F.filter("paragraphs", lambda p: text.strip(p["text"]) != ""),
        lambda p: F.struct(
            text.paragraph_kind(text.strip(p["text"]), p["style"]).alias("kind"),
            text.strip(p["text"]).alias("text"),
            text.heading_level(F.lower(F.coalesce(p["style"], F.lit("")))).alias("level"),
        ),
    )
    # Only headings change the path, so the fold visits headings and slices the rest between them.
    heads = F.filter(
        F.transform(
            "typed", lambda p, i: F.struct((i + 1).alias("pos"), p.alias("p"))
        ),
        lambda x: x["p"]["kind"] == "heading",
    )
    empty = F.expr(
        "named_struct('path', CAST(array() AS array<string>), "
        "'out', CAST(array() AS array<array<string>>))"
    )

    def descend(state: Column, head: Column) -> Column:
        kept = F.slice(state["path"], F.lit(1), head["p"]["level"] - 1)
        path = F.concat(kept, F.array(head["p"]["text"]))
        return F.struct(
            path.alias("path"), F.concat(state["out"], F.array(path)).alias("out")
        )

    staged = (
        documents.withColumn("typed", typed)
        .withColumn("heads", heads)
        .withColumn("paths", F.aggregate("heads", empty, descend, lambda s: s["out"]))
        .withColumn("starts", F.transform("heads", lambda h: h["pos"]))
    )

    def blocks_of(part: Column, path: Column) -> Column:
        return F.transform(part, lambda p: block_struct(p["kind"], p["text"], path))

    first = F.coalesce(F.try_element_at("starts", F.lit(1)), F.size("typed") + 1)
    lead = blocks_of(F.slice("typed", F.lit(1), first - 1), F.expr(NO_PATH))
    sections = F.transform(
        "starts",
        lambda s, i: blocks_of(
            F.slice(
                F.col("typed"), s,
                F.coalesce(F.try_element_at("starts", i + 2), F.size("typed") + 1) - s,
            ),
            F.element_at("paths", i + 1),
        ),
    )
    body = F.concat(lead, F.flatten(sections))
    if "tables" not in documents.columns:
        return staged.select("document_id", body.alias("blocks"))
    last_path = F.when(F.size("paths") > 0, F.element_at("paths", -1)).otherwise(F.expr(NO_PATH))
    rows = F.flatten(
        F.transform(
            "tables",
            lambda t: F.transform(
                t, lambda r, i: block_struct(F.lit("table_row"), joined_cells(r), last_path, i)
            ),
        )
    )
    return staged.select(
        "document_id", F.concat(body, F.filter(rows, lambda b: b["text"] != "")).alias("blocks")
    )


def joined_cells(cells: Column) -> Column:
    tidy = F.transform(cells, lambda c: F.coalesce(text.strip(c), F.lit("")))
    return F.array_join(F.filter(tidy, lambda c: c != ""), " | ")


def sheet_rows(grid: DataFrame) -> DataFrame:
    """Visible, public sheet rows that hold text: ``(document_id, sheet_no, sheet, row_no, text)``."""
    shown = ~F.lower(text.strip(F.col("sheet"))).isin(*K.PRIVATE_SHEETS)
    if "sheet_state" in grid.columns:
        shown = shown & (F.col("sheet_state") == "visible")
    return (
        grid.filter(shown)
        .select(
            "document_id", "sheet_no", "sheet", "row_no",
            joined_cells(F.col("cells")).alias("text"),
        )
        .filter(F.col("text") != "")
    )


def sheet_blocks(grid: DataFrame) -> DataFrame:
    """Visible, public sheet rows to table-row blocks."""
    rows = sheet_rows(grid)
    fields = {
        "kind": F.lit("table_row"),
        "text": F.col("text"),
        "section_path": F.array("sheet"),
        "table_row": F.col("row_no").cast("int"),
    }
    return gather(rows, ["sheet_no", "row_no"], fields)


def slide_blocks(shapes: DataFrame) -> DataFrame:
    """Slide text to blocks.

    Input rows: ``document_id, slide, shape, para, is_title, is_list, text`` with ``cells`` for
    table rows (``shape`` after the text shapes). A slide's title is the first paragraph of its
    first text shape; it becomes a heading and names the section of everything after it.
    """
    body = F.when(
        F.col("cells").isNotNull(), joined_cells(F.col("cells"))
    ).otherwise(text.strip(F.col("text")))
    rows = shapes.withColumn("text", body).filter(F.col("text") != "")
    spoken = F.col("cells").isNull()
    place = F.struct("shape", "para")
    slide = W.partitionBy("document_id", "slide")
    titled = rows.withColumn(
        "title", F.min(F.when(spoken, F.struct(place.alias("place"), F.col("text")))).over(slide)
    )
    label = F.concat(F.lit("Slide "), F.col("slide").cast("string"))
    is_title = spoken & (place == F.col("title.place"))
    path = F.when(F.col("title").isNull(), F.array(label)).otherwise(
        F.array(label, F.col("title.text"))
    )
    kind = (
        F.when(F.col("cells").isNotNull(), "table_row")
        .when(is_title, "heading")
        .when(F.col("is_list"), "list_item")
        .otherwise(text.paragraph_kind(F.col("text"), F.lit("")))
    )
    fields = {
        "kind": kind,
        "text": F.col("text"),
        "section_path": path,
        "table_row": F.when(F.col("cells").isNotNull(), F.col("para")).cast("int"),
    }
    return gather(titled, ["slide", "shape", "para"], fields)


def usable_members(members: DataFrame) -> DataFrame:
    """Archive members whose text counts: no system copies, no bundled export workbooks."""
    path = F.replace(F.col("filename"), F.lit("\\"), F.lit("/"))
    parts = F.split(path, "/")
    system = F.exists(parts, lambda p: (p == "__MACOSX") | F.startswith(p, F.lit("._")))
    base = F.lower(F.element_at(parts, -1))
    bundled = (text.extension(base) == ".xlsx") & (
        F.startswith(base, F.lit("tdoc_list_")) | F.startswith(base, F.lit("partlist_"))
    )
    return members.filter(
        ~system & ~bundled & text.extension(base).isin(*K.SUPPORTED_SUFFIXES)
    )


def merge_members(member_blocks: DataFrame) -> DataFrame:
    """Concatenate the members' block arrays in archive order: ``(document_id, member_no, blocks)``."""
    fields = {"member_blocks": F.col("blocks")}
    packed = gather(member_blocks, ["member_no"], fields)
    return packed.select(
        "document_id",
        F.flatten(F.transform("blocks", lambda m: m["member_blocks"])).alias("blocks"),
    )


def explode_source_blocks(documents: DataFrame) -> DataFrame:
    """Block arrays to rows with the parser's block ids (index re-derived from the position)."""
    rows = documents.select(
        "document_id", F.posexplode("blocks").alias("block_index", "b")
    )
    return rows.select(
        ids.source_block_id(F.col("document_id"), F.col("block_index"), F.col("b.text")).alias(
            "id"
        ),
        "document_id", "block_index",
        *[F.col(f"b.{name}").alias(name) for name in BLOCK_FIELDS],
    )
