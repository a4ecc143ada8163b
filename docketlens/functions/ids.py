"""Deterministic content-hash identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hashed(prefix: str, length: int, *parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, length))


def artifact_id(version: Column, url: Column, sha256: Column) -> Column:
    return _hashed("artifact-", 32, version, url, sha256)


def evidence_id(version: Column, sha256: Column, key: Column) -> Column:
    return _hashed("evidence-", 24, version, sha256, key)


def stored_edge_id(
    version: Column, source_type: Column, source_id: Column, predicate: Column,
    target_type: Column, target_id: Column,
) -> Column:
    return _hashed(
        "edge-", 32, version, source_type, source_id, predicate, target_type, target_id
    )


def view_edge_id(source: Column, predicate: Column, target: Column) -> Column:
    return _hashed("edge-", 32, source, predicate, target)


def source_block_id(document_id: Column, index: Column, text: Column) -> Column:
    return _hashed("block-", 20, document_id, index.cast("string"), text)


def evidence_block_id(
    document_id: Column, index: Column, kind: Column, path: Column, text: Column
) -> Column:
    return _hashed(
        "block-", 20, document_id, index.cast("string"), kind, F.array_join(path, "/"), text
    )


def chunk_id(block_ids: Column) -> Column:
    return _hashed("chunk-", 20, F.array_join(block_ids, "|"))


def chunk_part_id(block_id: Column, part: Column, text: Column) -> Column:
    return _hashed(
        "chunk-", 20, block_id, F.concat(F.lit("part:"), part.cast("string")), text
    )


def section_id(document_id: Column, path: Column) -> Column:
    return _hashed("section-", 20, document_id, F.array_join(path, "/"))
