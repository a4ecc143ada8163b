"""Literal expectations of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from docketlens.functions import dates, text
from docketlens.sources import texts


@pytest.mark.parametrize("raw, want", [
    (None, "unknown"), ("  NOT   pursued ", "not_pursued"), ("not handled", "not_treated"), ("agreed", "agreed"),
    ("approved", "approved"), ("rejected", "rejected"), ("revised", "revised"), ("withdrawn", "withdrawn"),
    ("unrecognized", "unknown"),
])
def test_status(value, raw, want):
    assert value(text.normalize_status(F.lit(raw).cast("string"))) == want


def test_multi_value(value):
    assert value(text.split_multi_value(F.lit("blue;red\n\nblue, - ;green,,red"))) == ["blue", "red", "green"]


def test_organisations(value):
    raw = "Northern Radio; Delta (pen holder)? Old Harbour Labs, Inc. • [Quay]"
    assert value(text.split_organization_sources(F.lit(raw))) == [
        "Northern Radio", "Delta", "Old Harbour Labs, Inc", "Quay"
    ]


def test_organisation_aliases(value):
    assert value(text.normalize_organization(F.lit(" Qualcomm  INCORPORATED,"))) == "Qualcomm"
    assert value(text.normalize_organization(F.lit("Harbour LM"), {})) == "Harbour LM"
    with pytest.raises(ValueError):
        text.alias_pairs({"A": ("x",), "B": ("X",)})


def test_alias_table(spark):
    rows = spark.createDataFrame([("acme  corp",), ("Other",)], "name string")
    aliases = spark.createDataFrame([("Acme Corp", "Acme"), ("ACME corp", "Acme Two")], "alias string, canonical string")
    assert text.alias_conflicts(aliases).count() == 1
    named = text.with_canonical_names(rows, "name", aliases.limit(1)).collect()
    assert {r["canonical"] for r in named} == {"Acme", "Other"}


@pytest.mark.parametrize("cell, want", [
    (1e20, "100000000000000000000"), (1e-5, "1e-05"), (1.5e-7, "1.5e-07"), (0.00012, "0.00012"), (1.5, "1.5"),
    (3.0, "3"), (-2.25, "-2.25"), (123456789.125, "123456789.125"), (None, ""),
])
def test_float_cells(value, cell, want):
    assert value(text.cell_text(F.lit(cell).cast("double"), "double")) == want


def test_other_cells(value):
    at = F.lit("2024-01-02 03:04:05.123").cast("timestamp")
    assert value(text.cell_text(at, "timestamp")) == "2024-01-02T03:04:05.123000"
    assert value(text.cell_text(F.lit(True), "boolean")) == "TRUE"
    assert value(text.cell_text(F.lit("  x "), "string")) == "x"


@pytest.mark.parametrize("style, want", [("heading 2 3rd", 2), ("heading 3", 3), ("title", 1), ("heading 0", 1)])
def test_heading_level(value, style, want):
    assert value(text.heading_level(F.lit(style))) == want


@pytest.mark.parametrize("name, want", [("dir/r2-1.zip", "R2-1"), ("a.b.docx", "A.B"), ("plain", "PLAIN")])
def test_document_id(value, name, want):
    assert value(text.document_id_of(F.lit(name))) == want


def test_tokens_and_scores(value):
    assert value(text.tokenize(F.lit("See X2-77, part_b/4.1 (or: 9.9).")))  == ["see", "x2-77", "part_b/4.1", "or", "9.9"]
    assert value(text.lexical_score(F.lit("slow boats"), F.lit("Slow boats drift"))) == 4.0
    assert value(text.cosine_similarity(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


@pytest.mark.parametrize("raw, want", [
    (b"caf\xe9 \x80 \x93x\x94", "café € “x”"), (b"\x81", None), ("ä".encode(), "ä"), (b"\xef\xbb\xbfhi", "hi"),
    (b"a\x00b", None), (b"", ""),
])
def test_decoding(value, raw, want):
    assert value(texts.decode_bytes(F.lit(bytearray(raw)))) == want


@pytest.mark.parametrize("line, want", [
    ("18/05/2026 to 22/05/2026", ("2026-05-18", "2026-05-22")),
    ("24 June - 01 July 2026", ("2026-06-24", "2026-07-01")),
    ("R2-2400001 Athens, Aug. 24th - 28th", ("2024-08-24", "2024-08-28")),
    ("from Monday 18 to Friday 22 of May 2026", ("2026-05-18", "2026-05-22")),
    ("14-18 October 2024", ("2024-10-14", "2024-10-18")),
    ("31/02/2026 to 22/05/2026 and 14-18 October 2024", ("2024-10-14", "2024-10-18")),
    ("no dates", None), (None, None),
])
def test_date_ranges(value, line, want):
    found = value(dates.parse_meeting_date_range(F.lit(line).cast("string")))
    assert (found and tuple(map(str, found))) == want


def test_natural_order(spark):
    names = ["draft v10", "draft v9", "Draft v9a", "2 x", "10 x"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n")))
    assert [r["n"] for r in rows.collect()] == ["2 x", "10 x", "draft v9", "Draft v9a", "draft v10"]


