"""Versioned tables, the content store and pages by key."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docketlens.operators import search, versions
from docketlens.sources import store


@pytest.fixture()
def built(spark, tmp_path):
    root = str(tmp_path / "table")
    for version, n in (("2024", 3), ("2025", 5)):
        versions.write_version(spark.range(n), root, version)
    return root


def test_only_validated_versions_become_active(spark, built):
    with pytest.raises(ValueError):
        versions.read_version(spark, built)
    with pytest.raises(ValueError):
        versions.activate(spark, built, "2024")
    with pytest.raises(ValueError):
        versions.activate(spark, built, "none")
    assert versions.record_validation(spark, built, "2024", spark.range(0))
    assert not versions.record_validation(spark, built, "2025", spark.range(1))
    versions.activate(spark, built, "2024")
    with pytest.raises(ValueError):
        versions.activate(spark, built, "2025")
    assert versions.read_version(spark, built).count() == 3
    assert {r["version"]: r["state"] for r in versions.states(spark, built).collect()} == {"2024": "active", "2025": "failed"}


def test_activation_supersedes_and_an_active_version_stays(spark, built):
    for version in ("2024", "2025"):
        versions.record_validation(spark, built, version, spark.range(0))
        versions.activate(spark, built, version)
        versions.activate(spark, built, version)
    assert {r["version"]: r["state"] for r in versions.states(spark, built).collect()} == {"2024": "superseded", "2025": "active"}
    with pytest.raises(ValueError):
        versions.write_version(spark.range(1), built, "2025")
    versions.write_version(spark.range(9), built, "2024")
    assert versions.read_version(spark, built).count() == 5 and versions.read_version(spark, built, "2024").count() == 9


def test_a_killed_activation_leaves_the_old_version(spark, built, monkeypatch):
    for version in ("2024", "2025"):
        versions.record_validation(spark, built, version, spark.range(0))
    versions.activate(spark, built, "2024")
    monkeypatch.setattr(versions, "_record", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        versions.activate(spark, built, "2025")
    assert versions.active_version(spark, built) == "2024" and versions.read_version(spark, built).count() == 3


def test_reading_prunes_to_the_version(spark, built):
    versions.record_validation(spark, built, "2025", spark.range(0))
    versions.activate(spark, built, "2025")
    rows = versions.read_version(spark, built)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan and len(rows.inputFiles()) > 0
    assert {r["version"] for r in rows.collect()} == {"2025"} and dict(rows.dtypes)["version"] == "string"


def test_store_keeps_every_content_once(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [(b"a",), (b"b",), (b"a",), (b"",), (None,)]
    contents = spark.createDataFrame(rows, "content binary")
    assert store.put(contents, root) == 3 and store.put(contents, root) == 0
    assert store.put(spark.createDataFrame([(b"c",), (b"a",)], "content binary"), root) == 1
    found = {r["sha256"]: (bytes(r["content"]), r["size"], r["prefix"]) for r in store.stored(spark, root).collect()}
    assert found == {hashlib.sha256(c).hexdigest(): (c, len(c), hashlib.sha256(c).hexdigest()[:2]) for c in (b"a", b"b", b"c", b"")}


def test_checks_recompute_digests(spark, tmp_path):
    root, sha = str(tmp_path / "store"), lambda c: hashlib.sha256(c).hexdigest()
    store.put(spark.createDataFrame([(b"good",)], "content binary"), root)
    forged = [(sha(b"named"), 5, bytearray(b"other"), sha(b"named")[:2])]
    spark.createDataFrame(forged, "sha256 string, size long, content binary, prefix string").write.mode("append").partitionBy("prefix").parquet(root)
    manifest = spark.createDataFrame(
        [("1", sha(b"good"), 4), ("2", sha(b"good"), 7), ("3", sha(b"named"), 5), ("4", sha(b"absent"), 1)], "key string, sha256 string, size int"
    )
    found = {r["key"]: r["problem"] for r in store.checked(spark, root, manifest).collect()}
    assert found == {"1": None, "2": "size", "3": "digest", "4": "missing"}


def test_files_and_keys(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "one.bin").write_bytes(b"\x00\x01")
    (tmp_path / "in" / "deep" / "two.bin").write_bytes(b"2")
    found = store.files(spark, str(tmp_path / "in")).withColumn("key", store.object_key(F.col("sha256"), F.col("name")))
    assert {r["name"]: (r["size"], r["key"]) for r in found.collect()} == {
        n: (len(c), f"sha256/{hashlib.sha256(c).hexdigest()[:2]}/{hashlib.sha256(c).hexdigest()}/{n}")
        for n, c in (("one.bin", b"\x00\x01"), ("two.bin", b"2"))
    }


@pytest.mark.parametrize("order", [[("day", True), ("id", False)], [("day", False), ("kind", True), ("id", True)]])
def test_pages_joined_are_the_sorted_table(spark, order):
    rows = [(i, None if i % 5 == 0 else i % 4, None if i % 3 == 0 else "xyz"[i % 3]) for i in range(53)]
    frame = spark.createDataFrame(rows, "id int, day int, kind string")
    keys = [F.desc_nulls_last(n) if down else F.asc_nulls_last(n) for n, down in order]
    expected = [r["id"] for r in frame.orderBy(*keys).collect()]
    found, last = [], None
    while True:
        page = search.keyset_page(frame, order, 10, last).orderBy(*keys).collect()
        found += [r["id"] for r in page]
        if not page or not page[0]["has_more"]:
            break
        last = page[-1].asDict()
    assert found == expected
