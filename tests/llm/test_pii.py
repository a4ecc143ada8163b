import hashlib
import random
import re

import pytest

from docketlens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def base_of(row):
    return [(s["kind"], s["start"], s["end"]) for s in row["spans"] if s["is_base"]]


def random_texts(n):
    rng = random.Random(11)
    parts = ["a@b.co", "+1 (743) 555-3824", "4111 1111 1111 1111", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "@", "+", ".", " ",
             "-", "x", "é", "😀", "a@b.c%x@y.z", "a@b.c.", "@@", "+49..", "(", ")", "0000000000000000", "12-34", "\n", "9" * 30]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(n)]


def test_base_spans_on_random_texts(spark):
    docs = pii.numbered(spark.createDataFrame(list(enumerate(random_texts(400))), "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in pii.spans(docs).collect():
        assert base_of(row) == plain_base(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op9_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r["doc_id"]])
        digest = hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in base).encode()).hexdigest()
        assert r["base_sha256"] == digest
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(b[0] == k for b in base) for k in PATTERNS]
        assert {f"{k}:{a}:{z}" for k, a, z in base} <= set(r["spans"].split(","))


def test_no_python_in_the_plan(spark, sf):
    plan = pii.op9_pii(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_edges(edge_docs, no_docs):
    docs = pii.numbered(edge_docs.drop("row_id").select("doc_id", "text"))
    rows = pii.spans(docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(by_id[5]["spans"]) == 12_000 and len(by_id[10]["spans"]) == 3000 and by_id[2]["spans"] == []
    assert pii.spans(pii.numbered(no_docs.drop("row_id").select("doc_id", "text"))).count() == 0


def test_added_spans_and_redaction(spark):
    lines = [
        "Call me: 743-555-3824 or mail joe@site.org today", "Dear Mr. Smith Miller, your ssn 123-45-6789 is safe",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" kept', "nothing personal, version 1.2.3 on page 7",
        None, "",
    ] * 20
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(lines)], "doc_id long, text string, n_chars long")
    kinds = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in pii.spans(pii.numbered(docs)).collect()}
    assert "email" in kinds[0] and kinds[3] == set() and kinds[4] == set()
    assert "secret" in kinds[2]
    clean = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert "joe@site.org" not in clean[0]["text"] and "<EMAIL>" in clean[0]["text"]
    assert clean[3]["text"] == lines[3] and clean[4]["text"] is None and clean[5]["text"] == ""
    assert all(r["n_chars"] == len(r["text"] or "") for r in clean.values())
    assert pii.redacted(docs).columns == docs.columns


def test_redaction_against_plain_code(spark):
    texts = random_texts(200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.spans(pii.numbered(docs)).collect()}
    for r in pii.redacted(docs).collect():
        source, out, at = texts[r["doc_id"]], "", 0
        for s in sorted(spans[r["doc_id"]], key=lambda s: (s["start"], s["end"], s["kind"])):
            if s["start"] >= at:
                out += source[at : s["start"]] + f"<{s['kind'].upper()}>"
            at = max(at, s["end"])
        assert r["text"] == out + source[at:]


def test_redaction_of_a_long_text(spark):
    import time

    line = "é😀 mail a@b.co or +1 (743) 555-3824, "
    text = line * 20_000 + "tail"
    docs = spark.createDataFrame([(1, text), (2, "x" * 5000 + " 10.0.0.1")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert got[1] == "é😀 mail <EMAIL> or <PHONE>, " * 20_000 + "tail"
    assert got[2] == "x" * 5000 + " <IP>"
    assert time.time() - began < 60


def test_estimation_prefers_agreeing_voters():
    rows = [
        {"kind": "x", "n": 80, "regex": 1, "gazetteer": 1, "context": 1, "boundary": 1},
        {"kind": "x", "n": 80, "regex": -1, "gazetteer": -1, "context": 0, "boundary": -1},
        {"kind": "x", "n": 5, "regex": 1, "gazetteer": 1, "context": -1, "boundary": 1},
    ]
    fitted = pii.estimate(rows)
    assert fitted["posterior"][0] > 0.9 > 0.1 > fitted["posterior"][1]
    assert fitted["reliability"]["regex"] > fitted["reliability"]["context"]
    assert pii.estimate([])["posterior"] == []


@pytest.mark.parametrize("name", ["email", "ip", "card"])
def test_long_runs_do_not_explode(spark, name):
    run = {"email": "a" * 300_000, "ip": "1" * 300_000, "card": "1 " * 150_000}[name]
    docs = pii.numbered(spark.createDataFrame([(1, run + "@"), (2, "a." * 50_000 + "@b" + ".c" * 50_000)], "doc_id long, text string"))
    rows = {r["doc_id"]: base_of(r) for r in pii.spans(docs).collect()}
    assert rows[1] == [] and rows[2] == [("email", 0, 200_002)]
