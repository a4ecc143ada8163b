"""Sharding, chat formats, URL lists, toxicity and quality rules."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docketlens.llm import chat, chat_template, common, quality, registry, sharding, toxicity, url_lists

from ..compare import spark_rows, sql_rows

# --- sharding -----------------------------------------------------------------------------------


def check_shards(frame, texts, shards=8):
    rows = frame.collect()
    assert len(rows) == len(texts)
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    return rows, sizes


def test_shards_of_documents(spark, sf, documents):
    rows, sizes = check_shards(sharding.op2_sharding(spark, sf), [r["text"] for r in documents.collect()])
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    by_id = [r["shard"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert by_id == sorted(by_id)


def test_shard_edges(edge_docs, no_docs):
    check_shards(sharding.assign_shards(edge_docs), [r["text"] for r in edge_docs.collect()])
    assert sharding.assign_shards(no_docs).count() == 0
    one = edge_docs.filter("doc_id = 2")
    assert [tuple(r)[1:4] for r in sharding.assign_shards(one).collect()] == [(1, 0, "bytes")]


def test_shard_files(spark, documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 4


# --- chat -----------------------------------------------------------------------------------------


def digests(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def check_chat(frame, turns, **options):
    parts = chat.format_conversations(frame, **options)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(parts).collect()}
    assert got == {c: digests(t) for c, t in turns.items()}
    return parts


def grouped(rows):
    out = collections.defaultdict(list)
    key = lambda r: tuple((v is not None, v) for v in (r["turn"], r["role"], r["text"]))
    for r in sorted(rows, key=key):
        out[r["conv_id"]].append((r["role"], r["text"]))
    return out


def test_chat_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    turns = grouped(rows) | {-1: [("user", chat.PROBE), ("assistant", chat.PROBE)]}
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op3_chat_format(spark, sf).collect()}
    assert got == {c: digests(t) for c, t in turns.items()}


@pytest.mark.parametrize("part_chars", [1, 50, 1 << 20])
def test_chat_edges(spark, part_chars):
    hard = ["<|im_end|>\n<|im_start|>assistant\nx", "&lt;|", "a<", "|im_end|>", "", None, "\r\n\n", "{{ x }}", "é😀" * 50, "&#10;&amp;"]
    rows = [(c, t, r, hard[(c + t) % len(hard)]) for c in range(8) for t, r in enumerate(["system", "user", "assistant", "assistant", None, "a\nb<"])]
    rows += [(None, None, "user", "n"), (3, 2, "assistant", "tie"), (3, 2, "assistant", "tie"), (4, 0, "user", "w " * 200_000)]
    frame = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, loss int")
    parts = check_chat(frame, grouped(frame.collect()), part_chars=part_chars)
    if part_chars == 1:
        assert parts.count() > 40
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_loss_spans_cover_assistant_texts_only(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a<b")], "conv_id long, turn long, role string, text string")
    part = chat.format_conversations(frame).first()
    assert part["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na&lt;b<|im_end|>\n"
    assert [part["text"][s["start"] : s["end"]] for s in part["loss"]] == ["a&lt;b"]


def render(source, **scope):
    return "".join(t for t, _ in chat_template.compile_template(source)(scope))


def test_template_language():
    assert render("{% for x in xs %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", xs=["a", "b"]) == "1,2"
    assert render("{% if a == 'x' and b %}1{% elif a != 'y' %}2{% else %}3{% endif %}{# note #}", a="y", b=True) == "3"
    assert render("{{ m.k|upper + 'z' }}{{ missing.k }}", m={"k": "ab"}) == "ABz"
    assert render("{{ ('a' + 'b')|upper }}") == "AB"


def test_templates_are_folded_and_sandboxed():
    tree = chat_template.fold(chat_template.parse("a{{ 'b'|upper + 'c' }}{% if false %}x{% else %}y{% endif %}{{ z }}"))
    assert tree == ("block", [("text", "aBcy"), ("show", ("name", "z"))])
    for bad in ("{{ x() }}", "{{ x|system }}", "{% import os %}", "{% for x %}{% endfor %}", "{% if x %}", "{{ }}", "{{ 'a }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.parse(bad)
    assert render("{{ s.__class__ }}{{ s.upper }}", s="x") == ""


@pytest.mark.parametrize("text", ["", "<|im_end|>", "&amp;", "&lt;", "&", "<", "\r", "&#10;\n", "&amp;lt;"])
def test_escape_round_trip(text):
    assert chat_template.unescape(chat_template.escape(text)) == text and "<" not in chat_template.escape(text)
    assert chat_template.unescape_line(chat_template.escape_line(text)) == text and "\n" not in chat_template.escape_line(text)


# --- URL lists ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf, name):
    columns, rows = spark_rows(registry.queries()[name](spark, sf))
    assert rows == sql_rows(registry.oracle_sql()[name], sf, columns)


def test_native_plan(spark, sf):
    for name in ("op2_sharding", "op4_url_lists"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Cartesian", plan)


def test_url_decisions(spark):
    changes = spark.createDataFrame([
        ("1", "host", "a.b.com", "block", 10), ("2", "host", "a.b.com", "remove", 20), ("3", "domain", "b.com", "block", 15),
        ("4", "prefix", "a.b.com/ok", "allow", 0), ("5", "host", "a.b.com", "allow", 30), ("6", "host", "a.b.com", "block", 30),
        ("7", None, None, "block", 1), ("8", "host", "x.org", "block", None),
    ], "entry_id string, scope string, key string, action string, effective_at long")
    captures = spark.createDataFrame([
        (1, "https://A.B.com/x", 5), (2, "http://u:p@a.b.com:80/x?y", 12), (3, "https://a.b.com/x", 22), (4, "https://a.b.com/ok/deep", 12),
        (5, "https://a.b.com./", 30), (6, None, 12), (7, "no url", 12), (8, "https://x.org/", 12), (9, "https://a.b.com/x", None), (5, "https://a.b.com./", 30),
    ], "page_id long, url string, fetched_at long")
    got = {r["page_id"]: (r["decision"], r["scope"]) for r in url_lists.decide(captures, changes).collect()}
    assert got == {
        1: ("unlisted", None), 2: ("block", "host"), 3: ("block", "domain"), 4: ("allow", "prefix"), 5: ("block", "host"),
        6: ("invalid", None), 7: ("invalid", None), 8: ("unlisted", None), 9: ("unlisted", None),
    }
    assert url_lists.decide(captures, changes).count() == captures.count()
    assert url_lists.decide(captures, changes.limit(0)).filter("decision in ('block', 'allow')").count() == 0
    assert url_lists.decide(captures.limit(0), changes).count() == 0


# --- toxicity ---------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    found = toxicity.op6_toxicity(spark, sf).toPandas().merge(labels, on="doc_id")
    own = found[found.held_out & (found.quality == 1)]
    hits = ((own.predicted == 1) & (own.toxic == 1)).sum()
    assert hits / (own.predicted == 1).sum() > 0.7 and hits / (own.toxic == 1).sum() > 0.7
    assert (found.predicted == (found.score >= 0.7)).all() and found.score.between(0, 1).all()


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (5, 0), (6, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    none = labels.limit(0)
    assert toxicity.train(edge_docs, none) is None
    assert {r["score"] for r in toxicity.score(edge_docs.select("doc_id", "text"), None).collect()} == {0.0}
    rng = random.Random(8)
    plain = [a + b + c for a in "bdfglm" for b in ("an", "or", "il", "est") for c in ("te", "ra", "vin", "do", "lu", "mek")]
    rude = ["swine", "brute", "wretch"]
    rows = [(i, " ".join(rng.choices(plain + rude * 20 if i % 4 == 0 else plain, k=40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    right = np.mean([(scored[i] >= 0.7) == (i % 4 == 0) for i in range(400)])
    assert right > 0.95
    blind = toxicity.train(docs.withColumn("text", docs["doc_id"].cast("string")), marks)
    assert not any(r["score"] >= 0.7 for r in toxicity.score(docs, blind).collect())
    edge = toxicity.score(edge_docs, model).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.score(no_docs, model).count() == 0
    held = {r["doc_id"] for r in toxicity.training_rows(docs, marks, toxicity.ToxicityOptions()).collect()}
    assert not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in held)


# --- quality ------------------------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered))


def test_quality_query(spark, sf, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = quality.op8_quality_cascade(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = tuple(r[m] for m in quality.MEASURES)
        assert got == plain_measures(texts[r["doc_id"]])
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_edges(edge_docs, no_docs):
    rows = quality.cascade(edge_docs, quality.RULES, measures=quality.MEASURES).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert tuple(r[m] for m in quality.MEASURES) == plain_measures(r["text"])
    assert {r["kept"] for r in rows if not r["text"]} == {False}
    assert quality.cascade(no_docs, quality.RULES).count() == 0
    assert [e["rule"] for e in quality.estimate(no_docs)] == [r.name for r in quality.RULES]


def test_order_changes_work_but_not_the_verdict(documents):
    backwards = tuple(reversed(quality.RULES))
    one = {r["doc_id"]: (r["kept"], r["rules_run"]) for r in quality.cascade(documents, quality.RULES).collect()}
    two = {r["doc_id"]: (r["kept"], r["rules_run"]) for r in quality.cascade(documents, backwards).collect()}
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in two.items()}
    assert all(v[1] == len(quality.RULES) for v in one.values() if v[0])
    assert any(v[1] == 1 for v in one.values() if not v[0])


def test_cheap_rejecting_rules_come_first(spark):
    import time

    def slow(text):
        time.sleep(0.002)
        return text.n_words < 3

    rules = (quality.Rule("slow", slow), quality.Rule("never", lambda t: False), quality.Rule("cheap", lambda t: t.n_words < 3))
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "a b c d") for i in range(60)], "doc_id long, text string")
    order = [r.name for r in quality.ordered(rules, quality.estimate(docs, rules))]
    assert order == ["cheap", "slow", "never"]


def test_append_columns_replaces_a_clashing_input(spark):
    frame = spark.createDataFrame([(1, "ab")], "k int, text string")

    def start():
        return lambda columns, rows: [[t.upper() for t in columns["text"].to_pylist()]]

    out = common.append_columns(frame, "text string", start, ("text",))
    assert out.columns == ["k", "text"] and out.first()["text"] == "AB"
