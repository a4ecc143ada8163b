import pytest
from pyspark.sql import functions as F

from docketlens.llm import decontaminate

ITEM = ("a train leaves the station at 9 and travels 120 km towards Berlin while the second train "
        "leaves at 11 and meets it after 90 km")


def found(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.contamination(docs, bench).collect()}


def test_exact_and_reparameterised(spark):
    other = ITEM.replace("9", "7", 1).replace("120", "250").replace("Berlin", "Paris").replace("km", "miles")
    mixed = ITEM.replace("120 km", "120 km", 1)
    got = found(spark, [f"Before this. {ITEM}. And after it.", f"Now {other} indeed", mixed, "nothing of the kind here"])
    assert got[0, 0]["kind"] == "exact" and got[0, 0]["coverage"] > 0.9
    assert got[1, 0]["kind"] == "reparameterised"
    assert got[2, 0]["kind"] == "exact" and (3, 0) not in got


def test_items_without_template_windows(spark):
    names = "Anna Berta Carl Dora Emil Fritz Gerda Hans Ida Jan"
    items = ["Who wrote Hamlet?", "What is 12 + 30?", "Ist Berlin die Hauptstadt Deutschlands?", names]
    got = found(spark, [f"He asked: {i} And so on." for i in items] + ["Who wrote Faust? What is 12 + 31?"], items)
    assert set(got) == {(i, i) for i in range(len(items))}
    assert all(r["kind"] == "exact" and r["coverage"] == 1 for r in got.values())


def test_items_of_one_window(spark):
    items = ["Who painted the Mona Lisa?", "please name the largest planet"]
    texts = ["Question 3\nWho painted the Mona Lisa?", "then asked Who painted the Mona Lisa? again",
             "Question 3\nWho painted the Sixtine Madonna?", "Please name the\nlargest planet"]
    got = found(spark, texts, items)
    assert {k: r["kind"] for k, r in got.items()} == {
        (0, 0): "exact", (1, 0): "exact", (2, 0): "reparameterised", (3, 1): "exact"}


def test_wrapped_lines_keep_their_names(spark):
    item = "we walked with Tom and Jane along the river towards Paris"
    got = found(spark, [item.replace(" Tom", "\nTom").replace(" Paris", "\nParis")], [item])
    assert got[0, 0]["coverage"] == 1


def test_inconsistent_slots_do_not_count(spark):
    item = "take 3 apples and 3 pears then add 3 plums and 3 figs to the wooden bowl on table 3 now please"
    same = item.replace("3", "8")
    broken = "take 8 apples and 9 pears then add 7 plums and 6 figs to the wooden bowl on table 5 now please"
    got = found(spark, [same, broken], [item])
    assert got[0, 0]["kind"] == "reparameterised" and (1, 0) not in got


COUNTED = ("Tom has 3 red and 3 blue pens in the left drawer of a large desk near the window and gives 2 of "
           "them to a friend who keeps 5 others in an old box under the bed, so how many are left")


def test_one_changed_value_drops_only_its_windows(spark):
    docs = [COUNTED.replace("3 blue", "4 blue"), COUNTED.replace("3 red and 3", "8 red and 9")]
    got = found(spark, docs, [COUNTED])
    assert set(got) == {(0, 0), (1, 0)}
    windows = got[0, 0]["item_windows"]
    # The pair (3, 4) stands in five windows, those of (3, 3) alone count.
    assert got[0, 0]["matched_windows"] == windows - 5 and got[0, 0]["kind"] == "reparameterised"
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, COUNTED)], "item_id long, text string")
    assert decontaminate.uncontaminated(frame, bench).count() == 0


def test_values_that_become_equal(spark):
    short = "Tom has 2 apples and 5 pears. How many fruits does Tom have in total?"
    same = [i.replace("2 ", "4 ").replace("5 ", "4 ") for i in (COUNTED, short)]
    got = found(spark, same, [COUNTED, short])
    assert {k: (r["kind"], r["coverage"]) for k, r in got.items()} == {
        (0, 0): ("reparameterised", 1), (1, 1): ("reparameterised", 1)}


def test_casing_and_punctuation(spark):
    shouted = " ".join(w.upper() + "!!" for w in ITEM.split())
    marked = " ".join(w + "###" for w in ITEM.split())
    got = found(spark, [shouted, marked])
    assert (1, 0) in got


def test_planted_leaks_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op1_decontamination(spark, sf).collect()}
    want = {(d.doc_id, i.item_id) for d in docs.itertuples() for i in items.itertuples() if d.text and i.text in d.text}
    assert want and want <= got
    # Whatever else is reported shares most of its five-word runs with the item.
    runs = lambda t: {tuple(x.strip('.,').lower() for x in t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    texts, asked = docs.set_index("doc_id").text, items.set_index("item_id").text
    for d, i in got - want:
        assert len(runs(texts[d]) & runs(asked[i])) > 0.4 * len(runs(asked[i]))


@pytest.mark.parametrize("window", [5, 8])
def test_short_items_and_edges(spark, edge_docs, no_docs, window):
    options = decontaminate.TemplateOptions(window=window)
    items = spark.createDataFrame(
        [(1, "der die das und"), (2, None), (3, ""), (4, "a"), (None, "words here are plain")], "item_id long, text string"
    )
    rows = decontaminate.contamination(edge_docs.select("doc_id", "text"), items, options).collect()
    # Four words are one window of their own; a sentence start is no name, so the item matches inside.
    assert all(r["coverage"] >= 0.5 for r in rows)
    assert not any(r["item_id"] in (2, 3, 4) for r in rows)
    assert decontaminate.contamination(no_docs.select("doc_id", "text"), items, options).count() == 0
    assert decontaminate.contamination(edge_docs.select("doc_id", "text"), items.limit(0), options).count() == 0


def test_filter(spark, sf, edge_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    kept = decontaminate.uncontaminated(docs, items)
    assert kept.columns == docs.columns
    hit = decontaminate.op1_decontamination(spark, sf).select("doc_id").distinct().count()
    assert kept.count() == docs.count() - hit
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.uncontaminated(edge_docs, none).count() == edge_docs.count()
    assert decontaminate.uncontaminated(edge_docs.filter(F.lit(False)), items).count() == 0


@pytest.mark.parametrize("key", [None, 7])
def test_rows_that_share_an_id_are_judged_alone(spark, key):
    words = ITEM.split()
    clean, halves = "nothing of the kind stands here at all", [" ".join(words[:14]), " ".join(words[14:])]
    rows = [(key, t) for t in (ITEM, clean, *halves)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    options = decontaminate.TemplateOptions(min_coverage=0.6)
    assert decontaminate.contamination(docs, bench, options).count() == 1
    kept = decontaminate.uncontaminated(docs, bench, options)
    assert sorted(r["text"] for r in kept.collect()) == sorted([clean, *halves])


def reported(spark, docs, items):
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    return {(r["doc_id"], r["item_id"]): (r["coverage"], r["kind"]) for r in found.collect()}


def test_a_generic_window_is_no_copy(spark):
    """Of an item of few windows all must match."""
    docs = [(1, "We asked what is the capital of the firm that sold it."), (2, "so what is the capital of France? nobody knew")]
    assert set(reported(spark, docs, [(7, "What is the capital of France?")])) == {(2, 7)}


def test_items_that_share_an_id_or_have_none(spark):
    """Each is judged by its own windows."""
    short = "the green river bends slowly past nine old wooden mills near town"
    long = "a quite different text about copper kettles and silver spoons kept under lock by careful keepers of long memory"
    docs = [(1, f"See: {short} indeed."), (2, f"And {long} again.")]
    for key in (5, None):
        found = reported(spark, docs, [(key, short), (key, long)])
        assert set(found) == {(1, key), (2, key)} and all(c >= 0.8 for c, _ in found.values())
