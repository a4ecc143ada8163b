"""Strong components, witness cycles and chain places against plain graph walks."""

import random

from pyspark.sql import functions as F

from docketlens.operators import cycles, graph
from docketlens.session import cut_lineage


def reach(links):
    after = {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
    found = {}
    for node in {x for link in links for x in link}:
        seen, queue = set(), [node]
        while queue:
            for b in after.get(queue.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
        found[node] = seen
    return found


def plain_components(links):
    seen = reach(links)
    return {a: min(b for b in bs if a in seen[b]) for a, bs in seen.items() if a in bs}


def plain_places(nodes, links):
    links = [(a, b) for a, b in links if b in nodes]
    seen = reach(links)
    lost = {a for a in nodes if a in seen.get(a, ()) or any(b in seen.get(b, ()) for b in seen.get(a, ()))}
    before = {n: [b for a, b in links if a == n] for n in nodes}

    def place(n):
        if not before[n]:
            return n, 1
        found = [place(p) for p in before[n]]
        return min(r for r, _ in found), 1 + max(d for _, d in found)

    return {n: (None, None, True) if n in lost else (*place(n), False) for n in nodes}


def chain(*names):
    return list(zip(names, names[1:]))


GRAPHS = {
    "two predecessors, one cyclic": [("a", "b"), ("a", "c"), ("c", "a")],
    "pair": [("x", "y"), ("y", "x")],
    "own": [("a", "a"), ("b", "a"), ("c", "b"), ("c", "c")],
    "long chain": chain(*[f"n{i:03}" for i in range(150)]),
    "long cycle with a tail in and out": chain(*[f"n{i:03}" for i in range(120)]) + [("n099", "n010")],
    "two cycles joined by a way": chain("a", "b", "c", "a") + chain("c", "d", "e", "f") + chain("f", "g", "h", "f"),
    "cycles sharing a node": chain("a", "b", "a") + chain("a", "c", "d", "a") + [("d", "b")],
    "ladder": [(f"{s}{i}", f"{t}{i + 1}") for i in range(4) for s in "ab" for t in "ab"],
    "none": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")],
}
for seed in range(3):
    rng = random.Random(seed)
    GRAPHS[f"random {seed}"] = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(75)]


def frame(spark, links):
    return spark.createDataFrame(links, "src string, dst string")


#: All graphs side by side, so that one run has them all.
TOGETHER = [(f"{k:02}/{a}", f"{k:02}/{b}") for k, links in enumerate(GRAPHS.values()) for a, b in links]


def test_components_and_witnesses(spark):
    found = cut_lineage(cycles.strong_components(frame(spark, TOGETHER + TOGETHER[:1])))
    components = {r["id"]: r["component"] for r in found.collect()}
    assert found.count() == len(components)
    assert components == plain_components(TOGETHER)
    shown = {}
    for r in cycles.witnesses(frame(spark, TOGETHER), found).orderBy("component", "position").collect():
        shown.setdefault(r["component"], []).append((r["position"], r["id"]))
    assert set(shown) == set(components.values())
    for component, members in shown.items():
        assert [p for p, _ in members] == list(range(len(members)))
        ids = [i for _, i in members]
        assert ids[0] == min(ids) and len(set(ids)) == len(ids)
        assert all(components[i] == component for i in ids)
        assert all((a, b) in TOGETHER for a, b in zip(ids, ids[1:] + ids[:1]))


def test_places(spark):
    nodes = {x for link in TOGETHER for x in link} | {"alone"}
    rows = [(n, None) for n in nodes] + TOGETHER + [("alone", "unknown")]
    found = graph.chain_places(spark.createDataFrame(rows, "id string, previous string")).collect()
    assert {r["id"]: (r["root"], r["depth"], r["is_cyclic"]) for r in found} == plain_places(nodes, TOGETHER)
    assert len(found) == len(nodes)


def test_null_and_empty(spark):
    assert cycles.strong_components(frame(spark, [("a", None), (None, "a")])).collect() == []
    none = frame(spark, [("a", "b")]).limit(0)
    assert cycles.strong_components(none).collect() == []
    assert cycles.witnesses(none, cycles.strong_components(none)).collect() == []


def test_a_cyclic_graph_is_not_valid(spark):
    nodes = spark.createDataFrame([("tdoc", x) for x in "xyz"], "type string, entity string")
    rows = [("1", "tdoc", "x", "revises", "tdoc", "y"), ("2", "tdoc", "y", "revises", "tdoc", "z")]
    schema = "id string, source_type string, source_id string, predicate string, target_type string, target_id string"
    sound = graph.validated(nodes, spark.createDataFrame(rows, schema)).first()
    assert (sound["cycles"], sound["faults"], sound["valid"]) == (0, 0, True)
    # The second predecessor of y closes the cycle.
    rows.append(("3", "tdoc", "y", "revises", "tdoc", "x"))
    circular = graph.validated(nodes, spark.createDataFrame(rows, schema)).first()
    assert (circular["cycles"], circular["faults"], circular["valid"]) == (1, 0, False)


def test_witnesses_of_the_query(spark, sf):
    from docketlens.plans import dataset_queries

    links = {(r["src"], r["dst"]) for r in dataset_queries.planted_links(spark, sf).collect()}
    found = dataset_queries.QUERIES["cycle_witnesses"](spark, sf)
    rows = found.orderBy("component", "position").collect()
    assert rows and found.select(F.count_distinct("component")).first()[0] == len(set(plain_components(list(links)).values()))
    by = {}
    for r in rows:
        by.setdefault(r["component"], []).append(r["id"])
    assert all((a, b) in links for ids in by.values() for a, b in zip(ids, ids[1:] + ids[:1]))
