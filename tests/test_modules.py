"""Order, isolation and reruns of modules; trees and searches without depth limits; lines at the ends of pages."""

import numpy as np

from quern.operators import enrich, pages, retrieval


def test_modules_run_in_order():
    ran = []
    modules = {m: (lambda m=m: ran.append(m)) for m in ["community", "vector", "disambiguation", "graph_extract", "own", "text"]}
    found = enrich.run_modules(modules)
    assert set(found.values()) == {(enrich.DONE, "")} and set(found) == set(modules)
    assert set(ran[:2]) == {"vector", "text"} and ran.index("graph_extract") < ran.index("disambiguation") < ran.index("community")


def test_failures_stay_with_what_depends_on_them():
    def fail():
        raise KeyError("x")

    ran = []
    modules = {"graph_extract": fail, **{m: (lambda m=m: ran.append(m)) for m in ["disambiguation", "community", "wiki"]}}
    found = enrich.run_modules(modules)
    assert found["graph_extract"] == (enrich.FAILED, "KeyError: 'x'")
    assert found["disambiguation"] == (enrich.SKIPPED, "graph_extract") and found["community"] == (enrich.SKIPPED, "disambiguation")
    assert ran == ["wiki"] and found["wiki"] == (enrich.DONE, "")
    assert enrich.run_modules(modules, only={"community"}) == {"community": (enrich.DONE, "")}


def test_deep_trees_are_searched_to_their_leaves(spark):
    depth = 16
    nodes = [(f"n{k}", k, [1.0, 0.0], [f"n{k - 1}"] if k > 1 else [], [7]) for k in range(1, depth + 1)]
    t = spark.createDataFrame(nodes, "node_id string, layer int, embedding array<double>, children array<string>, chunks array<int>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    (hit,) = retrieval.tree_search(t, q).collect()
    assert hit.chunk_id == 7 and hit.path == [f"n{k}" for k in range(depth, 0, -1)]
    (hit,) = retrieval.tree_search(t, q, max_depth=3).collect()
    assert hit.path == ["n16", "n15", "n14"]


def test_trees_end_in_small_roots(spark):
    r = np.random.default_rng(4)
    rows = [("g", i, [float(x) for x in r.normal(0, 1, 4)]) for i in range(300)]
    nodes = enrich.summary_tree(spark.createDataFrame(rows, "doc_id string, chunk_id long, embedding array<double>"), fan_out=3).collect()
    top = max(n.layer for n in nodes)
    (root,) = [n for n in nodes if n.layer == top]
    assert len(root.children or root.chunks) <= 300 and sorted(root.chunks) == list(range(300))


def test_lines_at_the_ends_of_pages(spark):
    rows = [(1, 1, "\nHead\nHead\ntext\nFoot\n"), (1, 2, "text\nHead\ntext"), (1, 3, "Head"), (2, 1, "Head\nx"), (1, 4, None), (1, 5, "")]
    p = spark.createDataFrame(rows, "doc_id long, page long, text string")
    gone = spark.createDataFrame([(1, "Head"), (1, "Foot")], "doc_id long, line string")
    got = {(r.doc_id, r.page): r.text for r in pages.without_lines(p, gone, "doc_id").collect()}
    assert got == {(1, 1): "\nHead\ntext\n", (1, 2): "text\nHead\ntext", (1, 3): "", (2, 1): "Head\nx", (1, 4): got[1, 4], (1, 5): ""}
