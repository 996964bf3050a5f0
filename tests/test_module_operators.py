"""Trees as JSON, gleaning, reranking by a model, figures, icons and workbooks of questions, on small cases."""

import io
import json
import struct
import unicodedata
import zipfile

import pytest
import xxhash
from pyspark.sql import functions as F

from quern.functions import clean
from quern.operators import enrich, graph, pages, seams
from quern.sources import faq


def test_figure_lines(spark):
    prose = "This paragraph of the text has more than eight words in it, and goes on"
    docs = [
        ["12", "Input", "0 1 2 3", "Figure 3 shows it", "Label"],
        [prose, "Input", "", "Input", "Figure 1"],
        ["A label", "see Figure 2", "Figure 2"],
        ["Ends as a sentence.", "x", "figure 9"],
        [None, "x", "Figure 1"],
        ["x"],
    ]
    rows = [(i, j, x) for i, d in enumerate(docs) for j, x in enumerate(d)]
    kept: dict = {i: [] for i in range(len(docs))}
    for r in pages.without_figure_lines(spark.createDataFrame(rows, "doc_id int, line_no int, line string")).orderBy("doc_id", "line_no").collect():
        kept[r.doc_id].append(r.line)
    assert kept == {0: ["Figure 3 shows it", "Label"], 1: [prose, "Input", "", "Figure 1"], 2: ["Figure 2"], 3: ["Ends as a sentence.", "figure 9"], 4: [None, "Figure 1"], 5: ["x"]}


def test_icons(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 300, 20) + b"\0" * 9
    gif = b"GIF89a" + struct.pack("<HH", 16, 40) + b"\0" * 700
    rows = [(0, png), (1, gif), (2, b"x" * 511), (3, b"x" * 512), (4, b""), (5, None)]
    w, h = pages.image_size(F.col("c"))
    got = spark.createDataFrame(rows, "i int, c binary").select("i", w.alias("w"), h.alias("h"), pages.is_icon(w, h, F.octet_length("c")).alias("icon"))
    assert [tuple(r) for r in got.orderBy("i").collect()] == [(0, 300, 20, False), (1, 16, 40, True), (2, None, None, True), (3, None, None, False), (4, None, None, True), (5, None, None, None)]


def test_nested_trees(spark):
    rows = [(1, "r", "t", "d", ["a", "gone", "b"], None), (1, "a", "ta", "da", None, [5, 6, 5]), (1, "b", None, "db", [], []), (2, "x", "x", "", None, [1]), (2, "y", "y", "", None, None)]
    nodes = spark.createDataFrame(rows, "doc_id int, node_id string, title string, description string, children array<string>, chunks array<int>")
    got = {r.doc_id: json.loads(r.tree) for r in enrich.nested_trees(nodes).collect()}
    leaf = lambda t, d, ids: {"source_chunk_ids": ids, "title": t, "description": d}
    assert got[1] == {"children": [leaf("ta", "da", ["5", "6"]), leaf(None, "db", [])], "title": "t", "description": "d"}
    assert got[2] == {"title": "(root)", "children": [leaf("x", "", ["1"]), leaf("y", "", [])]}
    assert enrich.nested_trees(nodes.limit(0)).count() == 0


def test_tree_ids_and_kinds(spark):
    d = spark.createDataFrame([(7, "text"), (8, None)], "doc_id long, content string")
    assert {r.doc_id: r.chunk_id for r in enrich.tree_ids(d).collect()} == {7: xxhash.xxh64(b"text7").hexdigest(), 8: xxhash.xxh64(b"8").hexdigest()}
    kinds = spark.createDataFrame([(".XLSX", None), ("csv", None), ("pdf", "table"), (".pdf", "naive"), (None, "table"), ("md", None)], "s string, p string")
    assert [r[0] for r in kinds.select(enrich.skips_tree(F.col("s"), F.col("p"))).collect()] == [True, True, True, False, False, False]


@pytest.mark.parametrize(("answer", "want"), [([0.5, 0.25], [0.5, 0.25, 0.0]), ([{"index": 2, "score": 1}, {"index": 9, "score": 1}, {"index": 0}], [0.0, 0.0, 1.0]), ({"results": [1, 2, 3, 4]}, [1.0, 2.0, 3.0]), ({"x": [3]}, [3.0, 0.0, 0.0]), ({}, [0.0] * 3), ("no", [0.0] * 3)])
def test_model_scores(answer, want):
    assert seams.model_scores(answer, 3) == want


def test_rerank_scores(spark):
    rows = [(1, "q", "x" * n, 9.0) for n in range(1, 20)] + [(2, "", "abc", 9.0), (3, "z", None, 9.0), (4, "q2", "y" * 900, 9.0)]
    sizes = lambda q, texts: [float(len(t)) if len(texts) <= 8 else -1.0 for t in texts]
    got = seams.rerank_scores(spark.createDataFrame(rows, "query_id int, query string, content string, score double").coalesce(1), sizes).collect()
    assert sorted((r.query_id, r.score) for r in got) == sorted([(1, float(n)) for n in range(1, 20)] + [(2, 0.0), (3, 0.0), (4, 768.0)])


def test_gleaning(spark):
    def model(text, known):
        if text == "bad":
            raise ValueError
        if text == "list":
            return []
        more = {0: ["A", {"name": "B", "type": "t"}], 2: ["A", "C", 5, {"name": ""}], 3: ["D"], 4: ["E"]}[len(known)]
        return {"entities": more, "relations": [{"source": "A", "target": "B", "type": "r", "weight": len(known)}, {"source": "A"}, "x"]}

    rows = [(1, "some"), (2, "bad"), (3, "list"), (4, None), (5, "")]
    got = {r.chunk_id: ([e.name for e in r.entities], [(x.source, x.target, x.weight) for x in r.relations]) for r in seams.glean(spark.createDataFrame(rows, "chunk_id long, content string"), model).collect()}
    assert got == {1: (["A", "B", "C", "D"], [("A", "B", 1.0)]), 2: ([], []), 3: ([], []), 4: ([], []), 5: ([], [])}


def test_communities_without_a_graph(spark):
    r = spark.createDataFrame([("a", "x", "y", 1.0)], "kb_id string, source string, target string, weight double")
    e = spark.createDataFrame([("a", "x")], "kb_id string, name string")
    c = spark.createDataFrame([("a", 1), ("b", 2)], "kb_id string, chunk_id long")
    found = graph.relations_or_chunks(r, e, c, lambda bare: bare.select("kb_id", F.lit("p").alias("source"), F.lit("q").alias("target"), F.lit(2.0).alias("weight")))
    assert sorted(map(tuple, found.collect())) == [("a", "x", "y", 1.0), ("b", "p", "q", 2.0)]


def test_further_tags_of_a_model(spark):
    rows = [(["a"], ["b", "zzz", "c", "a", "d", "e"]), (["a", "b", "c"], ["d"]), ([], None)]
    d = spark.createDataFrame(rows, "taken array<string>, choice array<string>").withColumn("tags", F.split(F.lit("a b c d e"), " "))
    assert [r[0] for r in d.select(enrich.further_tags(F.lit("x"), F.col("taken"), F.col("tags"), F.col("choice"))).collect()] == [["b", "c", "d"], [], []]


def test_unicode_of_plain_texts(spark):
    texts = [None, "", "plain", "café ÿ˿", "café", "Å", "가", "\U0001d15e", "a\nb̈́"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in d.orderBy("i").select(clean.normalize_unicode(F.col("t"))).collect()] == [t and unicodedata.normalize("NFC", t) for t in texts]


def test_workbook_of_questions(spark, tmp_path):
    cell = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    rows = [["问题", "答案", "相似问题"], ["How?", "So##Thus", "In what way?"], ["", "", ""], ["Why?", "", ""]]
    body = "".join(f'<row r="{i}">' + "".join(cell(f"{chr(65 + j)}{i}", t) for j, t in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    (tmp_path / "faq.xlsx").write_bytes(raw.getvalue())
    got = {r.standard_question: (r.answers, r.similar_questions, r.problem) for r in faq.read_xlsx(spark, str(tmp_path / "faq.xlsx")).collect()}
    assert got == {"How?": (["So", "Thus"], ["In what way?"], None), "Why?": ([], [], "no answer")}
