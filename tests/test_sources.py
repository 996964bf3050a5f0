"""Parsers on files built here, question-and-answer files, and the stream."""

import email.mime.image
import email.mime.multipart
import email.mime.text
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.sources import faq, files


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


SHEET = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>b</t></is></c></row><row><c r="A3"><v>7</v></c><c r="B3"><f>DISPIMG("x")</f><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A3:A4"/></mergeCells></worksheet>'
XLSX = archive(xl__workbook_dot_xml='<workbook><sheets><sheet name="S"/></sheets></workbook>', xl__sharedStrings_dot_xml="<sst><si><t>hello</t></si></sst>", xl__worksheets__sheet1_dot_xml=SHEET)
W = 'xmlns:w="w"'
DOCX = archive(word__document_dot_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>', word__media__i_dot_png="png")
PPTX = archive(ppt__slides__slide1_dot_xml='<s xmlns:a="a"><a:p><a:r><a:t>first</a:t></a:r></a:p></s>', ppt__slides__slide2_dot_xml='<s xmlns:a="a"><a:p><a:r><a:t>second</a:t></a:r></a:p></s>')
EPUB = archive(O__c_dot_opf='<package><metadata><title>Book</title></metadata><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>', O__a_dot_xhtml="<p>last</p>", O__b_dot_xhtml='<h1>First</h1><img src="p.png"/>', O__p_dot_png="png")


def mhtml():
    m = email.mime.multipart.MIMEMultipart("related")
    m["Subject"] = "Page"
    for place, body in (("https://x.org/ads/frame", "<p>" + "ad " * 400 + "</p>"), ("https://x.org/a", '<p>main</p><img src="i.png">'), ("https://x.org/b", "<p>s</p>")):
        part = email.mime.text.MIMEText(body, "html")
        part["Content-Location"] = place
        m.attach(part)
    image = email.mime.image.MIMEImage(b"\x89PNG", "png")
    image["Content-Location"] = "https://x.org/i.png"
    m.attach(image)
    return m.as_bytes()


@pytest.mark.parametrize(
    ("name", "raw", "want"),
    [
        ("a.txt", "čau".encode(), "čau"),
        ("a.csv", "x;y\n1;\n;\n2;3\n".encode(), "x: 1\nx: 2,y: 3\n"),
        ("a.xlsx", XLSX, "A: hello,B: b\nA: 7\nA: 7\n"),
        ("a.docx", DOCX, "## Title\n\none\n\n| a | b |\n| --- | --- |\n| 1 |  |"),
        ("a.pptx", PPTX, "## Slide 1\n\nfirst\n\n## Slide 2\n\nsecond"),
        ("a.epub", EPUB, "# First\n\n![](images/p.png)\n\nlast"),
        ("a.mhtml", mhtml(), "main\n\n![](images/0.png)"),
        ("a.md", b"|a|b|\n|1|2|", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        ("a.png", b"x", "![a.png](images/a.png)"),
        ("a.html", b'<h1>T</h1><p>a <b>b</b> <a href="#x">c</a> <a href="https://d">e</a><ul><li>f</ul>', "# T\n\na **b** c [e](https://d)\n\n- f"),
        ("a.gbk.txt", "你好".encode("gbk"), "你好"),
    ],
)
def test_parsers(name, raw, want):
    assert files.find_parser(name.rsplit(".", 1)[1])(name, raw)["content"].strip() == want.strip()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.zzz").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"].error is None and got["a.docx"].images.keys() == {"images/i.png"}
    assert "BadZipFile" in got["b.docx"].error and "no parser" in got["c.zzz"].error


def test_chains():
    fails = lambda n, r: 1 / 0
    assert files.first_valid(fails, files.parse_text)("x", b"t")["content"] == "t"
    assert files.chained(files.parse_html, files.parse_markdown)("x", b"<table><tr><td>a</td></tr></table>")["content"].count("|") >= 4


def test_inline_images():
    text, images = files.lift_data_uris("![a](data:image/png;base64,aGk=) ![b](data:image/png;base64,aGk=)")
    assert text == "![a](images/inline-0.png) ![b](images/inline-0.png)" and list(images.values()) == [b"hi"]


def test_faq_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿问题;相似问题;答案\nq1;s1##q1 ; a1 ## a2##\n ; ;\nq2;;\n", encoding="utf-8")
    got = {r.standard_question: r for r in faq.read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got["q1"].answers == ["a1", "a2"] and got["q1"].similar_questions == ["s1", "q1"] and got["q1"].problem == "similar repeats the question"
    assert got["q2"].problem == "no answer" and set(got) == {"q1", "q2"}
    (tmp_path / "a.json").write_text(json.dumps([{"standard_question": "q", "answers": ["a"], "similar_questions": ["b"], "negative_questions": ["B"], "tags": ["t", "u"]}]))
    (row,) = faq.read_json(spark, str(tmp_path / "a.json")).collect()
    assert row.problem == "negative repeats a similar one" and row.category == "t,u" and row.answer_strategy == "all"


def test_stream_readmits_after_deletion(spark, tmp_path):
    from quern.streaming import ingest_stream, stored

    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "kb_id string, doc_id long, text string"
    run = lambda: ingest_stream(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("k", 1, "t"), ("k", 2, "t"), ("l", 3, "t")], schema).write.parquet(source)
    run()
    assert {(r.kb_id, r.doc_id) for r in stored(spark, store).collect()} == {("k", 1), ("l", 3)}
    held = stored(spark, store).withColumn("deleted", F.col("doc_id") == 1).toPandas()
    spark.createDataFrame(held).drop("batch").write.mode("overwrite").parquet(f"{store}/batch=0")
    spark.createDataFrame([("k", 4, "t"), ("l", 5, "t")], schema).write.mode("append").parquet(source)
    run()
    assert {(r.kb_id, r.doc_id) for r in stored(spark, store).collect()} == {("k", 1), ("l", 3), ("k", 4)}
