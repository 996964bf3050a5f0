"""The registered queries themselves: columns, types, and rows against plain versions, libraries and SQL."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
import zstandard

import __spark_entry__
from quern.llm import bpe, quality_classifier
from quern.llm.html_extraction import main_text
from tests.llm import brute
from tests.llm.test_lm_scoring import brute as lm_brute
from tests.llm.test_lm_scoring import rounded

DATA = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()
#: The columns that the queries promise first, and their types.
COLUMNS = {
    "op1_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op2_bpe_round_trip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_near_dedup": "doc_id bigint, class_id bigint, is_representative boolean, text_md5 string",
    "op4_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op8_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op9_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, llr double",
    "op10_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


@pytest.fixture(scope="module")
def found(spark):
    """Rows of a query, which runs once."""
    held = {}

    def get(name):
        if name not in held:
            df = QUERIES[name](spark, DATA)
            assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
            held[name] = df.collect()
        return held[name]

    return get


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").collect()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet").collect()


def duck(sql):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con.sql(sql).fetchall()


def test_token_counts(found, docs):
    c = bpe.codec(bpe.default_vocabulary())
    n = {d.doc_id: len(c.library.encode(d.text or "", add_special_tokens=False).ids) for d in docs}
    want = [(i, b, n[i], n[i] > 512) for i, b in duck("SELECT doc_id, octet_length(encode(coalesce(text, ''))) FROM documents")]
    assert sorted(map(tuple, found("op1_token_counts"))) == sorted(want)


def test_round_trip(found, docs):
    c = bpe.codec(bpe.default_vocabulary()).library
    want = []
    for d in docs:
        ids = c.encode(d.text or "", add_special_tokens=False).ids
        text = c.decode(ids, skip_special_tokens=False)
        want.append((d.doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text))))
    assert sorted(map(tuple, found("op2_bpe_round_trip"))) == sorted(want)


def test_near_dedup(found, docs):
    rows = [(d.doc_id, d.text) for d in docs]
    want = [(i, c, i == c, hashlib.md5((t or "").encode()).hexdigest()) for (i, t), c in zip(rows, brute.near_classes(rows))]
    assert sorted(map(tuple, found("op3_near_dedup"))) == sorted(want)


def test_quality_classifier(spark):
    """Dictionaries, sizes and calibration, one text at a time; on the smallest data there are too few bad texts to learn from."""
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet").collect() for t in ("documents", "labels"))
    q = quality_classifier
    import zlib

    rest = lambda i: zlib.crc32(str(i).encode()) % 3
    quality = {x.doc_id: x.quality for x in labels if x.quality in (0, 1) and rest(x.doc_id) != 1}
    share = [sum(v == k for v in quality.values()) for k in (0, 1)]
    assert max(share) <= q.PER_CLASS  # all rows are learnt from
    pieces = lambda t: t if len(t.encode()) <= q.SAMPLE_BYTES else "".join(t[(at := int(i * (len(t) / q.PIECES))) : at + q.PIECE] for i in range(q.PIECES))
    text = {d.doc_id: pieces(d.text) for d in docs if d.text is not None}
    sample = [[text[i] for i in sorted((i for i, v in quality.items() if v == k and i in text), key=str)] for k in (0, 1)]
    dictionaries = [zstandard.ZstdCompressionDict(q._dictionary(sample[k][::2])) for k in (0, 1)]
    tools = [zstandard.ZstdCompressor(level=q.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in dictionaries]

    def evidence(t):
        raw = (t or "").encode()
        sizes = [sum(len(z.compress(raw[i : i + q.RUN])) for i in range(0, len(raw), q.RUN)) for z in tools]
        return (sizes[0] - sizes[1]) / (len(raw) + q.STEADY), len(raw) / (len(raw) + q.STEADY)

    prior = math.log((share[1] + 1) / (share[0] + 1))
    x = np.array([evidence(t) for k in (0, 1) for t in sample[k][1::2]])
    y = np.repeat([0.0, 1.0], [len(s[1::2]) for s in sample])
    w = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum())
    a, b = q._logistic(x, y, w / w.mean(), prior)
    got = {r.doc_id: r for r in QUERIES["op5_quality_classifier"](spark, data).collect()}
    assert len(got) == len(docs)
    for d in docs:
        u, v = evidence(d.text)
        p = 1 / (1 + math.exp(-min(30, max(-30, a * u + b * v + prior))))
        r = got[d.doc_id]
        assert (r.held_out, r.predicted) == (rest(d.doc_id) == 1, int(r.score >= 0.5))
        assert r.score == pytest.approx(p)


def test_lm_scoring(found, docs):
    rows = [(d.doc_id, d.text) for d in docs]
    assert rounded(found("op6_lm_scoring")) == lm_brute(rows, 3)[0]


def test_lm_base(found):
    sql = r"""
    WITH d AS (SELECT doc_id, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ['']) AS w FROM documents),
    t AS (SELECT doc_id, unnest(w) AS w FROM d), held AS (SELECT unnest([{held}]) AS doc_id),
    c AS (SELECT w, count(*) AS c FROM t WHERE doc_id NOT IN (SELECT doc_id FROM held) GROUP BY w),
    n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
    SELECT doc_id, count(*), count(c), max(n), round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 5) FROM t LEFT JOIN c USING (w) CROSS JOIN n GROUP BY doc_id
    """
    rows = found("op6_lm_scoring")
    held = ", ".join(str(r.doc_id) for r in rows if r.held_out)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == sorted(duck(sql.replace("{held}", held)))


def test_html_extraction(found, spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    want = [(p.page_id, p.url, (t := main_text(p.html)), len(t)) for p in pages]
    assert sorted(map(tuple, found("op8_html_extraction"))) == sorted(want)


def test_quality_rules(found, docs, labels):
    rows = [(d.doc_id, d.text) for d in docs]
    trusted = {x.doc_id for x in labels if x.quality == 1}
    want = brute.quality_verdicts(rows, trusted)
    assert sorted(tuple(r)[:-1] for r in found("op9_quality_rules")) == sorted((i, *want[k]) for k, (i, _) in enumerate(rows))


def test_quality_rules_base(found):
    sql = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
    u AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
    SELECT doc_id, len(w), length(array_to_string(w, '')), len(regexp_extract_all(t, '[#*$%&|<>]')), coalesce(n, 0) FROM w LEFT JOIN u USING (doc_id)
    """
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) for r in found("op9_quality_rules")) == sorted(duck(sql))


def test_source_mixing(found, docs):
    want = [(i, n, s, round(t, 6), k) for i, n, s, t, k, _ in brute.mixed([(d.doc_id, d.source, d.text) for d in docs])]
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in found("op10_source_mixing")) == sorted(want)


def test_source_sizes(found):
    sql = r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents)
    SELECT doc_id, n, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) FROM d
    """
    rows = found("op10_source_mixing")
    assert sorted((r.doc_id, r.size, r.source_size) for r in rows) == sorted(duck(sql))
    assert sum({r.source_size: r.target for r in rows}.values()) <= 1.5 * sum(r.size for r in rows) + 1e-6


@pytest.mark.parametrize("name", ["op4_exact_topk", "op5_quality_classifier", "op7_warc"])
def test_columns(found, name):
    assert found(name)


def test_names():
    assert sorted(COLUMNS) == sorted(x for x in QUERIES if re.match(r"op\d+_", x))
