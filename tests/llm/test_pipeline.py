"""The pipeline against the plain versions of its stages."""

import corpus_pipeline
from quern.llm import bpe, quality_classifier
from tests.llm import brute


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    labels = spark.read.parquet(f"{d}/labels.parquet")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    verdict = brute.quality_verdicts([(r[0], r[1]) for r in docs], trusted)
    docs = [r for k, r in enumerate(docs) if verdict[k][-1]]
    model = quality_classifier.fit(spark.read.parquet(f"{d}/documents.parquet"), labels)
    good = {r.doc_id for r in quality_classifier.score(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), model).collect() if r.predicted == 1}
    docs = [r for r in docs if r[0] in good]
    classes = brute.near_classes([(r[0], r[1]) for r in docs])
    docs = [r for r, c in zip(docs, classes, strict=True) if r[0] == c]
    mixed = [(i, t) for i, *_, texts in brute.mixed([(r[0], r[3], r[1]) for r in docs]) for t in texts]
    library = bpe.codec(bpe.default_vocabulary()).library
    want = []
    for i, t in mixed:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), brute.digest(",".join(map(str, ids))), brute.digest(t)))
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_stages_keep_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
        assert docs.count() == 0
