"""Counts against the library over whole texts."""

from quern.llm import bpe, token_counts

HARD = [None, "", " ", "a", "the cat sat\n\n on  the mat 123's", "<|endoftext|>x<|endoftext|>", "日本 語😀", "q" * 9000, " " * 5000, "the the the", "the the the"]


def test_counts(spark):
    rows = [(i if i % 4 else None, t, "clash") for i, t in enumerate(HARD * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    c = bpe.codec(bpe.default_vocabulary())
    want = sorted((str(i), len((t or "").encode()), len(c.library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    for size in (1, 200, 1 << 20):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, block_bytes=size).collect())
        assert got == want
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_other_vocabularies(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["Hello there world", "", "čeština  je"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    paths = [public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json")]
    model, lib = sentencepiece.SentencePieceProcessor(model_file=paths[0]), Tokenizer.from_file(paths[1])
    for path, count in ((paths[0], lambda t: len(model.encode(t))), (paths[1], lambda t: len(lib.encode(t, add_special_tokens=False).ids))):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
        assert got == {i: count(t) for i, t in enumerate(texts)}
