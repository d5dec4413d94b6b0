"""The pipeline against a plain run of its rules, on a given small table."""

import collections
import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert 0 < len({i for i, _ in left}) <= before
    want = collections.Counter()
    for i, text in left:
        ids = library.encode(text or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == want
