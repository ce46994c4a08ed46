"""The pipeline against its stages' own results, worked out apart from it."""

import corpus_pipeline
from pyspark.sql import functions as F

from quillspark.llm import cminhash, decontaminate, queries, secret_scan, toxicity_knn
from quillspark.llm.common import crc_mod, table


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    index = toxicity_knn.fit(spark, docs, table(spark, sf, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    toxic = {r.doc_id for r in toxicity_knn.score_documents(spark, docs, index).where("score >= 0.5").collect()}
    left = docs.where(~F.col("doc_id").isin(*toxic))
    left = left.where(F.col("doc_id").isin(*(r.doc_id for r in cminhash.near_duplicates(spark, left).where("kept").collect())))
    leaks = {r.doc_id for r in decontaminate.contaminated(spark, left, table(spark, sf, "benchmark")).collect()}
    want = {r.doc_id: r.text for r in left.where(~F.col("doc_id").isin(*leaks)).collect()}
    scanner = secret_scan.Scanner()
    from quillspark.llm import bpe_stream

    model = bpe_stream.load(queries.tokenizer_path())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(want) and toxic and leaks
    for i, text in want.items():
        e = bpe_stream.Encoder(model)
        masked = secret_scan.mask(text, scanner.scan(text)[1])
        assert got[i].n_tokens == len([*e.feed(masked), *e.end()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, sf).columns) == sorted(docs.columns), name
