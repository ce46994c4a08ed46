"""Embeddings and contexts whose tasks hold little."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from quillspark.operators import chunk, rag, vectors


def test_an_embedding_looks_a_word_up_once_a_slice(monkeypatch):
    made = []
    monkeypatch.setattr(vectors.hashlib, "md5", lambda w, md5=vectors.hashlib.md5: made.append(w) or md5(w))
    texts = pa.array([["a", "b", "a"] * 500, [], ["b"]] * 100)
    v = vectors._unit_vectors(texts, 8)
    assert sorted(made) == [b"a", b"b"] and len(v) == 300 and set(map(len, v.to_pylist())) == {8}


def test_a_context_cuts_the_documents_of_its_chunks(spark):
    assert [r[0] for r in spark.createDataFrame([("12_00003",), ("-5_00000",)], "id string").select(chunk.chunk_document(F.col("id"))).collect()] == [12, -5]


def test_central_sentences_come_from_arrow(spark):
    assert rag.central_sentences().evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF  # a batch's texts are never Python strings all at once
    rows = spark.createDataFrame([("A first sentence that is long enough. And a second sentence of words here.",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(rag.central_sentences(1)(F.col("t"))).collect()]
    assert got[0].endswith(".") and got[1:] == [None, None]
