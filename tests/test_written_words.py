"""Searches whose work stays where a document's words lie."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import search
from tests.test_search import ASKED, DOCS, brute_keywords

RANKED = ["query_id", "id", "words", "typos", "attribute", "exact", "rank"]


def test_words_are_written_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, "t", f"word{i % 7} the the rest{i}") for i in range(300)], "id long, title string, content string")
    posted = search.postings(docs, ("title", "content"))
    assert posted.words.count() == 300  # a row per document
    assert posted.vocabulary.where("term = 'the'").first().documents == 300
    plan = search.best_documents(search.matched_terms(spark.createDataFrame([(1, 0, "the")], "query_id long, qpos int, qterm string"), posted.vocabulary), posted, 3, ties=False)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in plan.collect())[:3] == [0, 1, 2] and plan.count() <= 3 * plan.rdd.getNumPartitions()


@pytest.mark.parametrize("cells", [4_000_000, 1])
def test_parts_of_queries_and_documents(spark, monkeypatch, cells):
    """Few matched words at a time, few terms at a time, one document at a time: the same results."""
    monkeypatch.setattr(search, "MOST_WORDS", 3)
    monkeypatch.setattr(search, "MOST_TERMS", 2)
    monkeypatch.setattr(search, "MOST_CELLS", cells)
    docs = spark.createDataFrame([(i, *x) for i, x in DOCS.items()], "id long, title string, content string")
    queries = spark.createDataFrame(list(ASKED.items()), "query_id long, query string")
    got = search.keyword_search(queries, search.postings(docs, ("title", "content")), 3).select(*RANKED).collect()
    assert sorted(map(tuple, got)) == brute_keywords(ASKED, DOCS, 3)


def test_rows_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "x", "red"), (1, "red", "fox"), (2, "x", "red fox"), (None, "x", "fox"), (None, "y", "red")], "id long, title string, content string")
    queries = spark.createDataFrame([("a", "red fox"), ("b", "nothing"), ("c", None)], "query_id string, query string")
    got = search.keyword_search(queries, search.postings(docs, ("title", "content")), 9).select(*RANKED).collect()
    assert sorted(map(tuple, got), key=lambda r: r[-1]) == [("a", 1, 2, 0, 0, 2, 1), ("a", None, 2, 0, 1, 2, 2), ("a", 2, 2, 0, 1, 2, 3)]
    none = search.keyword_search(queries.where("query_id = 'b'"), search.postings(docs, ("title", "content")), 9)
    assert none.count() == 0


def test_deletions_of_near_words_meet():
    dice = random.Random(4)
    for _ in range(300):
        word = "".join(dice.choices("aeiné日𝒳", k=dice.randint(3, 12)))
        at = sorted(dice.sample(range(len(word)), 2))
        less = word[: at[0]] + word[at[0] + 1 : at[1]] + word[at[1] + 1 :]
        mine, other = ({int(h[0]) for _, h in search.deletions(np.array([w], object))} for w in (word, less))
        assert mine & other


@pytest.mark.parametrize("most", [0, 500_000])
def test_many_ties_are_handed_on(spark, monkeypatch, most):
    monkeypatch.setattr(search, "MOST_TIES", most)
    monkeypatch.setattr(search, "MOST_CELLS", 1)
    docs = spark.createDataFrame([(i, "t", "red fox" if i % 3 else "red") for i in range(60)], "id long, title string, content string")
    size = docs.select("id", (-F.col("id")).alias("key"))
    queries = spark.createDataFrame([(1, "red fox"), (2, "red")], "query_id long, query string")
    got = search.keyword_search(queries, search.postings(docs, ("title", "content")), 4, sort=size).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 59), (1, 58), (1, 56), (1, 55), (2, 59), (2, 58), (2, 57), (2, 56)]
