"""Searches of whole query tables against brute force."""

import re

import pytest

from quillspark.operators import search
from quillspark.plans import catalogue


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_keywords(queries, docs, k):
    found = []
    posted = {i: [(a, t) for a, x in enumerate(parts) for t in set(words_of(x))] for i, parts in docs.items()}
    for q, text in queries.items():
        hits = []
        for i, posts in posted.items():
            best = []
            for t in dict.fromkeys(words_of(text)):
                most = 2 if len(t) >= 8 else 1 if len(t) >= 4 else 0
                near = [(edits(w, t), a) for a, w in posts if abs(len(w) - len(t)) <= most and edits(w, t) <= most]
                if near:
                    best.append((min(e for e, _ in near), min(a for _, a in near)))
            if best:
                hits.append((-len(best), sum(e for e, _ in best), min(a for _, a in best), -sum(e == 0 for e, _ in best), i))
        found += [(q, i, -n, e, a, -x, r) for r, (n, e, a, x, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(found)


DOCS = {
    1: ("école", "Der Schlüssel liegt unter der Brücke"), 2: ("src", "El niño juega; la niña también juega"), 3: ("src", "каталог документов и список"),
    4: ("src", "xxxxxxx xxxxx x"), 5: ("Brucke", "schlussel ecole"), 6: ("src", None), 7: ("src", "списка каталоги"),
}
ASKED = {i: t for i, t in enumerate(["die alte Brücke und der Schlüssel", "каталог список", "niña école también extra", "nothing", "", "xxxxx документы"])}


@pytest.mark.parametrize("most", [10_000, 3])
def test_keywords_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(search, "MOST_QUERIES", most)  # 3: many blocks
    docs = spark.createDataFrame([(i, *x) for i, x in DOCS.items()], "id long, title string, content string")
    queries = spark.createDataFrame(list(ASKED.items()), "query_id long, query string")
    got = search.keyword_search(queries, search.postings(docs, ("title", "content")), 3)
    assert sorted(tuple(r) for r in got.select("query_id", "id", "words", "typos", "attribute", "exact", "rank").collect()) == brute_keywords(ASKED, DOCS, 3)


def test_neighbours_of_every_block(spark, sf, monkeypatch):
    monkeypatch.setattr(search, "MOST_QUERIES", 3)
    e = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = []
    for q in (i for i in e if i % 50 == 0):
        near = sorted((round(sum((x - y) ** 2 for x, y in zip(e[q], v)), 9), i) for i, v in e.items())
        want += [(q, i, r) for r, (_, i) in enumerate(near[:20], 1)]
    got = catalogue.v2_document_knn_whole(spark, sf).select("query_id", "id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_all_items_are_asked_whole(spark, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect()}
    found = catalogue.f3_keyword_ranking_whole(spark, sf).collect()
    assert {r.query_id for r in found} == set(items)
    some = {i: items[i] for i in sorted(items)[-2:]}
    part = spark.createDataFrame([(i, *x) for i, x in docs.items()], "id long, title string, content string")
    got = search.keyword_search(spark.createDataFrame(list(some.items()), "query_id long, query string"), search.postings(part, ("title", "content")), 20)
    assert sorted(tuple(r) for r in got.select("query_id", "id", "words", "typos", "attribute", "exact", "rank").collect()) == brute_keywords(some, docs, 20)
    hybrid = catalogue.h5_hybrid_search_whole(spark, sf)
    vectors = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert {r.query_id for r in hybrid.select("query_id").distinct().collect()} == set(items) | {i for i in vectors if i % 50 == 0}


def test_excerpts_keep_every_letter(spark, sf, tmp_path):
    rows = [(1, "été the Brücke é", "fr", "s", 16), (2, "список " * 300 + "the документ", "ru", "s", 2112), (3, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.excerpt for r in catalogue.f7_excerpts_whole(spark, str(tmp_path)).collect()}
    assert got == {1: "été <em>the</em> Brücke é", 2: "список " * 100 + "<em>the</em> документ", 3: ""}
