"""Searches of all items and all vectors against brute force, every row."""

import hashlib
import random

import numpy as np
import pytest
from test_search import brute_keywords, words_of

from quillspark.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, dice = str(tmp_path_factory.mktemp("small")), random.Random(12)
    words = ["stone", "river", "lighthouse", "table", "green", "papers", "été", "the", "of", "and", "motorways", "bridge"]
    text = lambda n: " ".join(dice.choices(words, k=n))
    docs = [(i, text(dice.randint(1, 12)), "en", f"src{i % 5}", 10) for i in range(60)] + [(90, None, None, "river", 0), (91, "", "en", "", 0)]
    items = [(i, text(4).replace("bridge", "bridgs")) for i in range(48, 56)]
    vectors = [(i, [dice.gauss(0, 1) for _ in range(8)], i % 3) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, {d[0]: (d[3], d[1]) for d in docs}, dict(items), {v[0]: np.array(v[1], np.float32).astype(float) for v in vectors}


def embedded(text):
    v = np.zeros(256)
    for w in words_of(text):
        code = hashlib.md5(w.encode()).hexdigest()
        v[int(code[:8], 16) % 256] += 1 - 2 * (int(code[8], 16) % 2)
    return (v / max(np.sqrt((v * v).sum()), 1e-12)).astype(np.float32).astype(float)


def nearest(asked, rows, k=20):
    """{query: [(distance, id), ...]} of the nearest rows."""
    return {q: sorted((round(float(((v - x) ** 2).sum()), 9), i) for i, v in rows.items())[:k] for q, x in asked.items()}


def legs(tables):
    _, docs, items, _ = tables
    near = nearest({q: embedded(t) for q, t in items.items()}, {i: embedded(t) for i, (_, t) in docs.items()})
    matched = {}
    for q, i, *_, r in brute_keywords(items, docs, 20):
        matched.setdefault(q, {})[i] = r
    return near, matched


def fused(near, matched):
    """(query, id, rank) and more by reciprocal ranks."""
    out = []
    for q, hits in near.items():
        s = {i: r for r, (_, i) in enumerate(hits, 1)}
        f = matched.get(q, {})
        rrf = {i: (0.6 / (60 + s[i]) if i in s else 0) + (0.4 / (60 + f[i]) if i in f else 0) for i in s | f}
        rrf = {i: x * 1.3 if i in s and i in f else x for i, x in rrf.items()}
        best = max(rrf.values())
        for rank, i in enumerate(sorted(rrf, key=lambda i: (-round(rrf[i], 12), i)), 1):
            out.append((q, i, round(rrf[i] / best, 4), round(rrf[i], 6), i in s and i in f, round(1 - f[i] / len(f), 4) if i in f else 0.0, rank))
    return out


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_hybrid_search(spark, tables):
    folder, _, _, vectors = tables
    columns = "query_id", "id", "score", "rrf", "in_both", "fulltext_score", "rank"
    found = catalogue.h5_hybrid_search_whole(spark, folder)
    assert rows_of(found.where("asked = 'text'"), *columns) == sorted(x for x in fused(*legs(tables)) if x[-1] <= 10)
    near = nearest({i: v for i, v in vectors.items() if i % 50 == 0}, vectors)
    assert rows_of(found.where("asked = 'vector'"), *columns) == sorted(x for x in fused(near, {}) if x[-1] <= 10)


def test_second_page(spark, tables):
    want = sorted((q, i, r) for q, i, *_, r in fused(*legs(tables)) if 10 < r <= 20)
    assert rows_of(catalogue.h10_second_page_whole(spark, tables[0]), "query_id", "id", "rank") == want


def test_weighted_scores(spark, tables):
    near, matched = legs(tables)
    want = []
    for q, hits in near.items():
        s = {i: 1 / (1 + d) for d, i in hits}
        f = {i: 1 / r for i, r in matched.get(q, {}).items()}
        for i in s | f:
            total = s.get(i, 0) * 0.6 + f.get(i, 0) * 0.4
            want.append((q, i, min(1.0, total * 1.1) if i in s and i in f else total))
    got = rows_of(catalogue.h6_weighted_fusion_whole(spark, tables[0]), "query_id", "id", "score")
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert all(abs(a[2] - b[2]) < 6e-5 for a, b in zip(got, sorted(want)))


def test_first_list_and_then_the_new_ones(spark, tables):
    near, matched = legs(tables)
    want = []
    for q, hits in near.items():
        order = [i for _, i in hits] + sorted(set(matched.get(q, {})) - {i for _, i in hits}, key=matched.get(q, {}).get)
        want += [(q, i, r) for r, i in enumerate(order, 1)]
    assert rows_of(catalogue.h9_append_new_whole(spark, tables[0]), "query_id", "id", "rank") == sorted(want)


def test_keyword_ranking(spark, tables):
    _, docs, items, _ = tables
    got = rows_of(catalogue.f3_keyword_ranking_whole(spark, tables[0]), "query_id", "id", "words", "typos", "attribute", "exact", "rank")
    assert got == brute_keywords(items, docs, 20)


def test_vectors(spark, tables):
    folder, _, _, vectors = tables
    near = nearest({i: v for i, v in vectors.items() if i % 50 == 0}, vectors)
    want = sorted((q, i, r) for q, hits in near.items() for r, (_, i) in enumerate(hits, 1))
    assert rows_of(catalogue.v2_document_knn_whole(spark, folder), "query_id", "id", "rank") == want
    score = lambda d: max(0, 1 - d / 2) if d <= 2 else 1 / (1 + d)
    want = sorted((q, i) for q, hits in near.items() for d, i in hits if score(d) >= 0.3)
    assert rows_of(catalogue.v5_chunk_knn_whole(spark, folder), "query_id", "id") == want
