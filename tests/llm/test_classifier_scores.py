"""Whole scores of both classifiers' queries against plain versions."""

import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import fm_quality, queries, toxicity_knn
from quillspark.llm.common import crc_mod, table


def plain_neighbours(texts, labels):
    """doc_id to (score, evidence), by dictionaries and all pairs."""
    s = toxicity_knn.Settings()
    terms = {i: Counter(w for w in re.split(r"[\W\d_]+", (t or "").lower()) if w) for i, t in texts.items()}
    known = {i: y for i, y in labels.items() if i in texts and 1 <= len((texts[i] or "").encode()) <= s.text_bytes and y in (0, 1) and zlib.crc32(str(i).encode()) % 5}
    n = [sum(1 for y in known.values() if y == k) for k in (0, 1)]
    assert max(n) <= s.sample
    has = [Counter(t for i, y in known.items() if y == k for t in terms[i]) for k in (0, 1)]

    def chi_square(t):
        total, out = sum(n), 0.0
        for k in (0, 1):
            for there in (True, False):
                seen = has[k][t] if there else n[k] - has[k][t]
                both = has[0][t] + has[1][t]
                expected = n[k] * (both if there else total - both) / total
                out += (seen - expected) ** 2 / expected if expected else 0
        return out

    space = {t for t in set(has[0]) | set(has[1]) if chi_square(t) >= s.significance}
    df = Counter(t for c in terms.values() for t in c)

    def vector(c):
        v = {t: (1 + math.log(k)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, k in c.items() if t in space}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(terms[i]) for i in texts}
    examples = sorted((i for i in known if vectors[i]), key=lambda i: (known[i], min(vectors[i], key=lambda t: (-vectors[i][t], t)), i))

    def near(i, skip=None):
        cosines = [(sum(x * vectors[e].get(t, 0) for t, x in vectors[i].items()), k) for k, e in enumerate(examples) if e != skip]
        return sorted(((c, k) for c, k in cosines if c > 1e-15), key=lambda x: (-round(x[0], 12), x[1]))[: s.neighbours]

    def votes(found):
        total = sum(c * c for c, _ in found)
        return sum(c * c * known[examples[k]] for c, k in found) / total if total else 0.0

    x = np.array([votes(near(e, e)) for e in examples])
    y = np.array([known[e] for e in examples], float)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    a, b = 4.0, -2.0
    for _ in range(40_000):  # plain gradient descent to the same optimum
        p = 1 / (1 + np.exp(-(a * x + b)))
        a, b = a - 2 * ((weight * (p - y) * x).sum() + 1e-3 * (a - 8)), b - 2 * ((weight * (p - y)).sum() + 1e-3 * (b + 4))
    out = {}
    for i in texts:
        found = near(i)
        out[i] = 1 / (1 + math.exp(-(a * votes(found) + b))), [[examples[k], known[examples[k]]] for _, k in found[:3]]
    return out


def test_toxicity_scores(spark):
    sf = "/root/testdata/sf0.01"  # the smaller one has no toxic labels to learn
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    want = plain_neighbours(texts, labels)
    got = queries.op7_toxicity_neighbours(spark, sf).collect()
    assert len(got) == len(texts) and {r.predicted for r in got} == {0, 1}
    for r in got:
        score, evidence = want[r.doc_id]
        assert abs(r.score - score) < 1e-5
        assert [[i, y] for i, _, y in json.loads(r.evidence)] == evidence


def test_texts_of_one_id(spark):
    """Of several texts of an id the least is the example, whatever the partitions."""
    rows = [(i, f"{'bad' if i % 2 else 'good'} word{i % 3}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    found = set()
    for order in (rows + [(1, "zzz"), (2, "zzz bad")], [(2, "zzz bad"), (1, "zzz"), *rows[::-1]]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        index = toxicity_knn.fit(spark, docs, labels, F.lit(True))
        machine = fm_quality.fit(spark, docs, labels, F.lit(True))
        found.add((index.slope, index.offset, machine.bias, machine.w.tobytes()))
    assert len(found) == 1


def plain_margin(machine, text, n_chars):
    """The machine's value by all pairs of features."""
    s, raw = machine.settings, (text or "").encode()
    words = raw.split()
    x = np.zeros(s.buckets + 16)
    for word in words:
        x[xxhash.xxh32_intdigest(word.lower()) % s.buckets] += 1
    x = np.log1p(x)
    x /= max(math.sqrt((x * x).sum()), 1e-9)
    x[s.buckets :] = fm_quality.Features.structure(raw, words, n_chars)
    at = np.flatnonzero(x)
    value = machine.bias + sum(float(machine.w[i]) * x[i] for i in at)
    for k, i in enumerate(at):
        for j in at[:k]:
            value += float(machine.v[i].astype(float) @ machine.v[j].astype(float)) * x[i] * x[j]
    return value


def test_quality_scores(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    machine = fm_quality.fit(spark, docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    rows = {r.doc_id: r for r in docs.collect()}
    got = queries.op3_factorisation_machine(spark, sf).collect()
    assert len(got) == len(rows)
    short = [r for r in got if len(rows[r.doc_id].text or "") < 3000]
    assert len(short) > 50
    for r in short:
        margin = plain_margin(machine, rows[r.doc_id].text, rows[r.doc_id].n_chars)
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-4
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
