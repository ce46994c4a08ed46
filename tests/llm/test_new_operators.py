"""Lexical search, Merkle manifest and disclosure terms against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillspark.llm import lexical_search, merkle_manifest, pii_sanitise
from quillspark.llm.common import crc_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# --- lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k=20):
    texts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    texts = [(d, c) for d, c in texts if c]
    n_docs, n_terms = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in texts:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, d is None, d, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, d, score) for r, (_, _, d, score) in enumerate(found[:k], 1)]
    return out


def search_rows(spark, docs, asked, **settings):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(asked, "item_id long, text string")
    found = lexical_search.search(spark, d, i, lexical_search.Settings(**settings))
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("trie, bucket", [(4096, 16), (50, 1), (7, 3)])
def test_search_equals_a_plain_version(spark, trie, bucket):
    dice = random.Random(3)
    words = [f"w{int(dice.paretovariate(0.6))}" for _ in range(3000)] + ["Äpfel", "ÄPFEL", "naïve", "日本語", "X"]
    docs = [(i, " ".join(dice.choices(words, k=dice.choice([0, 1, 5, 40, 200])))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(5, "w1 w1 w2"), (None, docs[7][1]), (9000, None), (9001, "...")]
    items = [(i, " ".join(dice.choices(words, k=dice.choice([1, 3, 30])))) for i in range(25)]
    items += [(30, docs[7][1]), (31, None), (32, ""), (33, "nowhere"), (34, "w1 W1, w1;w2")]
    assert search_rows(spark, docs, items, trie=trie, bucket=bucket) == sorted(plain_search(docs, items), key=repr)


def test_search_in_blocks_of_items(spark):
    docs = [(i, f"a{i % 3} b{i % 5} c{i}") for i in range(100)]
    items = [(i, f"a{i % 3} c{i} b1") for i in range(20)]
    assert search_rows(spark, docs, items, items=3) == sorted(plain_search(docs, items), key=repr)
    # repeated items count once, other texts of an id are ranked on their own
    both = search_rows(spark, docs, [(1, "c5"), (1, "c5"), (1, "c6")])
    assert [(r[1], r[2]) for r in both] == [(1, 5), (1, 6)]


def test_search_of_empty_tables(spark):
    assert search_rows(spark, [], [(1, "a")]) == search_rows(spark, [(1, "a")], []) == []
    assert search_rows(spark, [(1, None), (2, "!")], [(1, "a")]) == []


def test_bounds_leave_subtrees_out():
    import numpy as np

    dice = np.random.default_rng(1)
    groups = [np.sort(dice.choice(np.arange(100 * g, 100 * g + 100), 30, replace=False)) for g in range(20) for _ in range(50)]
    ids, cuts = np.concatenate(groups), np.arange(0, 30 * 1001, 30)
    trie = lexical_search.Trie(ids, np.ones(len(ids), np.int64), cuts, np.full(1000, 100), np.full(2000, 5000), 16)
    asked = np.zeros(2000, np.int64)
    asked[groups[0]] = 1
    best = lexical_search.Best(20)
    best.names = list(range(1000))
    assert trie.search(asked, best) <= 64  # of 1,000
    assert max(best.heap)[2] == 0


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def plain_steps(leaves):
    """For each leaf the list of (before, after) texts of every level."""
    out, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            mate = level[i ^ 1] if i ^ 1 < len(level) else ""
            out[k].append((mate, "") if i % 2 else ("", mate))
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], out


def plain_manifest(rows):
    def leaf(doc_id, text, lang, source, n_chars):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    by = defaultdict(list)
    for r in rows:
        doc_id, n = r[0], r[4]
        more = n + 1 if n is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else n
        by[r[2]].append((doc_id is not None, doc_id or 0, leaf(*r), leaf(*r[:4], more), doc_id))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [plain_steps([x[2] for x in sorted(by[lang], key=lambda x: x[:4])]) for lang in langs]
    root, tops = plain_steps([t[0] for t in trees])
    out = []
    for lang, (subroot, steps), top in zip(langs, trees, tops):
        for x, own in zip(sorted(by[lang], key=lambda x: x[:4]), steps):
            folded = x[3]
            for before, after in own + top:
                folded = sha(before + folded + after)
            out.append((x[4], x[2], subroot, root, sha("".join(a + b for a, b in own + top)), folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows(spark, rows, **settings):
    leaves = merkle_manifest.document_leaves(docs_of(spark, rows), crc_mod(merkle_manifest.F.col("doc_id"), 7) == 0)
    return sorted(map(tuple, merkle_manifest.proofs(spark, leaves, merkle_manifest.Settings(**settings)).collect()), key=repr)


def corpus(n, langs=("de", "en", None, "Éa", "fr")):
    dice = random.Random(n)
    rows = [(i, dice.choice(["", None, "text é" * (i % 5), "x"]), dice.choice(langs), dice.choice([None, "", "s"]), dice.choice([None, i])) for i in range(n)]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, settings", [(1, {}), (2, {}), (150, {}), (70, {"hop": 1, "broadcast_rows": 0}), (70, {"hop": 2})])
def test_manifest_equals_a_plain_version(spark, n, settings):
    rows = corpus(n)
    assert manifest_rows(spark, rows, **settings) == plain_manifest(rows)


@pytest.mark.parametrize("n", [3, 16, 257])
def test_manifest_of_one_language(spark, n):
    rows = corpus(n, ("en",))
    assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_of_repeats_nulls_and_nothing(spark):
    rows = [(1, "a", "en", "s", 1)] * 5 + [(None, None, None, None, None)] * 3 + [(1, "b", "en", "s", 1), (2, "a" * 300_000, "en", "s", 300_000)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)
    assert manifest_rows(spark, []) == []


def test_a_language_of_most_rows_is_dealt_to_many_tasks(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'en' AS lang", "unhex(sha2(string(id), 256)) AS leaf", "unhex(sha2(string(id), 256)) AS presented")
    placed = merkle_manifest.numbered(spark, rows.drop("lang").withColumn("tree", merkle_manifest.F.lit(0)), ["tree"], ["doc_id"], "t", 10)
    assert placed.where("place <> doc_id").count() == 0
    found = merkle_manifest.proofs(spark, rows)
    assert found.where("verified").count() == 20_000 and found.select("root").distinct().count() == 1


def test_what_was_changed_does_not_verify(spark):
    rows = [(i, "t", "en", "s", i) for i in range(200)]
    got = {r[0]: r[-1] for r in manifest_rows(spark, rows)}
    assert {i for i, ok in got.items() if not ok} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0}


# --- personal data


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    dice = random.Random(5)
    parts = ["a.b@c.de", "@", ".", "x@y", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "+49 ", " ", "-", "é", "7", "12", "(", "%", "text", "\n", "."]
    for _ in range(20_000):
        text = "".join(dice.choices(parts, k=dice.randint(1, 12)))
        assert [x[:3] for x in pii_sanitise.base_spans(text)] == plain_base(text), text


def test_long_runs_take_no_square():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "1 " * 1_000_000, "a@" * 500_000, "+1 " * 500_000, "+1" + " " * 1_000_000, "a@b" + ".c" * 500_000):
        pii_sanitise.other_terms(text, pii_sanitise.base_spans(text))


def plain_added(docs, s):
    """Spans of the terms that give an entity away, by counting over all documents in turn."""
    seen = []
    for d, text in docs:
        text = text or ""
        spans = pii_sanitise.base_spans(text)
        terms = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]{2,}", text) if not any(m.start() < b and a < m.end() for a, _, b, _ in spans)]
        near = set()
        for a, _, _, e in spans:
            i = sum(t[0] < a for t in terms)
            near |= {(e, t[2]) for t in terms[max(0, i - s.window) : i + s.window]}
        seen.append((d, text, spans, terms, near, {x.lower() for x in re.findall(r"[^\W_]{2,}", text)}))
    n = len(seen)
    n_e = Counter(e for x in seen for e in {y[3] for y in x[2]})
    n_t = Counter(t for x in seen for t in x[5])
    n_et = Counter(p for x in seen for p in x[4])
    texts = defaultdict(set)
    for x in seen:
        for p in x[4]:
            texts[p].add(x[1])
    kinds = {}
    for (e, t), k in n_et.items():
        share = math.log(k * n / (n_e[e] * n_t[t])) / math.log(n / n_e[e]) if n > n_e[e] else 0
        if len(texts[e, t]) >= s.support and share >= s.generalise:
            kinds[e, t] = 5 if share >= s.remove else 4
    out = []
    for d, text, spans, terms, near, _ in seen:
        told = {}
        for p in near:
            if p in kinds:
                told[p[1]] = max(told.get(p[1], 0), kinds[p])
        out.append((d, sorted([x[:3] for x in spans] + [(a, told[t], b) for a, b, t in terms if t in told])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{}, {"broadcast_rows": 0, "known": 0}])
def test_disclosing_terms_equal_a_plain_version(spark, settings):
    dice = random.Random(9)
    words = [f"wort{int(dice.paretovariate(0.8))}" for _ in range(500)]
    docs = []
    for i in range(300):
        text = dice.choices(words, k=40)
        if i % 3 == 0:
            who = dice.randint(0, 4)
            text[10:10] = [f"Frau Muster{who}", dice.choice(["of", "Verein"]) + str(who % 2), f"m{who}@mail.example.com", f"Raum{who}"]
        docs.append((i, " ".join(text)))
    docs += [(1000 + i, docs[0][1]) for i in range(30)] + [(5, None), (None, docs[3][1]), (6, "")]
    s = pii_sanitise.Settings(**settings)
    rows = pii_sanitise.scan(spark, docs_of(spark, [(d, t, "x", "y", 0) for d, t in docs]), s).collect()
    got = sorted(((r.doc_id, [tuple(x) for x in r.spans]) for r in rows), key=repr)
    assert got == plain_added(docs, s)
    assert any(x[1] == 5 for _, spans in got for x in spans) and any(x[1] == 4 for _, spans in got for x in spans)


def test_sanitised_texts(spark):
    rows = [(i, f"word{i} Frau Muster 12 m@example.com and more{i}", "x", "y", 0) for i in range(5)]
    rows += [(10 + i, f"other{i} and Frau 12 is", "x", "y", 0) for i in range(40)] + [(99, None, "x", "y", 0), (98, "", "x", "y", 0)]
    got = {r.doc_id: r.text for r in pii_sanitise.sanitise(spark, docs_of(spark, rows).withColumn("text_id", merkle_manifest.F.lit(1))).collect()}
    assert got[0] == "word0 Frau  12 [email] and more0"
    assert got[10] == rows[5][1] and got[99] is None and got[98] == "" and len(got) == len(rows)


def test_scan_of_an_empty_table(spark):
    assert pii_sanitise.scan(spark, docs_of(spark, [])).collect() == []
