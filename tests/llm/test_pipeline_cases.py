"""Every stage on nulls, empty and very long texts, repeated rows, ties, clashing columns and empty tables."""

import random

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "password=hunter2secret"
STAGES = dict(corpus_pipeline.STAGES)


def words(seed, n):
    dice = random.Random(seed)
    return " ".join(f"{dice.choice('abcdefgh')}{dice.randrange(10**6)}" for _ in range(n))


ITEM, CLEAN, LONG = words(1, 30), words(2, 80), words(3, 60_000)
ROWS = [
    (1, None), (2, ""), (2, ""), (3, " \n"), (4, CLEAN), (5, CLEAN), (5, CLEAN), (6, CLEAN + " more"), (None, CLEAN), (None, CLEAN), (None, None),
    (7, LONG), (8, f"{words(4, 50)} {ITEM} {words(5, 50)}"), (None, f"{words(6, 9)} {ITEM}"), (9, f"{words(7, 30)} {SECRET} end"), (10, "you idiot moron scum"),
    (11, "x" * 200_000), (12, words(8, 40)), (12, words(9, 40)),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, None, "s", len(t) if t else None) for i, t in ROWS], SCHEMA)
    docs.selectExpr("*", "0.9 AS score", "true AS kept", "'k' AS bands", "1 AS _row").write.parquet(f"{path}/documents.parquet")
    labels = [(100 + i, 0, i % 2) for i in range(4)] + [(None, 1, 1), (10, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES[name](spark, docs, folder)
    if name == "bpe":
        assert sorted((r.doc_id or 0 for r in out.collect())) == sorted(i or 0 for i, _ in ROWS)
        assert all(r.n_tokens == 0 for r in out.collect() if r.doc_id in (1, 2))
        return
    assert out.columns == list(corpus_pipeline.COLUMNS)
    want = list(ROWS)
    if name == "near_dedup":
        want = [r for r in ROWS if r[0] not in (5, 6)]
        want.remove((2, ""))
    elif name == "decontamination":
        want = [r for r in ROWS if ITEM not in (r[1] or "")]
    elif name == "secrets":
        want = [(i, t and t.replace(SECRET, "[secret]")) for i, t in ROWS]
        assert {r.doc_id: r.n_chars for r in out.where("doc_id in (1, 9)").collect()} == {1: None, 9: len(ROWS[14][1]) - len(SECRET) + 8}
    assert rows_of(out) == sorted(want, key=str)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_an_empty_table(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert STAGES[name](spark, docs, folder).count() == 0


def test_toxic_rows_go_one_by_one(spark, tmp_path):
    dice = random.Random(3)
    prose = lambda: " ".join(dice.choices(["stone", "river", "light", "table", "green", "paper"], k=20))
    rows = [(i, prose() + (" vile rotten" if i % 2 else ""), None, "s", 1) for i in range(200)]
    rows += [(500, "vile rotten words", None, "s", 1), (500, prose(), None, "s", 1), (None, "rotten vile", None, "s", 1), (None, prose(), None, "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert rows_of(kept) == sorted(((i, t) for i, t, *_ in rows if "vile" not in t), key=str)


def test_whole_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted([0, 0, 0, 1, 2, 3, 4, 7, 9, 10, 11, 12, 12])


@pytest.mark.parametrize("most", [500_000, 0])
def test_near_dedup_judges_texts(spark, monkeypatch, most):
    """A text that is like no other stays, whatever becomes of other texts of its doc_id."""
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", most)
    rows, want = [], set()
    for k in range(5):
        a, b, c = (words(31 + 3 * k + j, 60) for j in range(3))
        cases = (
            ((1, a), (5, a), (5, b), (9, c)), ((1, a), (1, b), (2, a + " end"), (2, c)), ((3, b), (3, b), (4, b + " end"), (3, c)),
            ((7, a), (8, a), (8, b), (6, b)), ((1, a), (1, a + " end"), (2, a + " stop"), (1, b)),
        )
        stay = ({(1, a), (5, b), (9, c)}, {(1, a), (1, b), (2, c)}, {(3, b), (3, c)}, {(7, a), (6, b)}, {(1, a), (1, a + " end"), (1, b)})
        rows += [(100 * k + i, t) for i, t in cases[k]]
        want |= {(100 * k + i, t) for i, t in stay[k]}
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    # of several texts of the least doc_id in one group one stays
    assert len(got) == len(want) - 1 and set(got) < want
    assert len([i for i, _ in got if i == 401]) == 2 and (401, b) in got
