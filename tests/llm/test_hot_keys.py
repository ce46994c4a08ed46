"""Keys that hold most rows: results where nothing is broadcast, and the share of rows that one task gets."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import cminhash, common, line_quality, url_filter, warc_zstd


@pytest.fixture
def dealt(spark, monkeypatch):
    """Hot from 20 rows on, many partitions, none of them merged."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "40", "-1")):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def share(rows):
    """The largest share of rows in one partition."""
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_join(spark, dealt, how):
    left = spark.range(4000).select("id", F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50 + 100).alias("key"))
    right = common.materialise(spark, spark.range(200).select(F.col("id").cast("int").alias("key"), (F.col("id") * 2).alias("x")).where("key <> 110"), "right")
    got = common.split_join(spark, left, right, "key", "id", 0, how)
    want = left.join(right, "key", how)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert share(got) < 0.15 and share(want) > 0.7


def test_crowd_of_near_copies(spark, dealt):
    dice = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        words = base[:]
        words[dice.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[0][1]) for i in range(100)] + [(2000 + i, f"other{i} text{i} of{i} five{i} words{i} more") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in cminhash.near_duplicates(spark, docs, cminhash.Settings(broadcast_rows=0, broadcast_sets=0)).collect()}
    assert got == {i: i if i >= 2000 else 0 for i, _ in rows}


def test_hot_lines_payloads_and_endings(spark, dealt, monkeypatch):
    dice = random.Random(4)
    word = lambda: "".join(dice.choices("abcdefgh", k=9))
    lines = [(i, "the common line" + "\n" + " ".join(word() for _ in range(60)) + "\n\n" + "The Common line", "h" if i % 4 else None) for i in range(200)]
    docs = spark.createDataFrame(lines, "doc_id long, text string, source string").repartition(4)
    judge = lambda n: {r.doc_id: (r.kept, r.removed, r.text) for r in line_quality.judge_lines(spark, docs, max_docs=20, broadcast_rows=n, copies=True).collect()}
    got = judge(0)
    assert got == judge(1000) and all(t == lines[i][1].split("\n")[1] + "\n" for i, (_, _, t) in got.items())

    pages = spark.createDataFrame([(i, f"http://a/{i}", None if i % 5 else f"<p>{i}</p>") for i in range(300)], "page_id long, url string, html string")
    read = lambda n: sorted((r.page_id, r.record_type, r.refers_to) for r in warc_zstd.read_archives(spark, warc_zstd.write_archives(spark, pages, warc_zstd.Settings(broadcast_rows=n))).collect())
    assert read(0) == read(1000) and sum(kind == "revisit" for _, kind, _ in read(0)) == 239

    urls = spark.createDataFrame([(i, f"http://x{i % 9}.org/{'es' if i % 2 else 'page'}/{i}t") for i in range(120)], "page_id long, url string")
    score = lambda: {r.page_id: round(r.score, 6) for r in url_filter.filter_urls(spark, urls, order=7, folded=False).collect()}
    split = score()
    monkeypatch.setattr(common, "HOT_ROWS", 10**6)
    monkeypatch.setattr(url_filter, "HOT_ROWS", 10**6)
    assert split == score()
