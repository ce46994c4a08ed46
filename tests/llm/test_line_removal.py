"""Lines above the limit: counted by documents, and removed."""

from quillspark.llm import line_quality, queries



def lines(stem):
    name = lambda n: stem + chr(97 + n // 26) + chr(97 + n % 26)
    return "\n".join(" ".join(name(6 * i + k) for k in range(6)) for i in range(12))


PAGE = lines("word")


def test_copies_count_each(spark, tmp_path):
    other = lines("other")
    rows = [(i, PAGE, "host") for i in range(60)] + [(100, other, "host"), (101, PAGE, "elsewhere"), (102, PAGE, None)]
    rows += [(100, other, "host")] * 60  # a row that repeats is one document
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_line_frequency(spark, str(tmp_path)).collect()}
    assert all(got[i].removed > 0.9 and not got[i].kept for i in range(60))
    assert all(got[i].removed == 0 and got[i].kept for i in (100, 101, 102))


def test_common_lines_are_cut_out(spark):
    own = [lines(f"own{chr(97 + i)}") for i in range(4)]
    texts = [f"\tShared 12 line \n{own[0]}\n\n", f"{own[1]}\nshared 98 LINE\n \nshared 11 line", own[2], None]
    rows = [(i, t, "host") for i, t in enumerate(texts)] * 2 + [(9, texts[0], "elsewhere")]
    got = line_quality.judge_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=1, copies=True).collect()
    want = {0: f"{own[0]}\n\n", 1: f"{own[1]}\n ", 2: own[2], 3: None, 9: texts[0]}
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.doc_id]
    assert {r.doc_id: r.removed for r in got}[1] == 28 / len(texts[1])
