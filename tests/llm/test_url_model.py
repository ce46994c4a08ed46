"""The URL models count characters as they are, with long contexts."""

import math
import re
import zlib
from collections import Counter

from quillspark.llm import queries, url_filter

ORDER = 7
WORDS = ["alpha", "Beta", "каталог", "𝔸été", "x-y_z", "item?id=10", "ITEM#20", "q%41"]


def test_model_matches_brute_force(spark, tmp_path):
    pages = [(i, f"http://h{i % 3}.example.{tld}/{lang}/{WORDS[i % 8]}/{i * 7 % 40}") for i in range(60) for tld, lang in (("org", "es"), ("org", "xx"), ("net", "fr"))]
    pages = [(k, u) for k, (_, u) in enumerate(pages)] + [(900, None), (901, ""), (902, "http://"), (5, pages[5][1]), (5, pages[5][1])]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    counts, contexts, kinds = Counter(), Counter(), {}
    bare = lambda u: url_filter.START * ORDER + re.sub(r"(?s)^[^:/?#]*://", "", u or "")
    for _, u in pages:
        if not u or ".org/" not in u or zlib.crc32(u.encode()) % url_filter.FOLDS == 0:
            continue
        side, s = "/es/" not in u or "example.org" not in u, bare(u)
        for i in range(ORDER, len(s)):
            for k in range(ORDER + 1):
                ctx = s[i - k : i]
                counts[side, ctx, s[i]] += 1
                contexts[side, ctx] += 1
                kinds.setdefault((side, ctx), set()).add(s[i])

    def p(side, ctx, c):
        below = p(side, ctx[1:], c) if ctx else 1 / url_filter.CHARACTERS
        w = max(1, len(kinds.get((side, ctx), ())))
        return (counts[side, ctx, c] + w * below) / (contexts[side, ctx] + w)

    def score(u):
        s = bare(u)
        at = range(ORDER, len(s))
        return sum(math.log(p(True, s[i - ORDER : i], s[i]) / p(False, s[i - ORDER : i], s[i])) for i in at) / max(1, len(at))

    got = queries.op1_url_markov_ratio(spark, str(tmp_path)).collect()
    assert len(got) == len(pages)
    urls = dict(pages)
    for r in got:
        assert abs(r.score - score(urls[r.page_id])) < 3e-6


def test_digits_case_and_script_count(spark):
    urls = [f"http://a.org/{i}" for i in range(40)] + [f"http://a.example.org/es/{i}" for i in range(40)]
    urls += ["http://b.net/12", "http://b.net/98", "http://b.net/ab", "http://b.net/AB", "http://b.net/é", "http://b.net/к", "h://" + "é" * 50000]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.score for r in url_filter.filter_urls(spark, rows, order=7, folded=False).collect()}
    assert len(got) == len(urls) and got[80] != got[81]
    assert url_filter.filter_urls(spark, rows.limit(0), order=7, folded=False).count() == 0
