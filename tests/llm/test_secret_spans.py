"""All spans of the scan against a slow version that tries every window by itself."""

import math
import random
import time
from collections import Counter

import pytest

from quillspark.llm import queries, secret_scan

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
TOKEN = set(LOWER + UPPER + DIGITS + "+/_=-")
#: (characters, least run, window, bits) of each class.
CLASSES = [
    (set(DIGITS + "abcdefABCDEF"), 20, 20, 3.0), (set(LOWER + UPPER + DIGITS), 20, 20, 3.6), (TOKEN, 24, 24, 3.9),
]


def runs(text, letters, least):
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in letters:
            end += 1
        if end - at >= least:
            yield at, end
        at = max(end, at + 1)


def cleared(x):
    parts = x.replace("_", "-").replace("/", "-").split("-")
    word = lambda p: bool(p) and set(p[1:]) <= set(LOWER) and (p[0] in LOWER or p[0] in UPPER and len(p) > 1)
    if all(map(word, parts)) or any(all(p and set(p) <= set(kind) for p in parts) for kind in (UPPER, DIGITS)):
        return True
    return len(set(x)) == 1 or any(k in x.lower() for k in ("example", "placeholder", "changeme", "xxxx"))


def slow_spans(text):
    """Entropy spans before base spans are looked at."""
    hot = []
    for a, b in runs(text, TOKEN, 20):
        if cleared(text[a:b]):
            continue
        for letters, least, width, bits in CLASSES:
            for c, d in runs(text[a:b], letters, least):
                run = text[a + c : a + d]
                if cleared(run):
                    continue
                for i in range(len(run) - width + 1):
                    counts = Counter(run[i : i + width]).values()
                    if -sum(n / width * math.log2(n / width) for n in counts) >= bits - 1e-9:
                        hot.append((a + c + i, a + c + i + width))
    joined = []
    for a, b in sorted(hot):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    return joined


def slow_scan(text):
    base = secret_scan.Scanner().base(text)
    covered = {i for _, a, b in base for i in range(a, b)}
    added = [("entropy", a, b) for a, b in slow_spans(text) if not set(range(a, b)) <= covered]
    return sorted(base + added, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]), s[2]))


def test_spans_match_the_slow_version(spark, sf, tmp_path):
    dice = random.Random(6)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for k in range(40):  # tokens at any place of real texts
        text, token = texts[dice.choice(list(texts))], "".join(dice.choices(LOWER + UPPER + DIGITS + "/-", k=dice.randrange(20, 60)))
        at = dice.randrange(len(text) + 1)
        texts[10**6 + k] = f"{text[:at]} {token} {text[at:]}"
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = 0
    for r in queries.op9_entropy_secrets(spark, str(tmp_path)).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in slow_scan(texts[r.doc_id]))
        assert r.spans == want
        found += "entropy" in want
    assert found


def test_spans_of_made_up_tokens():
    dice = random.Random(4)
    parts = ["0123456789abcdef", LOWER, LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/_=-", "-_/", "ab"]
    for _ in range(400):
        pieces = ["".join(dice.choices(dice.choice(parts), k=dice.randrange(1, 40))) for _ in range(dice.randrange(1, 6))]
        text = dice.choice(["", " ", "-", "/"]).join(pieces) + dice.choice(["", " password=" + pieces[0], " AKIA" + "ABCD1234" * 3])
        assert secret_scan.Scanner().scan(text)[1] == slow_scan(text)


@pytest.mark.parametrize("text", ["ab-" * 10_000 + "a1", "path/" * 10_000 + "v1", "Ab_" * 10_000 + "1", "A-" * 10_000 + "a", "1/" * 10_000 + "a", "x" * 30_000 + "-"])
def test_near_misses_of_the_allow_list_cost_one_pass(text):
    start = time.perf_counter()
    secret_scan.Scanner().scan(text)
    assert time.perf_counter() - start < 1


def test_rest_of_a_hex_token_is_masked():
    text = "see 0123456789abcdef01234567QzX9vKp4RwB8nYc3HsJ6dFg5TxZ2LmW7 now"
    assert secret_scan.mask(text, secret_scan.Scanner().scan(text)[1]) == "see [secret] now"


def test_ties_of_kinds():
    text = "AKIA" + "0" * 20 + "QzX9vKp4RwB8nYc3HsJ6dFg5TxZ2LmW7"
    spans = secret_scan.Scanner().scan(text)[1]
    assert spans == slow_scan(text) and [k for k, a, _ in spans if a == 0] == sorted((k for k, a, _ in spans if a == 0), key=secret_scan.KINDS.index)
