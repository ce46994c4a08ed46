"""Repeated three-word windows where packed places run out of room, or hashes share the bits that are kept."""

import random
from collections import Counter

import pytest

from quillspark.llm import line_quality


def brute(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)})


@pytest.mark.parametrize("bits", [24, 4, 60, 62])
def test_repeats_match_brute_force(spark, monkeypatch, bits):
    """4: most texts have more places than fit; 60 and more: a few bits of a hash are left, so that they collide."""
    monkeypatch.setattr(line_quality, "_POSITION_BITS", bits)
    dice = random.Random(bits)
    texts = [" ".join(dice.choices("abcdefghij", k=dice.randrange(0, 150))) for _ in range(60)]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = {r.doc_id: r.n_repeat_words for r in line_quality.base_rules(docs).collect()}
    assert got == {i: brute(t.split()) for i, t in enumerate(texts)}
    assert len(set(got.values())) > 20
