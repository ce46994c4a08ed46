"""Near-duplicates where bands are too many to broadcast, hot, or made of one large component and a few others."""

import random

import pytest
from test_training_data import brute_components, shingle_set

from quillspark.llm import cminhash


def texts(seed):
    dice = random.Random(seed)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(0, 120, 2)]
    for n in range(200, 320):  # near copies of one text, and texts just short of similar
        words = base[:]
        for i in dice.sample(range(80), dice.choice((1, 1, 2, 3, 4, 5))):
            words[i] = f"x{dice.random()}"
        rows.append((n, " ".join(words)))
    rows += [(n, " ".join(f"{n // 3}q{i}" for i in range(30 + n % 3))) for n in range(400, 460)]
    return rows + rows[:5] + [(None, rows[0][1])]


@pytest.mark.parametrize("settings", [cminhash.Settings(), cminhash.Settings(broadcast_rows=0), cminhash.Settings(broadcast_rows=0, rounds=0), cminhash.Settings(broadcast_rows=3, crowd=1), cminhash.Settings(rounds=0, crowd=10**6)])
def test_components(spark, settings):
    rows = texts(7)
    want = brute_components({i: shingle_set(t) for i, t in rows if i is not None})
    got = cminhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), settings).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert len(set(want.values())) > 30
