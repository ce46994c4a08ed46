"""How many of the windows that brute force finds similar the fingerprints find: edited passages in other texts."""

import random
from collections import Counter

from quillspark.llm import decontaminate
from quillspark.llm.shingles import Words

STRIP = ".,;:!?\"'()[]{}"


def grams(w):
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(text, item):
    """The greatest similarity of a window of the item's own size."""
    g, n, best = grams(item), min(5, len(item)), 0.0
    size, total = min(len(item), len(text)), sum(grams(item).values())
    if size < n:
        return 0.0
    have, both = Counter(), 0
    seq = [tuple(text[i : i + n]) for i in range(len(text) - n + 1)]
    span = size - n + 1
    for i, x in enumerate(seq):
        both += have[x] < g[x]
        have[x] += 1
        if i >= span:
            y = seq[i - span]
            have[y] -= 1
            both -= have[y] < g[y]
        if i >= span - 1:
            best = max(best, both / (span + total - both))
    return best


def passages(seed, count):
    """(item words, text words): passages with words changed, left out, put in, doubled or moved, in other words."""
    dice = random.Random(seed)
    common = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 3) for i in range(3000)]
    some = lambda n: dice.choices(common, weights, k=n)
    for k in range(count):
        size = dice.choice((5, 7, 9, 12, 14, 17, 20, 25, 33, 40, 59, 80, 110, 150))
        item = some(size)
        if k % 5 == 0:  # shingles that repeat
            item = (item[: max(5, size // 3)] * 4)[:size]
        copy = item[:]
        for _ in range(dice.randrange(1, 3 + size // 25)):
            at = dice.choice((0, 0, -1, -1, dice.randrange(len(copy))))
            what = dice.randrange(4)
            if what == 0:
                copy[at] = some(1)[0]
            elif what == 1 and len(copy) > 5:
                del copy[at]
            elif what == 2:
                copy.insert(at, some(1)[0])
            else:
                copy[at:at] = copy[at : at + 6]
        yield item, some(dice.randrange(120)) + copy + some(dice.randrange(120))


def measure(seed, count):
    """By band of similarity, (found, similar), and the items found without a similar window."""
    pairs = list(passages(seed, count))
    bands, false = {}, 0
    for at in range(0, count, 500):
        some = pairs[at : at + 500]
        index = decontaminate.Index([(i, " ".join(item)) for i, (item, _) in enumerate(some)], decontaminate.Settings())
        words = Words(decontaminate._PUNCTUATION)
        found = index.find_all([words(" ".join(t).encode()) for _, t in some])
        for i, (item, text) in enumerate(some):
            sim, hit = brute(text, item), {m: s for m, s, _ in found[i]}
            if sim >= 0.75:
                band = "0.75-0.85" if sim < 0.85 else "0.85-1"
                a, b = bands.get(band, (0, 0))
                assert i not in hit or abs(hit[i] - sim) < 1e-9
                bands[band] = (a + (i in hit), b + 1)
            else:
                false += i in hit
    return bands, false


def test_recall_of_edited_passages():
    bands, false = measure(3, 2000)
    assert false == 0
    for band, (found, similar) in bands.items():
        assert similar > 200 and found >= 0.99 * similar, (band, found, similar)
