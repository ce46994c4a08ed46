"""The transducer holds little of any text, and stays right where texts are cut within scripts."""

import random
import unicodedata

import pytest

from quillspark.llm import bpe_stream, queries


@pytest.fixture(scope="module")
def model():
    return bpe_stream.load(queries.tokenizer_path())


@pytest.mark.parametrize("part", ["é", "ñ", "กา", "한국", "ᄒ", "ὄ", "漢", "अ", "🙂", "a", "ﬁ", "#"])
def test_unspaced_text_is_not_held(model, part):
    e = bpe_stream.Encoder(model)
    for _ in range(4):
        list(e.feed(part * (65_536 // len(part))))
        assert len(e.raw) < 100 and len(e.text) < 2048
        assert e.open is None or len(e.open.symbols) < 20_000
    list(e.end())


def test_cuts_do_not_change_composition():
    joins, dice = bpe_stream.joining(), random.Random(8)
    pool = sorted(joins) + ["e", "a", "A", "가", "ᄀ", "ᄒ", "é", "ऩ", "က", "🙂", "Å", "ཱི", "ী", "ো"] * 60
    for _ in range(20_000):
        text = "".join(dice.choices(pool, k=dice.randrange(2, 9)))
        for k in range(1, len(text)):
            if text[k] not in joins:
                cut = unicodedata.normalize("NFC", text[:k]) + unicodedata.normalize("NFC", text[k:])
                assert cut == unicodedata.normalize("NFC", text)


def test_scripts_match_the_library(model):
    from tokenizers import Tokenizer

    library, dice = Tokenizer.from_file(queries.tokenizer_path()), random.Random(9)
    for _ in range(300):
        text = "".join(dice.choices("éñกา한국한ὄअ🙂ȩ́ ཱིﬁΣ#'", k=dice.randrange(1, 200)))
        want = library.encode(text, add_special_tokens=False).ids
        for part in (1, 3, 50):
            e = bpe_stream.Encoder(model)
            assert [i for at in range(0, len(text), part) for i in e.feed(text[at : at + part])] + list(e.end()) == want
