"""Words with marks behind them use the codes of their letters."""

import random

import pytest

from meshwright.llm.bpe import Codec
from meshwright.llm.queries import vocabulary


@pytest.fixture(scope="module")
def path():
    return vocabulary()


def test_letters_are_not_encoded_again_for_marks(path):
    own, given = Codec(path), []
    many = own._many
    own._many = lambda joined: given.append(joined) or many(joined)
    own.learn({b"quarrystone", b"and"})
    own.learn({b"quarrystone,", b"quarrystone.)", b"and."})
    assert sum(b"quarrystone" in x for x in given) == 1
    assert set(own.words) == {b"quarrystone", b"and", b"quarrystone,", b"quarrystone.)", b"and."}


def test_marked_words_as_the_library_gives_them(path):
    own, rng = Codec(path), random.Random(5)
    assert own.parted
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    words = [c + m for c in ("a", "I", "Stone", "unbelievably", "xqzt", "endoftext", "s", "it's", "caf\u00e9", "x1") for m in (*marks, "),", "...", "!!", ">|", "|>", "'s", "'", "<|endoftext|>")]
    words += ["".join(rng.choice("abcXYZ") for _ in range(rng.randint(1, 9))) + "".join(rng.choice(marks) for _ in range(rng.randint(1, 3))) for _ in range(3000)]
    own.learn({w.encode() for w in words})
    for w in words:
        ids = own.tok.encode(w, add_special_tokens=False).ids
        assert own.words[w.encode()] == (" ".join(map(str, ids)).encode(), own.decode(ids).encode()), w
