"""Hashes of words and of sequences of words."""

import numpy as np
import pytest

from partloom.llm import neardup, shingles


def thue_morse(power):
    w = "a"
    for _ in range(power):
        w += w.translate({97: 98, 98: 97})
    return w, w.translate({97: 98, 98: 97})


@pytest.mark.parametrize("power", range(8, 15))
def test_words_that_cancel_in_powers_of_two_differ(power):
    a, b = shingles.word_hashes(list(thue_morse(power)))[0].tolist()
    assert a != b


def test_a_hash_depends_on_the_bytes_alone():
    words = sorted(({"x" * n + y for n in range(0, 40) for y in ("", "a", "b", "é", "ab")} | {"ab" * 9, "ba" * 9, "a" * 8 + "b" * 8, "b" * 8 + "a" * 8}) - {""})
    one = {w: int(shingles.word_hashes([w])[0][0]) for w in words}
    assert len(set(one.values())) == len(words)
    text = "  ".join(words * 2)
    assert shingles.word_hashes(["", text, text + " "])[0].tolist() == [one[w] for w in words * 2] * 2


def test_no_words_no_hashes():
    assert shingles.word_hashes(["", "  ", None])[1].tolist() == [0, 0, 0] and len(shingles.hashed(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_documents_of_such_words_are_not_linked(spark):
    a, b = thue_morse(10)
    rows = [(1, f"{a} one two"), (2, f"{b} one two"), (3, f"{a} one two"), (4, b), (5, a)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
