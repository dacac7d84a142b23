import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from pulsewarden.llm import shared, words
from twins import SWAPPED, THUE_MORSE


def split(texts):
    return words.split(*shared.utf8(pa.array(texts, pa.string())))


def test_long_words_of_one_pattern_differ():
    found = split([f"{THUE_MORSE} x", f"{SWAPPED} x", f"y {THUE_MORSE}"])
    assert found.hash[0] != found.hash[2] and found.hash[0] == found.hash[5] and found.hash[1] == found.hash[3]
    one, two = (words.shingles(split([f"{w} x y z w"]), 5)[0] for w in (THUE_MORSE, SWAPPED))
    assert one != two


@given(st.lists(st.lists(st.text("ab\u00e9Z9", min_size=1, max_size=6), max_size=5), min_size=1, max_size=5))
def test_equal_words_and_no_others_have_equal_hashes(rows):
    found = split([" ".join(r) for r in rows])
    plain = [w.replace("Z", "z") for r in rows for w in r]
    assert len(found.hash) == len(plain) and np.diff(found.rows).tolist() == [len(r) for r in rows]
    assert all((found.hash[i] == found.hash[k]) == (plain[i] == plain[k]) for i in range(len(plain)) for k in range(i))


def test_lengths_around_the_block():
    texts = ["a" * n for n in range(1, 300)] + ["a" * n + "b" for n in range(300)] + ["a" * n + "ba" for n in range(255)]
    assert len(set(split(texts).hash.tolist())) == len(texts)
