import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsewarden.llm import huffman, shared, token_ids
from pulsewarden.llm.decontaminate import pa
from twins import SWAPPED, THUE_MORSE

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
PIECES = token_ids.Pieces(PATH, most=500)


def encode(texts):
    data, offsets = shared.utf8(pa.array(texts, pa.string()))
    ids, sizes = PIECES.encode(data, offsets, 1)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZeé ',.<|>5\n\t̸́ ſΣ’«ßİ中-!\x1c\x85")) | st.sampled_from(["don't.", "<|endoftext|>x", "a<|startoftext|>", "x,'s", None]), min_size=1, max_size=6))
def test_pieces_equal_whole_texts(texts):
    assert encode(texts) == [WHOLE.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=1500), st.integers(9, 20))
def test_code_round_trip(ids, limit):
    ids = np.array(ids)
    lengths = huffman.code_lengths(np.bincount(ids), limit)
    assert lengths.max() <= limit and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    bits, marks = huffman.encode(ids, huffman.canonical(lengths), lengths)
    counts = np.full(len(marks), huffman.RUN)
    counts[-1] = len(ids) - huffman.RUN * (len(marks) - 1)
    symbol, size = huffman.table(lengths)
    assert (huffman.decode(np.frombuffer(bits, np.uint8), marks, counts, symbol, size) == ids).all()
    assert (huffman.decode(np.frombuffer(bits, np.uint8), marks[-1:], counts[-1:], symbol, size) == ids[-counts[-1] :]).all()


@pytest.mark.parametrize("file_ids", [2_000_000, 40])
def test_files(spark, file_ids):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(["The", "worthless", "thtionble,", "é", "x1"]) for _ in range(rng.randint(0, 30)))) for k in rng.sample(range(1000), 80)]
    docs += [(2000, None), (2001, ""), (2002, "word " * 60000), (2003, "same"), (2003, "same")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, path string")
    manifest = token_ids.write(frame, PATH, file_ids=file_ids, shard_bytes=100_000)
    got = sorted(tuple(r) for r in token_ids.read(manifest).collect())
    start, want = 0, []
    for i, t in sorted(docs, key=lambda x: (x[0], x[1] or "")):
        ids = WHOLE.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_ids.read(token_ids.write(frame.limit(0), PATH)).collect() == []


def test_more_pieces_than_the_worker_holds():
    few = token_ids.Pieces(PATH, most=5)
    for texts in (["one two three"], ["one two three four five six seven eight nine ten one"], ["eleven one two"], [" ".join(f"w{k}" for k in range(300))], ["one w7"]):
        data, offsets = shared.utf8(pa.array(texts))
        assert few.encode(data, offsets, 1)[0].tolist() == WHOLE.encode(texts[0], add_special_tokens=False).ids + [1]


def test_pieces_are_told_apart_by_their_texts():
    assert encode([THUE_MORSE, SWAPPED]) == [WHOLE.encode(t, add_special_tokens=False).ids + [1] for t in (THUE_MORSE, SWAPPED)]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_ids.Pieces(public_tokenizers.path("byte_bpe_50k.json"))
