import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
from pulsewarden.llm import suffix_dedup as s


def brute(docs, length):
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        hit = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                hit[k : k + length] = True
        hit = hit[: len(r)]
        kept = bytes(b for b, h in zip(r, hit) if not h)
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((i, len(r), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, n=60):
    text = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    shared = [text(rng.randint(20, 120)) for _ in range(6)]
    docs = []
    for k in range(n):
        parts = [text(rng.randint(0, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        docs.append((k, "".join(parts)))
    base = text(300)
    for k in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(300)] = rng.choice("xyz")
        docs.append((100 + k, "".join(copy)))
    return docs + [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 200), (204, docs[3][1]), (204, docs[3][1]), (205, "z" + docs[3][1]), (206, "q" * 19), (207, text(40000)), (207, "other"), (None, docs[5][1])]


@pytest.mark.parametrize("length,split_over", [(20, 2000), (50, 2000), (50, 3)])
def test_against_all_strings(spark, length, split_over):
    docs = corpus(random.Random(length))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, hash string, spans int")
    got = s.dedup(frame, length=length, split_over=split_over).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, length)
    assert s.dedup(frame.limit(0), length=length).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab"), min_size=12, max_size=200), st.integers(4, 12), st.sampled_from([0, 8, 16]))
def test_sort(text, length, shallow):
    raw = text.encode()
    starts = np.arange(len(raw) - length + 1)
    seen = Counter(raw[k : k + length] for k in starts)
    assert s.repeated(raw, starts, length, shallow).tolist() == [seen[raw[k : k + length]] > 1 for k in starts]
