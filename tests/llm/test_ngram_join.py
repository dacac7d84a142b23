import random
import re

import pytest

from pulsewarden.llm import ngram_join as j
from pulsewarden.llm.components import components


def grams(text, n=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, min(1, len(w))))}


def brute(docs, threshold=0.8):
    sets = {i: grams(t) for i, t in docs}
    links = {i: set() for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in ids:
        group, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        out[i] = (min(group), min((k for k in ids if sets[k] == sets[i] and sets[i]), default=i), len(sets[i]), len(links[i]))
    return out


def corpus(rng, bases=12, size=90):
    docs, words = [], [f"w{k}" for k in range(400)]
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(size)] = rng.choice(words)
            docs.append((len(docs), " ".join(copy)))
    return docs + [(9001, None), (9002, ""), (9003, "One two"), (9004, "one, TWO"), (9005, "é " * 30000), (9006, "é " * 30001)]


@pytest.mark.parametrize("block_rows", [400, 7])
def test_against_all_pairs(spark, block_rows):
    docs = corpus(random.Random(3))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, id string, links int")
    got = {r.doc_id: (r.class_id, r.set_id, r.n_grams, r.n_links) for r in j.join(frame, block_rows=block_rows, recall=0.9999).collect()}
    assert got == brute(docs)


def test_keep_one_and_empty(spark):
    docs = corpus(random.Random(4), 4)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(None, "null id", "x")], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in j.keep_one(frame, recall=0.9999).collect()}
    assert kept == {c for c, *_ in brute(docs).values()} | {None}
    assert j.join(frame.limit(0)).collect() == []


def test_bands():
    bands, rows = j.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 256


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_repeated_id_with_other_text(spark):
    """An id that stands with two texts links neither the texts nor their copies, and loses no link."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b + " more")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_grams): (r.class_id, r.n_links) for r in j.join(frame).collect() if r.doc_id != 1}
    assert got == {(2, 36): (2, 1), (3, 36): (3, 2), (4, 37): (3, 2)}
    assert sorted(r.class_id for r in j.join(frame.where("doc_id = 1")).collect())[1] < 0
    assert sorted(map(tuple, j.keep_one(frame).collect())) == [(1, a), (1, b)]


def test_defaults_find_every_link_of_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = sorted(((i, grams(t)) for i, t in docs.select("doc_id", "text").collect()), key=lambda x: len(x[1]))
    want = {i: 0 for i, _ in sets}
    for k, (a, left) in enumerate(sets):
        for b, right in sets[k + 1 :]:
            if 0.8 * len(right) > len(left):
                break
            common = len(left & right)
            if left and common >= 0.8 * (len(left) + len(right) - common):
                want[a] += 1
                want[b] += 1
    assert sum(want.values()) > 100
    assert {r.doc_id: r.n_links for r in j.join(docs).collect()} == want
