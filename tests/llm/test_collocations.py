import random
import re
from collections import Counter

import numpy as np
import pytest

from pulsewarden.llm import collocations

KIND = "doc_id long, text string, lang string"


def brute(rows, least, inside, top):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, 6):
                for k in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[k : k + size])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        found = []
        for p, a in often.items():
            if any(100 * b >= inside * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in often.items() if len(q) > len(p)):
                continue
            value, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-value, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], total[lang]))
        for rank, (v, a, p, left, right, n) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -v))
    return sorted(out)


def got(spark, rows, **given):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], KIND)
    return sorted(tuple(r) for r in collocations.collocations(docs, **given).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = []
    for _ in range(120):
        text = "".join(rng.choice(["a", "B", "b", "é", "über", "x1", "the"]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randint(0, 80)))
        made.append((text, rng.choice(["en", "en", "fr", None])))
    return [*made, (None, "en"), ("", None), (" . ,\n", "en"), ("the the the the the the the", "en"), *[("one two three four five six", "de")] * 9]


@pytest.mark.parametrize("least, inside, top", [(3, 100, 2000), (4, 80, 15), (9, 100, 50)])
def test_against_all_phrases(spark, rows, least, inside, top):
    assert got(spark, rows, least=least, inside=inside, top=top) == brute(rows, least, inside, top)


def test_hot_pairs_and_small_chunks_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "HOT_LEAST", 2)
    monkeypatch.setattr(collocations, "HOT_SHARE", 0.0)
    assert got(spark, rows, least=3) == brute(rows, 3, 100, 2000)


def test_full_bitmaps_change_nothing(spark, rows, monkeypatch):
    import numpy as np

    monkeypatch.setattr(collocations, "_bitmap", lambda rows: np.full(1 << (collocations.BITS - 6), -1, np.int64))
    assert got(spark, rows, least=3) == brute(rows, 3, 100, 2000)


def test_hashes_of_phrases_are_those_of_places():
    import numpy as np
    import pyarrow as pa

    t = collocations.tokens(pa.array(["ab cd, ef gh", "ab cd"]), pa.array(["en", None]))
    hashes = next(collocations._phrase_hashes([pa.RecordBatch.from_pydict({"lang": ["en", "en", "und", "en"], "phrase": ["ab", "ab cd", "ab cd", "ef gh"]})])).column(0).to_numpy().view(np.uint64)
    assert hashes.tolist() == [t.hash[0], *(collocations._pair_hash(t.hash, np.array([k]))[0] for k in (0, 4, 2))]


def test_long_text_and_empty_table(spark):
    long = [("ab cd ef " * 50000, "en")]
    assert got(spark, long, least=100) == brute(long, 100, 100, 2000)
    assert got(spark, []) == []


def test_products_pass_64_bits(spark):
    n = 3_000_000_000_000
    found = spark.createDataFrame([("en", "a b", 2, n // 7), ("en", "a", 1, n // 5), ("en", "b", 1, n // 3 + 1)], "lang string, phrase string, size int, f long")
    row = collocations.score(found, spark.createDataFrame([("en", n * 4)], "lang string, n long")).collect()[0]
    assert row.score == 1000 * (n // 7) * (n * 4) // ((n // 5) * (n // 3 + 1)) and (row.l, row.r) == (n // 5, n // 3 + 1)


def test_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame([("x y x y x y", "en", 1, 2, "a", 3)], "text string, lang string, n long, h long, phrase string, pair int")
    assert collocations.collocations(docs, least=2).count() == len(brute([("x y x y x y", "en")], 2, 100, 2000))


def _moved(spark):
    """Bytes and rows that all stages so far wrote for shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    each = [stages.apply(k) for k in range(stages.size())]
    return np.array([sum(s.shuffleWriteBytes() for s in each), sum(s.shuffleWriteRecords() for s in each)])


def test_rare_pairs_of_frequent_words_are_not_moved(spark):
    rng = random.Random(8)
    known = [f"word{k}" for k in range(300)]
    rows = [(" ".join(rng.choices(known, k=300)), "en") for _ in range(1500)] + [("word1 word2 word3", "en")] * 150
    before = _moved(spark)
    assert got(spark, rows) == brute(rows, 100, 100, 2000)
    size, written = _moved(spark) - before
    assert size < 0.4 * sum(len(text) for text, _ in rows) and written < 0.1 * 1500 * 300


def test_pruning_slots_of_any_number_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "WORDS_A_SLOT", 1e-5)
    assert got(spark, rows, least=3) == brute(rows, 3, 100, 2000)
    monkeypatch.setattr(collocations, "HELD", 1)
    assert got(spark, rows, least=3) == brute(rows, 3, 100, 2000)
