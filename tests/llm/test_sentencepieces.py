import hashlib
import random

import public_tokenizers
import pytest

from pulsewarden.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    model = sentencepieces.processor(PATH)
    out = []
    for doc, text in rows:
        ids = model.encode(text or "")
        out.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in sentencepieces.digest(sentencepieces.encode(docs, PATH), PATH).collect()), key=str)


def made(n):
    rng = random.Random(n)
    letters = [*"ab  ▁\n\t.éß漢\x00", "  ", "the", "<s>", "\U0001f600", "é"]
    return [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for k in range(n)]


EDGES = [(900, None), (901, ""), (902, " "), (903, "▁"), (904, "▁▁a"), (905, "   "), (None, "no id"), (906, "twice"), (906, "twice"), (907, "a" * 3000), (908, "ab cd " * 30000)]


def test_as_the_library_does(spark):
    rows = made(300) + EDGES
    assert got(spark, rows) == brute(rows)


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(sentencepieces, "BLOCK", 250)
    monkeypatch.setattr(sentencepieces, "STRETCH", 80)
    rows = made(80) + EDGES
    assert got(spark, rows) == brute(rows)


def test_round_trip_and_empty_table(spark):
    rows = [(k, t) for k, t in made(60) if "▁" not in t]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS asked", "3 AS block")
    back = sentencepieces.decode(sentencepieces.encode(docs, PATH), PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(rows)
    assert got(spark, []) == []


def test_each_distinct_chunk_is_segmented_once(spark, monkeypatch):
    seen = []
    real = sentencepieces._bucketed
    monkeypatch.setattr(sentencepieces, "_bucketed", lambda *given: seen.append(real(*given)) or seen[-1])
    monkeypatch.setattr(sentencepieces, "BLOCK", 50)
    monkeypatch.setattr(sentencepieces, "STRETCH", 20)
    got(spark, [(k, "the same words in every text") for k in range(200)])
    assert seen[0].count() > 1 and sentencepieces._answers(seen[0], PATH).selectExpr("sum(new)").head()[0] == 6


def test_a_model_that_normalises_is_refused(monkeypatch):
    class Upper:
        get_piece_size, id_to_piece = (lambda self: 1), (lambda self, k: "a")
        encode, decode = (lambda self, t: [t]), (lambda self, x: x[0].upper())

    import sentencepiece

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_file: Upper())
    with pytest.raises(ValueError):
        sentencepieces.processor("other")
