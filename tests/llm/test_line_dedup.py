import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from pulsewarden.llm import line_dedup as d


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, limit, least, every=False):
    taken = lambda line: len(line) >= least or every and line.strip(" \t\n\v\f\r") != ""
    lines = [(i, k, line) for i, t in docs for k, line in enumerate((t or "").split("\n")) if len(line) >= (1 if every else least)]
    first = {}
    for i, k, line in sorted(lines):
        first.setdefault(line, (i, k))
    near = {a for a in first for b in first if len(a) >= least and a != b and first[b] < first[a] and abs(len(a) - len(b)) <= limit and distance(a, b) <= limit}
    out = {}
    for i, t in docs:
        kept, again, close = [], 0, 0
        for k, line in enumerate((t or "").split("\n")):
            repeat = taken(line) and (i, k) != first[line]
            again += repeat
            close += not repeat and line in near
            if not (repeat or line in near):
                kept.append(line)
        out[i] = (len((t or "").split("\n")), again, close, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_within(spark, limit):
    rng = random.Random(limit)
    rows = [("", ""), ("a", ""), ("abc" * 30, "abc" * 30 + "x"), ("é" * 70, "é" * 69 + "e"), ("ab" * 40, "ba" * 40)]
    for _ in range(300):
        a = [rng.choice("abcé") for _ in range(rng.randint(0, 90))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "a"])
        rows.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", d.within(F.col("a"), F.col("b"), limit).alias("w")).collect()
    assert [(r.a, r.b, r.w) for r in got] == [(a, b, distance(a, b) <= limit) for a, b in rows]


@pytest.mark.parametrize("limit,least,every", [(1, 8, False), (2, 8, False), (2, 20, False), (2, 20, True), (2, 8, True), (1, 1, True)])
def test_against_all_pairs(spark, limit, least, every):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 40))) for _ in range(25)]
    docs = []
    for k in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            lines.append("".join(line))
        docs.append((k, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, base[0] + "\n" + "q" * 30000 + "\n" + "r" * 300 + "\n" + "r" * 299), (104, docs[3][1])]
    frame = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, line string, pos int")
    got = {r.doc_id: (r.n_lines, r.n_repeated, r.n_near, r.kept_sha256) for r in d.dedup(frame, limit=limit, least=least, every=every).collect()}
    assert got == brute(docs, limit, least, every)


def test_repeated_rows_and_empty(spark):
    line = "a line that is long enough to count"
    frame = spark.createDataFrame([(1, line), (1, line), (2, line + "\nshort"), (None, line)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_repeated, r.kept) for r in d.dedup(frame).collect()))
    assert [x[0] for x in got] == [0, 1, 1, 2] and got[1] == got[2]
    assert d.dedup(frame.limit(0)).collect() == []


def test_short_lines_repeat_and_serve_as_earlier(spark):
    short, longer = "abcdefghijklmnopqr", "abcdefghijklmnopqrst"
    rows = [(1, "Les.\n\n  "), (2, "Les.\n\n  \nLet."), (3, short), (4, longer + "\n" + short), (5, "z" * 20), (6, "z" * 19 + "\n" + "z" * 18)]
    got = {r.doc_id: (r.n_repeated, r.n_near, r.kept) for r in d.dedup(spark.createDataFrame(rows, "doc_id long, text string"), every=True).collect()}
    assert got[2] == (1, 0, "\n  \nLet.") and got[1][:2] == got[3][:2] == got[5][:2] == (0, 0)
    assert got[4] == (1, 1, "") and got[6] == (0, 0, rows[5][1])


def test_many_lines_of_one_document(spark):
    """Time grows with the lines: 400,000 of one document within a minute."""
    frame = spark.createDataFrame([(1, "Les.\n" * 400_000), (2, "other\nLes.")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_repeated, r.kept) for r in d.dedup(frame, every=True).collect()}
    assert got == {1: (400_001, 399_999, "Les.\n"), 2: (2, 1, "other")} and time.time() - began < 60
