import itertools
import random
import re

from pulsewarden.llm import filter_audit

KIND = "doc_id long, text string, source string"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text, smaller):
    words = re.findall("[^ \t\n\x0b\x0c\r]+", text)
    out = "A" if len(words) < 50 else ""
    out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
    out += "D" if re.search("[#$%&*|]", text) else ""
    return out + ("E" if smaller else "")


def brute(rows, labels):
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    judged = []
    for doc, text, part in rows:
        text = text or ""
        judged.append((part or "", failed(text, any(doc is not None and d is not None and d < doc and (t or "") == text for d, t, _ in rows)), doc in good, doc in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        here = [x[1:] for x in judged if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x[0] for x in here) - len(gone), sum(x[0] == f for x in here), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(total[key[1][key[2] - 1]])
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame(rows, KIND)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r[m] for m in MEASURES] for r in filter_audit.audit(docs, marks).collect()}
    assert got == brute(rows, labels)


def test_against_every_order(spark):
    rng = random.Random(3)
    pool = ["", None, "word " * 60, "# " * 55, "ABC def " * 40, " ".join(f"w{k}" for k in range(70)), " ".join(f"V{k}" for k in range(60)) + " %", "a\x0bb\x0cc d e", "ÄÖ ß 漢"]
    rows = [(rng.choice([k, k, k, None, 7]), rng.choice([*pool, f"text {k}", " ".join(f"u{k}x{j}" for j in range(55))]), rng.choice(["s1", "s2", "", None])) for k in range(150)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 150, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    check(spark, rows, labels)


def test_copies_over_parts_and_labels(spark):
    rows = [(k, "same text", f"s{k % 3}") for k in range(5, 40)] + [(5, "same text", "s9"), (None, "same text", "s9")]
    check(spark, rows, [(k, k % 2, 1) for k in range(40)])


def test_empty_and_long(spark):
    assert filter_audit.audit(spark.createDataFrame([], KIND), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    check(spark, [(1, "lorem " * 200000, "a"), (2, "x" * 1000000, "a")], [])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "p", 4, 5, 6, 7)], KIND + ", part int, good int, bits int, quality int")
    assert filter_audit.audit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).where("good_lost = 1").count() == 120
