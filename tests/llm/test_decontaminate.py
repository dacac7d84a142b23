import hashlib
import random

from pulsewarden.llm import decontaminate as d
from twins import SWAPPED, THUE_MORSE

DOCS = "doc_id long, text string, lang string, n_words long"
ITEMS = "item_id long, text string, n_words long"

def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> dict:
    """Reference by plain window sets, for tests: doc id -> (n_words, n_hit, n_items, items_sha256)."""
    import re

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    windows: dict[tuple, set] = {}
    for item, text in items:
        w = split(text)
        for at in range(max(len(w) - window + 1, min(1, len(w)))):
            windows.setdefault(tuple(w[at : at + window]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for size in sizes:
            for at in range(len(w) - size + 1):
                if (run := tuple(w[at : at + size])) in windows:
                    hit.update(range(at, at + size))
                    found |= windows[run]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
    return out



def run(spark, docs, items, window=10):
    frame = d.digest(d.find(spark.createDataFrame([(i, t, "en", 7) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS), window=window))
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in frame.collect()}


def test_against_window_sets(spark):
    rng = random.Random(5)
    vocabulary = ["ab", "Cd", "é", "x1", "the"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(1, 16))) for k in range(12)] + [(50, None), (51, ""), (52, "...")]
    docs = [(k, text(rng.randint(0, 80))) for k in range(60)] + [(100, None), (101, ""), (102, "--")]
    docs += [(200 + k, f"zz {t} yy") for k, t in items]
    for window in (4, 10):
        assert run(spark, docs, items, window) == brute(docs, items, window)


def test_long_items_only_and_empty_tables(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = [(1, item), (2, " ".join(item.split()[5:14])), (3, "q " + " ".join(item.split()[5:15]).upper() + ", q"), (4, "word " * 50000)]
    got = run(spark, docs, [(9, item), (10, item)])
    assert got == brute(docs, [(9, item), (10, item)])
    assert got[1][:3] == (30, 30, 2) and got[2][1] == 0 and got[3][:2] == (12, 10)
    assert run(spark, docs, [])[1][1] == 0 and run(spark, [], [(9, item)]) == {}


def test_clean_removes_spans_and_covered_documents(spark):
    item = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, item, "en", 5), (2, f"Before {item}, after " + "z " * 20, "en", 5), (3, "Plain text", "en", 5), (4, None, "en", None)], "doc_id long, text string, lang string, n_chars long")
    rows = {r.doc_id: r for r in d.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(rows) == {2, 3, 4} and rows[2].text.startswith("Before , after z") and rows[2].n_chars == len(rows[2].text)
    assert rows[3].text == "Plain text" and rows[3].n_chars == 5 and rows[4].text is None


def test_words_of_one_pattern_do_not_match(spark):
    docs, items = [(1, SWAPPED), (2, THUE_MORSE)], [(1, THUE_MORSE)]
    assert run(spark, docs, items) == brute(docs, items) and run(spark, docs, items)[1][1] == 0


def test_a_word_with_an_items_hash_is_compared(monkeypatch):
    """Were all hashes of words of a length equal, bytes would still decide."""
    monkeypatch.setattr(d.words, "word_hash", lambda data, start, end: (end - start).astype("u8"))
    matcher = d.build([(1, "a bb ccc")], 3)
    data, offsets = d.shared.utf8(d.pa.array(["x a bb ccc y", "a bb ddd", "q zz ccc"]))
    spans, found = d.match(matcher, d.words.split(data, offsets), data)
    assert spans == [(0, 1, 3)] and found == [(0, 0)]


def test_items_without_id_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3), (2, "c d e f", "y", 4)], "doc_id long, text string, __items string, n_chars long")
    items = spark.createDataFrame([(None, "a b")], "item_id long, text string")
    assert [tuple(r) for r in d.clean(docs, items).collect()] == [(2, "c d e f", "y", 4)]
    row = d.digest(d.find(docs, items)).where("doc_id = 1").head()
    assert row.contaminated and row.n_items == 0 and row.items_sha256 == hashlib.sha256(b"").hexdigest()
