import hashlib

import zstandard

from pulsewarden.llm import shared, warc

PAGES = "page_id long, url string, html string, digest string"


def brute(rows):
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        back = first[h or ""] if len(b) >= 100 and first[h or ""] != i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if back is None else "revisit", back))
    return sorted(out)


def rows():
    page = "<html><body>" + "é text " * 40
    out = [(k, f"https://h{k % 5}.example/ü {k}\r\nX: y", page + str(k % 7)) for k in range(60)]
    return out + [(100, None, None), (101, "http://a", ""), (102, "http://a", "x"), (103, "http://a", "x"), (104, "u", "\r\n\r\nWARC/1.1 " * 30000), (105, "u", page + "3"), (105, "u", page + "3")]


def test_round_trip(spark):
    frame = spark.createDataFrame([(*r, "x") for r in rows()], PAGES)
    manifest = warc.write(frame, archive_bytes=20_000)
    assert sorted(tuple(r) for r in warc.digest(warc.read(manifest)).collect()) == brute(rows())
    fs, name = shared.filesystem(manifest.head().path)
    raw = fs.open_input_file(name).read()
    dictionary, at = warc.read_dictionary(raw)
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little") and raw[at : at + 4] == b"\x28\xb5\x2f\xfd"
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj()
    assert warc.parse(one.decompress(raw[at:]))[0]["WARC-Type"] in ("response", "revisit")


def test_empty_and_tiny(spark):
    frame = spark.createDataFrame([(*r, "x") for r in rows()], PAGES)
    assert warc.read(warc.write(frame.limit(0))).collect() == []
    one = spark.createDataFrame([(5, "http://a", "only")], "page_id long, url string, html string")
    assert warc.read(warc.write(one)).head().payload_bytes == 4


def test_dictionary_comes_from_archived_records(spark):
    frame = spark.createDataFrame([(9, "http://b/x", "copy"), (5, "http://a/x", "copy"), (5, "http://a/x", "copy"), (None, None, "other"), (7, "http://c", None)], "page_id long, url string, html string")
    digests = {h: hashlib.sha256(h.encode()).hexdigest() for h in ("copy", "other")}
    whole = [warc.record(5, "http://a/x", b"copy", digests["copy"], None), warc.record(-(1 << 63), None, b"other", digests["other"], None)]
    found = warc.train(frame)
    assert sorted(len(x) - 4 for x in whole) == sorted(len(x) for x in found.replace(b"WARC/1.1", b"|WARC/1.1").split(b"|")[1:])
    assert all(x[:-4] in found for x in whole)
    assert len(warc.train(frame, rows=1)) in [len(x) - 4 for x in whole]
