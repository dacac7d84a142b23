"""WARC archives compressed record by record with a Zstandard dictionary.

A dictionary is built from a bounded sample of the records to be archived. Each archive starts with it in a
skippable frame (magic 0x184D2A5D), followed by one Zstandard frame per record, so that any record can be read
alone once the dictionary is known. Payloads seen before become revisit records.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewarden.llm import shared

DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def header(page_id: int, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """The fields of a WARC/1.1 record whose payload has `size` bytes: a response, or a revisit if refers_to is given."""
    kind = "response" if refers_to is None else "revisit"
    target = "".join(c if " " < c < "\x7f" else f"%{b:02X}" if len(c.encode()) == 1 else "".join(f"%{x:02X}" for x in c.encode()) for c in url or "" for b in [ord(c)])
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target or 'about:blank'}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {size if refers_to is None else 0}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without it."""
    return header(page_id, url, len(payload), digest, refers_to) + (payload if refers_to is None else b"") + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of a record; raises if it is not whole."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    return fields, rest[:size]


def leading_frame(dictionary: bytes) -> bytes:
    """The skippable frame that carries the dictionary, compressed if that makes it smaller."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    content = packed if dictionary and len(packed) < len(dictionary) else dictionary
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def read_dictionary(raw: bytes) -> tuple[bytes, int]:
    """(dictionary, where the records begin) of an archive's bytes."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    content = raw[8 : 8 + size]
    if content[:4] == b"\x28\xb5\x2f\xfd":
        content = zstandard.ZstdDecompressor().decompress(content)
    return content, 8 + size


def train(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", rows: int = 2000, row_bytes: int = 16384, size: int = 64 << 10) -> bytes:
    """A dictionary of about `size` bytes from at most `rows` of the records to be archived, of each its header and `row_bytes` bytes of its payload.

    The records are the responses whose payloads hash lowest, each payload once under its smallest id; hashes are ranked before any payload
    moves; only the dictionary's sample is cut, never an archived record. With too few records for training, the records themselves are the dictionary.
    """
    at, payload = F.xxhash64(payload_col), F.col(payload_col).cast("binary")
    some = pages.where(F.octet_length(payload_col) > 0)
    lowest = some.select(at.alias("at")).distinct().orderBy("at").limit(rows).agg(F.max("at")).head()[0]
    ids = some.where(at <= (lowest or 0)).select(at.alias("at"), F.col(id_col).cast("long").alias("id"))
    first = ids.groupBy("at").agg(F.min("id").alias("id"))
    held = some.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), at.alias("at"))
    same = held.join(F.broadcast(first), (held["at"] == first["at"]) & held["id"].eqNullSafe(first["id"]), "left_semi")
    chosen = same.select("at", "id", "url", F.substring("payload", 1, row_bytes).alias("head"), F.octet_length("payload").alias("size"), F.sha2("payload", 256).alias("digest"))
    found = chosen.groupBy("at").agg(F.min(F.struct("id", "url", "head", "size", "digest")).alias("one")).orderBy("at").select("one.*").collect()
    samples = [header(-(1 << 63) if r.id is None else r.id, r.url, r.size, r.digest, None) + bytes(r.head) for r in found]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def plan(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses.

    Of records with equal payloads of at least `least` bytes that with the smallest id is the response; rows
    that repeat it are responses too. Digests are counted before anything is joined, and only digests that
    occur twice or more go into the join, where a very common one is dealt out as any skewed key.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), payload.alias("payload")).where(F.octet_length("payload") >= least)
    first = narrow.select("page_id", F.sha2("payload", 256).alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(first, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, *, level: int = 3, archive_bytes: int = 256 << 20, **columns) -> DataFrame:
    """Write archives in the shared folder; return the manifest (path, n_records, bytes).

    Null payloads are empty, null urls become about:blank, a null id is written as the smallest long. An
    archive is closed once it holds `archive_bytes`; only archives that the committed manifest lists count.
    """
    spark = pages.sparkSession
    shared.small_batches(spark)
    dictionary = spark.sparkContext.broadcast(train(pages, **{k: v for k, v in columns.items() if k != "least"}))
    folder = shared.shared_folder(spark, "warc")

    def store(batches):
        fs, root = shared.filesystem(folder)
        fs.create_dir(root, recursive=True)
        prepared = zstandard.ZstdCompressionDict(dictionary.value, dict_type=zstandard.DICT_TYPE_AUTO)
        prepared.precompute_compress(level=level)
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=prepared, write_checksum=True)
        stream, name, count, size = None, "", 0, 0

        def close():
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count]), pa.array([size])], names=["path", "n_records", "bytes"])

        for batch in batches:
            ids, urls, payloads, digests, refers = (batch.column(k) for k in range(5))
            for row in range(batch.num_rows):
                if stream is None:
                    name, count = f"pages-{uuid.uuid4().hex}.warc.zst", 0
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                    head = leading_frame(dictionary.value)
                    stream.write(head)
                    size = len(head)
                page_id = ids[row].as_py()
                frame = squeeze.compress(record(-(1 << 63) if page_id is None else page_id, urls[row].as_py(), payloads[row].as_py(), digests[row].as_py(), refers[row].as_py()))
                stream.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= archive_bytes:
                    yield close()
                    stream = None
        if stream is not None:
            yield close()

    return shared.cut(plan(pages, **columns).mapInArrow(store, "path string, n_records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record in the archives.

    Responses are checked: the payload must have the length and digest that the record states.
    """
    import hashlib

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = shared.filesystem(path)
                with fs.open_input_file(name) as stream:
                    raw = stream.read()
                dictionary, at = read_dictionary(raw)
                expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO))
                out = []
                while at < len(raw):
                    one = expand.decompressobj()
                    whole = one.decompress(raw[at : at + 4096])
                    at = min(at + 4096, len(raw))
                    while not one.eof:
                        whole += one.decompress(raw[at : at + 65536])
                        at = min(at + 65536, len(raw))
                    at -= len(one.unused_data)
                    fields, block = parse(whole)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(fields["X-Payload-Length"])
                    refers = fields.get("WARC-Refers-To")
                    if refers is None and (len(block) != size or hashlib.sha256(block).hexdigest() != digest):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                    out.append((int(fields["WARC-Record-ID"][10:-1]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], int(refers[10:-1]) if refers else None))
                if out:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def digest(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM r
"""
