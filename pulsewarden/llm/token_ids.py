"""Token ids of documents in binary files of canonical length-limited Huffman codes.

Documents are dealt by ranges of doc_id and tokenised in that order; ids are counted over all documents;
one code for the whole corpus is built from these counts; each task then writes files of coded ids. A file:

    magic, lengths of its four parts, then
    code lengths of all symbols (zlib), document ids (int64), ids per document (uint32), blocks

A block holds BLOCK ids at most: its number of ids, of checkpoints and of bytes, the bit offset of every
256th id, and the bits. Blocks are independent of each other and checkpoints let runs be decoded alone.
Files are written under names of their own and count only when the manifest, a table that Spark commits,
lists them; a task that is run twice leaves a file that nothing refers to.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsewarden.llm import huffman, shared

MAGIC = b"PWIDS\x00\x00\x01"
BLOCK = 1 << 18
#: Bytes of text that are cut into pieces together.
CHUNK = 2 << 20
_SPACE, _ALNUM, _MARK, _STICKY = 0, 1, 2, 3
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _ALNUM
_CLASS[0x80:] = _STICKY
_CLASS[[ord(c) for c in "'<|>"]] = _STICKY


class Pieces:
    """Ids of texts from ids of their pieces, each piece encoded once per worker by the tokenizers library.

    Texts are cut at white space and between ASCII letters or digits and ASCII marks; a splitter that
    drops white space and never joins letters with marks cuts there too. No cut is made next to
    apostrophes, which may start a suffix, next to <, | and >, which may belong to a special token, or next
    to bytes beyond ASCII, where normalisation may look at neighbours. Pieces are known by their texts. Whether a tokenizer
    is such a one is tried on texts that hold every kind of cut; another is refused.

    At most about `most` pieces are held, or the distinct ones of one chunk.
    """

    _TRIED = "Ab1 c2D, e-f(g) x.y/z 12,345.6 it's we'LL <|x|> a\tb\nc\x0bd \x1b~ __k__ #h @i i18n 1st é,ü ß-9 名.x"

    def __init__(self, path: str, most: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._forget()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        whole = self.tokenizer.encode(self._TRIED, add_special_tokens=False).ids
        raw = np.frombuffer(self._TRIED.encode(), np.uint8)
        if self.encode(raw, np.array([0, len(raw)]), 0)[0][:-1].tolist() != whole:
            raise ValueError(f"texts cannot be cut into pieces for {path}")

    def _forget(self):
        self.number: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, texts: list[str]):
        """Encode texts that are not known yet. Words of letters go many at a time where tokens show that they end a word."""
        words = [t for t in texts if t.isalpha()] if self.ends.any() else []
        for low in range(0, len(words), 2000):
            group = words[low : low + 2000]
            flat = np.array(self.tokenizer.encode(" ".join(group), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.ends[flat]) + 1
            if len(stop) == len(group) and stop[-1] == len(flat):
                self._keep(group, np.diff(stop, prepend=0), flat)
        rest = [t for t in texts if t not in self.number]
        if rest:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self._keep(rest, sizes, np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum())))

    def _keep(self, texts: list[str], sizes: np.ndarray, flat: np.ndarray):
        first, total = len(self.number), len(flat)
        while first + len(texts) > len(self.at):
            self.at, self.size = np.concatenate([self.at, self.at * 0]), np.concatenate([self.size, self.size * 0])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.at[first : first + len(texts)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(texts)] = sizes
        self.flat[self.used : self.used + total] = flat
        self.used += total
        self.number.update(zip(texts, range(first, first + len(texts))))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids per row), each row followed by end_id."""
        rows = len(offsets) - 1
        kind = _CLASS[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.concatenate([[_SPACE], kind[:-1]]) if len(data) else kind
        turn = (before == _SPACE) | first[:-1] | ((before ^ kind) == (_ALNUM ^ _MARK)) & (before != _SPACE) & (before != _STICKY) & (kind != _STICKY)
        start = np.flatnonzero((kind != _SPACE) & turn)
        stop = np.concatenate([turn[1:] | (kind[1:] == _SPACE), [True]]) if len(data) else turn
        end = np.flatnonzero((kind != _SPACE) & stop) + 1
        until = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=until[1:])
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(until), pa.py_buffer(data[kind != _SPACE])).dictionary_encode()
        texts = coded.dictionary.to_pylist()
        new = [t for t in texts if t not in self.number]
        if new and len(self.number) + len(new) > self.most:
            self._forget()
            new = texts
        if new:
            self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, texts), np.int64, len(texts))[coded.indices.to_numpy(zero_copy_only=False)]
        size, at = self.size[number], self.at[number]
        until = np.cumsum(size)
        total = int(until[-1]) if len(until) else 0
        ids = self.flat[np.repeat(at - until + size, size) + np.arange(total)] if total else np.empty(0, np.uint32)
        bounds = np.concatenate([[0], until])[np.searchsorted(start, offsets)]
        out = np.full(total + rows, end_id, np.uint32)
        is_end = np.zeros(total + rows, bool)
        is_end[bounds[1:] + np.arange(rows)] = True
        out[~is_end] = ids
        return out, np.diff(bounds) + 1


_of_worker: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    """The worker process's own pieces, which outlive a task."""
    if path not in _of_worker:
        _of_worker[path] = Pieces(path)
    return _of_worker[path]


def _tokenise(path: str, end_id: int, file_ids: int):
    """Rows of about file_ids ids: (shard, seq, doc_ids, sizes, ids), in order."""

    def run(batches):
        from pyspark import TaskContext

        pieces, shard, seq = _pieces(path), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush():
            nonlocal held, count, seq
            docs, sizes, ids = (np.concatenate(x) for x in zip(*held))
            row = [[shard], [seq], [docs.astype("<i8").tobytes()], [sizes.astype("<u4").tobytes()], [ids.astype("<u4" if ids.max() > 0xFFFF else "<u2").tobytes()], [len(docs)], [len(ids)]]
            held, count, seq = [], 0, seq + 1
            names = ["shard", "seq", "docs", "sizes", "ids", "n_docs", "n_ids"]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k in (0, 1, 5, 6) else pa.binary()) for k, x in enumerate(row)], names=names)

        for batch in shared.gathered(batches, CHUNK, 1):
            docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for low, high, data, offsets in shared.chunks(*shared.utf8(batch.column(1)), CHUNK):
                ids, sizes = pieces.encode(data, offsets, end_id)
                held.append((docs[low:high], sizes, ids))
                count += len(ids)
                if count >= file_ids:
                    yield flush()
        if held:
            yield flush()

    return run


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _count(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw, n in zip(batch.column(0), batch.column(1)):
            seen = np.bincount(_ids(raw.as_buffer(), n.as_py()))
            if len(seen) > len(total):
                seen[: len(total)] += total
                total = seen
            else:
                total[: len(seen)] += seen
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def write_file(stream, lengths: np.ndarray, codes: np.ndarray, docs: bytes, sizes: bytes, ids: np.ndarray) -> int:
    """Write one file to an open stream; return its bytes."""
    blocks = []
    for low in range(0, len(ids), BLOCK):
        part = ids[low : low + BLOCK]
        bits, marks = huffman.encode(part, codes, lengths)
        blocks.append(struct.pack("<III", len(part), len(marks), len(bits)) + marks.astype("<u4").tobytes() + bits)
    head = zlib.compress(lengths.tobytes(), 1)
    body = [head, docs, sizes, b"".join(blocks)]
    whole = b"".join([MAGIC, struct.pack("<4Q", *map(len, body)), *body])
    stream.write(whole)
    return len(whole)


_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def read_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids per document, ids) of a file's bytes."""
    if raw[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    parts, at = [], 40
    for size in struct.unpack("<4Q", raw[8:40]):
        parts.append(raw[at : at + size])
        at += size
    head, docs, sizes, blocks = parts
    if head not in _tables:
        _tables.clear()
        _tables[head] = huffman.table(np.frombuffer(zlib.decompress(head), np.uint8))
    out, at = [], 0
    while at < len(blocks):
        n, marks, size = struct.unpack_from("<III", blocks, at)
        starts = np.frombuffer(blocks, "<u4", marks, at + 12)
        bits = np.frombuffer(blocks, np.uint8, size, at + 12 + 4 * marks)
        counts = np.full(marks, huffman.RUN)
        counts[-1] = n - huffman.RUN * (marks - 1)
        out.append(huffman.decode(bits, starts, counts, *_tables[head]))
        at += 12 + 4 * marks + size
    return np.frombuffer(docs, "<i8"), np.frombuffer(sizes, "<u4"), np.concatenate(out) if out else np.empty(0, np.uint32)


def write(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, file_ids: int = 2_000_000, shard_bytes: int = 24 << 20, most_shards: int = 20_000) -> DataFrame:
    """Write all documents' ids; return the manifest (path, start, n_docs, n_ids, bytes), one row a file.

    Files follow ascending id; rows that repeat an id follow each other in the order of their texts. A null
    text is an empty one, whose only id is end_id; a null id is written as the smallest long. Extra columns
    are ignored. Rows that repeat one id, and those without one, are one task's. Only the counts of ids (as many as the
    vocabulary has) and one total for each of at most `most_shards` shards reach the driver; a shard has as many files as it needs.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    dealt = texts.repartitionByRange(min(max(1, -(-total // shard_bytes)), most_shards), "id").sortWithinPartitions("id", "text")
    kind = "shard long, seq long, docs binary, sizes binary, ids binary, n_docs long, n_ids long"
    path = shared.shared_folder(spark, "ids")
    dealt.mapInArrow(_tokenise(tokenizer_path, end_id, file_ids), kind).write.option("compression", "zstd").parquet(path)
    chunks = spark.read.schema(kind).parquet(path)
    counted = chunks.select("ids", "n_ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    lengths = huffman.code_lengths(counts)
    held = spark.sparkContext.broadcast((lengths, huffman.canonical(lengths)))
    folder = shared.shared_folder(spark, "token-files")

    def store(batches):
        lengths, codes = held.value
        fs, root = shared.filesystem(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for row in range(batch.num_rows):
                shard, seq, docs, sizes, ids, n_docs, n_ids = (batch.column(k)[row] for k in range(7))
                name = f"ids-{shard.as_py():06d}-{seq.as_py():06d}-{uuid.uuid4().hex[:8]}.pwids"
                with fs.open_output_stream(f"{root}/{name}", compression=None) as stream:
                    size = write_file(stream, lengths, codes, docs.as_py(), sizes.as_py(), _ids(ids.as_buffer(), n_ids.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard.as_py(), seq.as_py(), f"{folder}/{name}", n_docs.as_py(), n_ids.as_py(), size)], names=["shard", "seq", "path", "n_docs", "n_ids", "bytes"])

    files = shared.cut(chunks.mapInArrow(store, "shard long, seq long, path string, n_docs long, n_ids long, bytes long"), "manifest")
    before, seen = [], 0
    for shard, n in files.groupBy("shard").agg(F.sum("n_ids")).orderBy("shard").collect():
        before.append((shard, seen))
        seen += n
    begins = spark.createDataFrame(before, "shard long, before long")
    earlier = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    out = files.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(begins), "shard")
    return out.select("path", (F.col("before") + F.col("earlier")).alias("start"), "n_docs", "n_ids", "bytes")


def read(manifest: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = shared.filesystem(path)
                with fs.open_input_file(name) as stream:
                    docs, sizes, ids = read_file(stream.read())
                until = np.cumsum(sizes, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((until - sizes).tolist(), until.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(start + until - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shared.small_batches(manifest.sparkSession)
    files = manifest.select("path", "start")
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
