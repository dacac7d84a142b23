"""SentencePiece ids through a table of distinct chunks.

A chunk is a run of white space markers with what follows up to the next marker. No piece of the vocabulary has a marker
after another character (this is checked), so merges never cross chunks, and the ids of a text are those of its chunks.

Documents are cut into chunks block by block; a block holds its distinct chunks once and its texts as numbers of these.
Distinct chunks are dealt out by hash into `parts`, so all blocks' uses of a chunk meet in one task, which keeps the table
of its part: it has the library segment each chunk once and answers every block that asks. The answers go back to their
blocks, whose numbers are replaced by ids. A chunk is asked for once a block, however often it stands there, so common
words are no hot keys. Blocks are a table bucketed by block, so only questions and answers are shuffled, packed and compressed.

Null texts are empty and have no ids; repeated rows are each encoded; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewarden.llm import shared, words

MARK = "▁"
_MARK = np.frombuffer(MARK.encode(), np.uint8)
#: Bytes of text of a block, and of the stretches in which it is cut and put together, whose arrays take some 30 times that.
BLOCK, STRETCH = 16 << 20, 2 << 20

_of_worker: dict[str, object] = {}


def processor(path: str):
    """The library's processor of this process, checked for what chunks rely on."""
    if path not in _of_worker:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        inner = [p for p in (model.id_to_piece(k) for k in range(model.get_piece_size())) if MARK in p.lstrip(MARK)]
        probes = ["a  b", " a", "a ", "éé ﬁ　x", "A\tb\nc"]
        if inner or any(model.decode(model.encode(p)) != p for p in probes) or model.encode(MARK + "a") != model.encode(" a"):
            raise ValueError("pieces cross white space markers, or texts are normalised: chunks cannot be told apart")
        _of_worker[path] = model
    return _of_worker[path]


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct chunks, number of each chunk in order, chunks of each row) of texts in UTF-8.

    A chunk is written as a text whose own encoding has the same ids: the library puts a marker in front of a text, so its
    first one is left out.
    """
    n = len(data)
    literal = np.zeros(n + 3, bool)
    if n >= 3:
        literal[: n - 2] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    marker = (data == 32) | literal[:n]
    # Bytes that belong to a marker: the blank itself or the three bytes of a literal one.
    covered = marker.copy()
    covered[1:] |= literal[: max(n - 1, 0)]
    covered[2:] |= literal[: max(n - 2, 0)]
    before = np.zeros(n, bool)
    before[1:] = covered[:-1]
    # The first chunk of a row takes the markers in front of it as well, as it begins with the library's own.
    starts = first | (marker & ~before)
    at = np.flatnonzero(starts)
    led = marker[at] & ~first[at]
    width = np.where(led, np.where(literal[at], 3, 1), 0)
    begin, end = at + width, np.append(at[1:], n)[: len(at)]
    length = end - begin
    until = np.zeros(len(at) + 1, np.int64)
    np.cumsum(length, out=until[1:])
    keep = np.ones(n, bool)
    keep[at[width >= 1]] = False
    wide = at[width == 3]
    keep[wide + 1] = keep[wide + 2] = False
    coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(until), pa.py_buffer(data[keep])).dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    return coded.dictionary, numbers, np.diff(np.searchsorted(at, offsets))


def _packed(sizes: np.ndarray, data: np.ndarray) -> bytes:
    """Compressed: how many sizes, the sizes, the data."""
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(sizes)).tobytes() + sizes.astype("<u4").tobytes() + data.tobytes())


def _unpacked(raw) -> tuple[np.ndarray, memoryview]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u4", n, 4), memoryview(raw)[4 + 4 * n :]


def _blocks(parts: int):
    """A block's name is made of its partition and place, so a task that runs again makes the same rows.

    Its distinct chunks are listed part by part, and numbered in that order.
    """
    kind = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("numbers", pa.binary()), ("asked", pa.list_(pa.binary()))])

    def run(batches):
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32

        def block(held) -> pa.RecordBatch:
            ids, sizes, numbers, chunks = zip(*held)
            merged = pa.chunked_array(chunks).combine_chunks().dictionary_encode()
            chunks, among = merged.dictionary, merged.indices.to_numpy(zero_copy_only=False)
            edge = np.cumsum([0, *(len(x[3]) for x in held)])
            spelled, at = shared.utf8(chunks)
            part = (words.word_hash(spelled, at[:-1], at[1:]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            told = np.concatenate([place[among[a:b]][n] for a, b, n in zip(edge[:-1], edge[1:], numbers)])
            spelled, at = shared.utf8(chunks.take(pa.array(order)))
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            asked = [_packed(np.diff(at[a : b + 1]), spelled[at[a] : at[b]]) if b > a else None for a, b in zip(edge[:-1], edge[1:])]
            row = [name, [i for x in ids for i in x.to_pylist()], _packed(np.concatenate(sizes), told.astype("<u4")), asked]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, kind)], schema=kind)

        held, size = [], 0
        for batch in batches:
            for low, high, data, offsets in shared.chunks(*shared.utf8(batch.column(1)), STRETCH):
                chunks, numbers, sizes = chunked(data, offsets)
                held.append((batch.column(0).slice(low, high - low), sizes, numbers, chunks))
                size += len(data)
                if size >= BLOCK:
                    yield block(held)
                    held, size, name = [], 0, name + 1
        if held:
            yield block(held)

    return run


def _segment(path: str):
    """The ids of each list of chunks, from the table of the parts that this task has; `new` chunks were segmented for it."""

    def run(batches):
        model, table = processor(path), {}
        kind = _id_kind(model)
        # An empty chunk stands for the marker alone, which the library does not put in front of an empty text.
        alone = model.piece_to_id(MARK)
        for batch in batches:
            for k in range(batch.num_rows):
                size, spelled = _unpacked(batch.column(2)[k].as_buffer())
                at = np.append(0, np.cumsum(size, dtype=np.int64)).tolist()
                asked = [str(spelled[a:b], "utf-8") for a, b in zip(at[:-1], at[1:])]
                new = [c for c in asked if c not in table]
                table.update(zip(new, (np.array(x or [alone], kind).tobytes() for x in model.encode(new, num_threads=1))))
                coded = [table[c] for c in asked]
                length = np.fromiter(map(len, coded), np.int64, len(coded)) // np.dtype(kind).itemsize
                answer = _packed(length, np.frombuffer(b"".join(coded), kind))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([answer]), pa.array([len(new)])], names=["block", "part", "coded", "new"])

    return run


def _id_kind(model) -> str:
    return "<u2" if model.get_piece_size() <= 1 << 16 else "<u4"


def _answers(blocks: DataFrame, model_path: str) -> DataFrame:
    """(block, part, coded, new): of each block and part the ids of its chunks."""
    asked = blocks.select("block", F.posexplode("asked").alias("part", "asked")).where(F.col("asked").isNotNull())
    return asked.repartition("part").mapInArrow(_segment(model_path), "block long, part int, coded binary, new long")


def encode(docs: DataFrame, model_path: str, *, parts: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of encoded documents: ids (of documents), sizes (token counts, int32 little-endian), tokens (int32 little-endian).

    A task holds the distinct chunks of its share of the `parts`; corpora of many terabytes want more of these.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    kind = _id_kind(processor(model_path))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = texts.mapInArrow(_blocks(parts), "block long, ids array<long>, numbers binary, asked array<binary>")
    blocks = _bucketed(made, "block")
    answers = _answers(blocks, model_path)
    joined = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "coded"))).alias("table"))
    rows = blocks.drop("asked").join(joined.select("block", F.col("table.coded").alias("coded")), "block", "left")
    return rows.select("ids", "numbers", "coded").mapInArrow(_placed(kind), "ids array<long>, sizes binary, tokens binary")


def _bucketed(rows: DataFrame, column: str) -> DataFrame:
    """rows as a table in the shared folder, bucketed by a column, so that joins on it do not shuffle them again."""
    spark = rows.sparkSession
    name = f"pulsewarden_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, column).option("path", shared.shared_folder(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _placed(kind: str):
    """The ids of each block's chunks in the places of their numbers."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, numbers = _unpacked(batch.column(1)[k].as_buffer())
                numbers = np.frombuffer(numbers, "<u4")
                answers = [_unpacked(x.as_buffer()) for x in (batch.column(2)[k].values if batch.column(2)[k].is_valid else ())]
                length = np.concatenate([n.astype(np.int64) for n, _ in answers]) if answers else np.empty(0, np.int64)
                flat = np.concatenate([np.frombuffer(ids, kind) for _, ids in answers]) if answers else np.empty(0, kind)
                at = np.cumsum(length) - length
                edge = np.append(0, np.cumsum(sizes, dtype=np.int64))
                low = 0
                while low < len(sizes):
                    high = max(low + 1, int(np.searchsorted(edge, edge[low] + STRETCH // 8, "right")) - 1)
                    some = numbers[edge[low] : edge[high]]
                    count = length[some]
                    until = np.cumsum(count)
                    tokens = flat[np.repeat(at[some] - until + count, count) + np.arange(until[-1])] if len(until) else flat[:0]
                    ends = np.append(0, until)[edge[low : high + 1] - edge[low]]
                    ids = pa.array([batch.column(0)[k].values.slice(low, high - low).to_pylist()], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([np.diff(ends).astype("<i4").tobytes()]), pa.array([tokens.astype("<i4").tobytes()])], names=["ids", "sizes", "tokens"])
                    low = high

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Documents from their blocks: doc_id, tokens (int32 little-endian), text as the library decodes them."""

    def run(batches):
        model = processor(model_path)
        for doc, ids in _documents(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": doc, "tokens": [x.tobytes() for x in ids], "text": model.decode([x.tolist() for x in ids], num_threads=1)})

    return encoded.mapInArrow(run, "doc_id long, tokens binary, text string")


def _documents(batches):
    """(document ids, their token arrays) in runs of about a block's size."""
    for batch in batches:
        for k in range(batch.num_rows):
            sizes, tokens = (np.frombuffer(batch.column(c)[k].as_buffer() or b"", "<i4") for c in (1, 2))
            until = np.cumsum(sizes, dtype=np.int64)
            each = [tokens[b - n : b] for n, b in zip(sizes.tolist(), until.tolist())]
            ids = batch.column(0)[k].values
            step = max(1, (1 << 20) * len(each) // max(1, len(tokens)))
            for low in range(0, len(each), step):
                yield ids.slice(low, step), each[low : low + step]


def digest(encoded: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the decoded text in UTF-8)."""

    def run(batches):
        model = processor(model_path)
        names = np.array([str(k) for k in range(model.get_piece_size())], object)
        for doc, ids in _documents(batches):
            texts = model.decode([x.tolist() for x in ids], num_threads=1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": doc, "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": [hashlib.sha256(",".join(names[x]).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts]})

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
