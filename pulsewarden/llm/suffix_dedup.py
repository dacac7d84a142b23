"""Removal of long repeated byte strings by sorting suffixes (deep-shallow).

Two equal strings of `length` bytes pick the same anchor: of the grams (runs of length // 5 bytes) that start in
them, the one whose hash is least, the leftmost of equals. So every string belongs to one anchor, and
an anchor to a block: the bytes of all strings that picked it. Only strings with the same anchor gram
can be equal, which leaves about two suffix groups per `length` bytes to look at instead of one per byte:

1. Anchors are counted by gram; grams that occur once are done.
2. Where all blocks of a repeated gram are the same, all their strings repeat.
3. Blocks of the other repeated grams are fetched, one for each distinct block, and the suffixes of their
   strings are sorted, to `length` bytes, group by group: a multikey sort by words to a shallow depth, then
   a blind trie for each group that still shares its prefix. Strings that meet in one leaf repeat.
4. Repeated strings become byte intervals of documents; their union is removed.

Blocks of a gram with very many different blocks are dealt out in parts, by the distance of their strings from
the anchor, so that no task holds such a gram whole. Identical blocks are counted before they are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewarden.llm import shared, words

#: Bytes sorted word by word before the blind tries take over.
SHALLOW = 32
_SEGMENT_BITS = 23
_POSITION = np.uint64((1 << _SEGMENT_BITS) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, low, high, gram hash, block hash) of the rows' bytes between offsets.

    Strings that start from anchor - high to anchor - low picked the anchor; positions count in data.
    """
    gram = max(1, length // 5)
    found = []
    step = (1 << _SEGMENT_BITS) - length
    for base in range(0, max(len(data), 1), step):
        part = data[base : base + step + length - 1]
        if len(part) < length:
            break
        sums = words.prefix_sums(part)
        at = np.arange(len(part) - gram + 1)
        hashes = words.piece(sums, at, at + gram)
        least = (hashes & ~_POSITION) | at.astype(np.uint64)
        width, span = 1, length - gram + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: -(span - width)], least[span - width :])
        start = np.arange(len(least))
        row = np.searchsorted(offsets, base + start, "right") - 1
        whole = base + start + length <= offsets[row + 1]
        start, row, pick = start[whole], row[whole], (least[whole] & _POSITION).astype(np.int64)
        if len(start):
            opens = np.flatnonzero(np.diff(pick, prepend=-1))
            closes = np.append(opens[1:], len(pick)) - 1
            anchor, high, low = pick[opens], pick[opens] - start[opens], pick[opens] - start[closes]
            block = words.mix(words.piece(sums, anchor - high, anchor - low + length) + high.astype(np.uint64))
            found.append((row[opens], base + anchor, low, high, hashes[anchor], block))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchor_scan(length: int):
    def run(batches):
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            for first, _, data, offsets in shared.chunks(*shared.utf8(batch.column(2))):
                row, anchor, low, high, gram, block = anchors(data, offsets, length)
                inside = anchor - offsets[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(block.view(np.int64)), pa.array(keys[0][first + row]), pa.array(keys[1][first + row]),
                     pa.array(inside), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                    names=["gram", "block", "doc", "hash", "at", "low", "high"],
                )

    return run


def _trie(tails: list[int]) -> list[int]:
    """Leaf of each tail in a blind trie over their bits; equal tails share a leaf.

    A tail goes down by the branching bits alone, is compared once with the leaf it reaches, and is then
    hung in where the first differing bit belongs.
    """
    leaves, out = [tails[0]], [0]
    root: object = 0  # a leaf number, or [bit, zero, one]
    for x in tails[1:]:
        node = root
        while type(node) is list:
            node = node[1 + (x >> node[0] & 1)]
        differ = x ^ leaves[node]
        if not differ:
            out.append(node)
            continue
        bit = differ.bit_length() - 1
        leaf = len(leaves)
        leaves.append(x)
        out.append(leaf)
        parent, side, node = None, 0, root
        while type(node) is list and node[0] > bit:
            parent, side = node, 1 + (x >> node[0] & 1)
            node = node[side]
        new = [bit, node, leaf] if x >> bit & 1 else [bit, leaf, node]
        if parent is None:
            root = new
        else:
            parent[side] = new
    return out


def repeated(data: bytes, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """Which of the strings data[s : s + length] occur at least twice among `starts` (deep-shallow sort).

    Shallow: one 8-byte word at a time, strings are sorted by (group, word) and groups split; single strings
    drop out. Deep: each group that is left goes into a blind trie.
    """
    pool = np.frombuffer(data, np.uint8)
    out = np.zeros(len(starts), bool)
    alive = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    depth = 0
    ahead = np.arange(8)
    while len(alive) and depth + 8 <= min(shallow, length):
        word = pool[(starts[alive] + depth)[:, None] + ahead].view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((word, group))
        alive, group, word = alive[order], group[order], word[order]
        new = np.ones(len(alive), bool)
        new[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group]
        alive, group = alive[size > 1], group[size > 1]
        depth += 8
    if not len(alive):
        return out
    bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        members = alive[a:b]
        leaf = np.array(_trie([int.from_bytes(data[s + depth : s + length], "big") for s in starts[members].tolist()]))
        out[members[np.bincount(leaf)[leaf] > 1]] = True
    return out


def _fetch(length: int, split_over: int):
    """Rows (bucket, gram, block, low, high, bytes) of the blocks asked for in each document.

    Equal strings stand equally far before their anchors. So the blocks of a gram with more than split_over
    of them are dealt out in that many parts by this distance, and if single distances are still too much,
    by a hash of the string's ends as well.
    """
    span = length - max(1, length // 5) + 1

    def run(batches):
        for batch in batches:
            texts = batch.column(0)
            asked = batch.column(1).to_pylist()
            out = []
            for row, wanted in enumerate(asked):
                raw = (texts[row].as_py() or "").encode()
                for w in wanted:
                    at, low, high = w["at"], w["low"], w["high"]
                    parts = min(-(-w["blocks"] // split_over), span)
                    width = -(-span // parts)
                    for first in range(0, span, width):
                        near, far = max(low, first), min(high, first + width - 1)
                        if near > far:
                            continue
                        some = raw[at - far : at - near + length]
                        bucket = w["gram"]
                        if parts > 1:
                            ends = some[: length // 2] + some[-length // 4 :] if w["blocks"] > span * split_over else b""
                            bucket = int.from_bytes(hashlib.blake2b(ends + first.to_bytes(4, "big") + w["gram"].to_bytes(8, "big", signed=True), digest_size=8).digest(), "big", signed=True)
                        out.append((bucket, w["gram"], w["block"], near, far, some))
                if len(out) >= 4096:
                    yield _blocks(out)
                    out = []
            if out:
                yield _blocks(out)

    return run


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["bucket", "gram", "block", "low", "high", "bytes"])


def _sorter(length: int, chunk: int = 1 << 19):
    """Sort the strings of whole buckets, some at a time; rows come ordered by bucket."""

    def strings(table: pa.Table) -> pa.RecordBatch | None:
        low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
        blocks = table.column("bytes").combine_chunks()
        data, offsets = blocks.buffers()[2], np.frombuffer(blocks.buffers()[1], np.int32)[blocks.offset : blocks.offset + len(blocks) + 1].astype(np.int64)
        count = high - low + 1
        owner = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        hit = repeated(data.to_pybytes(), offsets[owner] + inside, length)
        if not hit.any():
            return None
        owner, back = owner[hit], (high[owner] - inside)[hit]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        pick = pa.array(owner[first])
        return pa.RecordBatch.from_arrays(
            [table.column("gram").combine_chunks().take(pick), table.column("block").combine_chunks().take(pick), pa.array(np.minimum.reduceat(back, first).astype(np.int32)), pa.array(np.maximum.reduceat(back, first).astype(np.int32))],
            names=["gram", "block", "near", "far"],
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < chunk:
                continue
            table = pa.Table.from_batches(held)
            bucket = table.column("bucket").to_numpy()
            whole = int(np.searchsorted(bucket, bucket[-1], "left"))
            if whole:
                if (out := strings(table.slice(0, whole).combine_chunks())) is not None:
                    yield out
                held = table.slice(whole).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
        if held and (out := strings(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return run


def _finish(batches):
    """Counts and digest of what is left of each text."""
    for batch in batches:
        texts, spans = batch.column(1), batch.column(2)
        out = []
        for row in range(batch.num_rows):
            raw = (texts[row].as_py() or "").encode()
            kept, end, removed, runs, digest = 0, 0, 0, 0, hashlib.sha256()
            for span in sorted((s["start"], s["end"]) for s in spans[row].as_py() or ()):
                if span[0] > end or not runs:
                    digest.update(raw[end : span[0]])
                    kept += span[0] - end
                    runs += 1
                end = max(end, span[1])
            digest.update(raw[end:])
            removed = end - kept
            out.append((len(raw), removed, runs, digest.hexdigest()))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, split_over: int = 2000) -> DataFrame:
    """(doc, hash, spans): the repeated strings' byte intervals of each (id, text hash) that has any.

    Intervals may overlap. Rows that repeat an id and text are two places of the same strings.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    keyed = _keyed(docs, id_col, text_col)
    kind = "gram long, block long, doc long, hash long, at long, low int, high int"
    found = keyed.where(F.octet_length("text") >= length).select("doc", "hash", "text").mapInArrow(_anchor_scan(length), kind)
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("block").alias("least"), F.max("block").alias("most")).where("n > 1")
    grams = grams.select("gram", (F.col("least") != F.col("most")).alias("mixed"))
    candidates = shared.cut(found.join(grams, "gram"), "anchors")

    same = candidates.where("not mixed").select("doc", "hash", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))
    mixed = candidates.where("mixed")
    one = F.struct("doc", "hash", "at", "low", "high")
    distinct = mixed.groupBy("gram", "block").agg(F.count("*").alias("copies"), F.min(one).alias("one"))
    counted = mixed.groupBy("gram").agg(F.approx_count_distinct("block", 0.05).alias("blocks"))
    asked = distinct.join(counted, "gram").select("one.*", "gram", "block", "blocks")
    asked = asked.groupBy("doc", "hash").agg(F.collect_list(F.struct("gram", "block", "blocks", "at", "low", "high")).alias("asked"))
    texts = keyed.select("doc", "hash", "text").join(asked, ["doc", "hash"])
    blocks = texts.dropDuplicates(["doc", "hash"]).select("text", "asked").mapInArrow(_fetch(length, split_over), "bucket long, gram long, block long, low int, high int, bytes binary")
    ordered = blocks.repartition("bucket").sortWithinPartitions("bucket")
    sorted_ = ordered.mapInArrow(_sorter(length), "gram long, block long, near int, far int")
    whole = distinct.where("copies > 1").select("gram", "block", F.col("one.low").alias("near"), F.col("one.high").alias("far"))
    reach = sorted_.unionByName(whole).groupBy("gram", "block").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    differing = mixed.join(reach, ["gram", "block"]).select("doc", "hash", (F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + length).alias("end"))
    return same.unionByName(differing).groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, split_over: int = 2000) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a `length`-byte string that also starts elsewhere in the table goes, both places
    included. Null texts are empty; texts shorter than `length` keep all; rows that repeat are places
    like any other; extra columns are ignored.
    """
    held = shared.cut(spans(docs, id_col=id_col, text_col=text_col, length=length, split_over=split_over), "spans")
    keyed = _keyed(docs, id_col, text_col)
    joined = keyed.join(held, ["doc", "hash"], "left").select("id", "text", "spans")
    return joined.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
