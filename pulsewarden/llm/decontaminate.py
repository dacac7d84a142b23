"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the benchmark items are the alphabet. A suffix automaton over all items
recognises every run of words that occurs in some item; streaming a document's words through it tracks,
at each word, the longest run ending there that some item contains. Words covered by matches of at least
`window` words (or by whole items that are shorter) are hit.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pulsewarden.llm import shared, words

SPANS = "array<struct<first:int,last:int>>"


class Automaton:
    """Generalised suffix automaton over lists of word numbers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.size: list[int] = [0]

    def _state(self, size: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q that holds only its runs as short as p's longest run and one word more."""
        twin = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
        new = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
        return new

    def add(self, item: list[int]) -> None:
        last = 0
        for word in item:
            last = self.extend(last, word)

    def walk(self, stream: list[int]):
        """Yield (state, longest matching length) after each word."""
        state = length = 0
        following, link, size = self.next, self.link, self.size
        for word in stream:
            while state and word not in following[state]:
                state = link[state]
                length = size[state]
            to = following[state].get(word)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            yield state, length


class Matcher(NamedTuple):
    """What a task needs: the vocabulary, the adjacent word pairs, the automaton and its marks."""

    window: int
    least: int  # words in the shortest window
    vocabulary: np.ndarray
    pairs: np.ndarray
    automaton: Automaton
    full: dict[int, tuple[int, ...]]  # state of a window-long run -> items that contain it
    short: dict[int, tuple[tuple[int, int], ...]]  # state -> (length, item) of short whole items in it
    items: list
    spelled: list[bytes]  # the words of the vocabulary


def build(items: list[tuple[object, str | None]], window: int) -> Matcher | None:
    """A matcher for (item id, text) pairs, or None if no item has words. Repeated ids are one item."""
    joined = pa.array([text for _, text in items], pa.large_string())
    data, offsets = shared.utf8(joined)
    split = words.split(data, offsets)
    if not len(split.start):
        return None
    vocabulary, at, numbers = np.unique(split.hash, return_index=True, return_inverse=True)
    low = words.LOWER[data].tobytes()
    spelled = [low[a:b] for a, b in zip(split.start[at].tolist(), split.end[at].tolist())]
    if len(vocabulary) != len({low[a:b] for a, b in zip(split.start.tolist(), split.end.tolist())}):
        raise ValueError("two words of the items have one hash")
    streams = [numbers[a:b].tolist() for a, b in zip(split.rows[:-1], split.rows[1:])]
    automaton = Automaton()
    for stream in streams:
        automaton.add(stream)
    full: dict[int, set[int]] = {}
    short: dict[int, set[tuple[int, int]]] = {}
    for n, stream in enumerate(streams):
        for at, (state, length) in enumerate(automaton.walk(stream), 1):
            if length >= window:
                full.setdefault(_suffix(automaton, state, window), set()).add(n)
            if at == len(stream) < window:
                short.setdefault(state, set()).add((at, n))
    pairs = np.unique([a * len(vocabulary) + b for s in streams for a, b in zip(s, s[1:])] or [-1]).astype(np.int64)
    least = min(min(len(s), window) for s in streams if s)
    return Matcher(window, least, vocabulary, pairs, automaton, {k: tuple(v) for k, v in full.items()},
                   {k: tuple(v) for k, v in short.items()}, [item for item, _ in items], spelled)


def _suffix(automaton: Automaton, state: int, length: int) -> int:
    """The state that holds the last `length` words of what led to `state`."""
    while automaton.size[automaton.link[state]] >= length:
        state = automaton.link[state]
    return state


def _among(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return at, sorted_values[at] == x


def match(matcher: Matcher, split: words.Words, data: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """([(row, first hit word, last hit word)], [(row, item number)]) of a chunk of bytes; spans are merged.

    Words are looked up by their hashes; those of the stretches that may match are compared with the items' by their bytes. Only stretches whose adjacent word pairs all occur in items can match more than one word, so the
    automaton starts anew at each such stretch and skips the rest.
    """
    number, known = _among(matcher.vocabulary, split.hash)
    number = np.where(known, number, -1)
    n = len(number)
    if not n:
        return [], []
    _, chained = _among(matcher.pairs, number[:-1].astype(np.int64) * len(matcher.vocabulary) + number[1:])
    chained &= known[:-1] & known[1:]
    opens = split.rows[1:-1]
    chained[opens[(opens > 0) & (opens < n)] - 1] = False
    begins = np.flatnonzero(known & ~np.append(False, chained))
    ends = np.flatnonzero(known & ~np.append(chained, False)) + 1
    long_enough = ends - begins >= matcher.least
    begins, ends = begins[long_enough], ends[long_enough]
    rows = np.searchsorted(split.rows, begins, "right") - 1
    for begin, end in zip(begins.tolist(), ends.tolist()):
        for k in range(begin, end):
            if words.LOWER[data[split.start[k] : split.end[k]]].tobytes() != matcher.spelled[number[k]]:
                number[k] = -1
    spans: list[tuple[int, int, int]] = []
    found: set[tuple[int, int]] = set()
    automaton, window = matcher.automaton, matcher.window
    for row, begin, end in zip(rows.tolist(), begins.tolist(), ends.tolist()):
        base = int(split.rows[row])
        for at, (state, length) in enumerate(automaton.walk(number[begin:end].tolist()), begin - base):
            cover = 0
            if length >= window:
                cover = window
                found.update((row, item) for item in matcher.full[_suffix(automaton, state, window)])
            if matcher.short:
                up, reach = state, length
                while up > 0:
                    for size, item in matcher.short.get(up, ()):
                        if size <= reach:
                            cover = max(cover, size)
                            found.add((row, item))
                    up = automaton.link[up]
                    reach = automaton.size[up]
            if cover:
                first = at - cover + 1
                while spans and spans[-1][0] == row and spans[-1][2] >= first - 1:
                    first = min(first, spans.pop()[1])
                spans.append((row, first, at))
    return spans, sorted(found)


def _scan(text_column: str, id_type: pa.DataType, shards: list, remove: bool):
    schema = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(id_type)),
              ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
              ("cleaned", pa.string()), ("coverage", pa.float64())]

    def run(batches):
        matchers = [s.value for s in shards]
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_column))
            out = {name: [] for name, _ in schema}
            for low, high, data, offsets in shared.chunks(*shared.utf8(column)):
                split = words.split(data, offsets)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(high - low)]
                items: list[set] = [set() for _ in range(high - low)]
                for matcher in matchers:
                    hits, found = match(matcher, split, data)
                    for row, first, last in hits:
                        spans[row].append((first, last))
                    for row, item in found:
                        items[row].add(matcher.items[item])
                for row in range(high - low):
                    merged = merge(spans[row])
                    total = int(split.rows[row + 1] - split.rows[row])
                    hit = sum(b - a + 1 for a, b in merged)
                    out["n_words"].append(total)
                    out["n_hit"].append(hit)
                    out["longest"].append(max((b - a + 1 for a, b in merged), default=0))
                    out["items"].append(sorted(items[row], key=str))
                    out["spans"].append([{"first": a, "last": b} for a, b in merged])
                    out["coverage"].append(hit / total if total else 0.0)
                    text = None
                    if remove and merged:
                        text, start = "", int(offsets[row])
                        base = int(split.rows[row])
                        for a, b in merged:
                            text += bytes(data[start : int(split.start[base + a])]).decode()
                            start = int(split.end[base + b])
                        text += bytes(data[start : int(offsets[row + 1])]).decode()
                    out["cleaned"].append(text)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(out[name], kind) for name, kind in schema)],
                names=[*batch.schema.names, *(f"__{name}" for name, _ in schema)],
            )

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed word spans."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def find(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = 10, keep: tuple[str, ...] = (), remove: bool = False,
         shard_bytes: int = 32 << 20) -> DataFrame:
    """Per document: its id and kept columns, n_words, n_hit, longest, items, spans, cleaned, coverage (each after `__`).

    The benchmark is a stated query set: it is read to the driver in shards of at most `shard_bytes` of
    text, one automaton each; the broadcast stays in proportion to it and never grows with the documents.
    Null and empty texts have no words and no hits; items without words never match; repeated rows of
    either table are handled as they stand; extra columns are ignored unless named in `keep`.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text_col)), F.lit(0))).head()[0]
    count = max(1, -(-total // shard_bytes))
    shards = []
    for shard in range(count):
        part = benchmark.select(F.col(item_col), F.col(item_text_col))
        if count > 1:
            part = part.where(F.pmod(F.xxhash64(item_text_col), F.lit(count)) == shard)
        matcher = build([tuple(r) for r in part.collect()], window)
        if matcher:
            shards.append(spark.sparkContext.broadcast(matcher))
    item_type = benchmark.schema[item_col].dataType.simpleString()
    columns = list(dict.fromkeys([id_col, *keep, text_col] if remove else [id_col, *keep]))
    read = docs.select(*[F.col(c) for c in dict.fromkeys([*columns, text_col])])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema)
    schema += f", __n_words long, __n_hit long, __longest long, __items array<{item_type}>, __spans {SPANS}, __cleaned string, __coverage double"
    scanned = read.mapInArrow(_scan(text_col, to_arrow_type(benchmark.schema[item_col].dataType), shards, remove), schema)
    return scanned if remove else scanned.drop(*({text_col} - set(columns)))


def clean(docs: DataFrame, benchmark: DataFrame, *, max_coverage: float = 0.5, window: int = 10, id_col: str = "doc_id",
          text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Documents without their hit spans; a document whose hit words exceed `max_coverage` of its words goes.

    Columns are those of docs; the length column follows the new text.
    """
    columns = docs.columns
    plain = {c: f"c{k}" for k, c in enumerate(columns)}
    text = plain[text_col]
    found = find(docs.toDF(*plain.values()), benchmark, window=window, id_col=plain[id_col], text_col=text, keep=tuple(plain.values()), remove=True)
    out = found.where(F.col("__coverage") <= max_coverage).withColumn(text, F.coalesce("__cleaned", text))
    if length_col in columns:
        length = plain[length_col]
        out = out.withColumn(length, F.when(F.col("__n_hit") > 0, F.length(text)).otherwise(F.col(length)).cast(docs.schema[length_col].dataType))
    return out.select(*[F.col(name).alias(c) for c, name in plain.items()])


def digest(found: DataFrame) -> DataFrame:
    """The result of the query: counts, the matched items' digest and the verdict. Items without an id hit, but are not listed."""
    items = F.array_compact("__items")
    named = F.concat_ws(",", F.array_sort(F.transform(items, lambda x: x.cast("string"))))
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"),
                        F.size(items).cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"),
                        (F.col("__n_hit") > 0).alias("contaminated"), F.col("__longest").alias("longest_span"))
