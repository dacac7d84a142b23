"""Phrase collocations by contiguous pattern growth.

Frequent words are counted with map-side sums. Most pairs of these are rare, so pairs, then triples of frequent pairs, are
first counted by slots of their hashes (hash pruning): only slots and counts move, and a phrase can be frequent only if
its slot is. Every place of a pair whose slot is frequent is a pointer into the corpus; it is projected to its pair as the
window of words that may still extend it (five words at most, cut where a triple's slot is not frequent). One task for
each pair then counts it and grows phrases to the right, depth first: it splits the pair's windows by their next word,
keeps the extensions that are frequent and descends into each.

Windows are summed before they move; those of a chunk that go to the same part of the pairs share a row. A pair with many
occurrences (more than `share` of all words) is hot: its windows are dealt out by the whole window, each task grows what
it has without a threshold and the sums decide. Which words and slots are frequent or hot is known in the tasks from
bitmaps of a fixed size; a false hit only costs time, as the final counts decide. Scores are decimals of 38 digits, so
they are exact.

Null texts are empty; a null language is `und`; repeated rows count as often as they stand; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewarden.llm import shared, words

LONGEST = 5
#: Phrases of two words up to this many are counted by slots first.
PRUNED = 3
#: Bits of a bitmap, as a power of two: 8 MB each.
BITS = 26
#: Slots are at least as many as a bitmap's bits and one for so many words, as a power of two, but no more than 2**MOST_BITS.
WORDS_A_SLOT, MOST_BITS = 8, 32
#: Slots of a part, which are summed together: a slot's place in it has 16 bits. Pairs are dealt out by the same parts.
PART_BITS = 16
#: Bytes of windows from which a task grows the parts it holds.
HELD = 4 << 20
#: A pair is hot if it has more than this share of all words, but no fewer and no more than these occurrences.
HOT_SHARE, HOT_LEAST, HOT_MOST = 2.0**-14, 4096, 1 << 20
#: Bytes of text that are counted together in a task; its arrays take some 30 times that.
CHUNK = 6 << 20
#: First ranks are taken in so many parts of a language, so that no task sorts all its phrases.
RANK_PARTS = 64

_WORD, _BLANK, _END = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _BLANK
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _END


class Tokens(NamedTuple):
    langs: pa.Array
    words: pa.Array  # distinct words
    lang: np.ndarray  # of each word, a position in langs
    word: np.ndarray  # of each word, a position in words
    joined: np.ndarray  # whether the next word stands in the same piece
    hash: np.ndarray  # of each word with its language


def tokens(text: pa.Array, lang: pa.Array) -> Tokens:
    """Words of the texts in order; distinct ones are told apart by their bytes."""
    data, offsets = shared.utf8(text)
    langs = pc.fill_null(lang.cast(pa.string()), "und").dictionary_encode()
    if isinstance(langs, pa.ChunkedArray):
        langs = langs.combine_chunks()
    low = words.LOWER[data]
    kind = _KIND[low]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    inside = kind == _WORD
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    piece = np.cumsum((kind == _END) | first[:-1], dtype=np.int32)[start]
    joined = np.append(piece[1:] == piece[:-1], False)[: len(start)]
    until = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=until[1:])
    coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(until), pa.py_buffer(low[inside])).dictionary_encode()
    row = np.searchsorted(offsets, start, "right") - 1
    in_lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of_word, of_lang = _hashes(coded.dictionary), _hashes(langs.dictionary)
    return Tokens(langs.dictionary, coded.dictionary, in_lang, word, joined, _of_words(of_lang[in_lang], of_word[word]) if len(word) else of_word)


def _hashes(strings: pa.Array) -> np.ndarray:
    data, offsets = shared.utf8(strings)
    return words.piece(words.prefix_sums(data), offsets[:-1], offsets[1:])


def _of_words(of_lang: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    return words.mix(of_word ^ words.mix(of_lang + np.uint64(1)))


def _phrase_hashes(batches):
    """Hashes of words or pairs with their language, as tasks that read texts compute them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = pc.split_pattern(batch.column(1), " ")
        size = parts.value_lengths().to_numpy(zero_copy_only=False)
        last = np.cumsum(size) - 1
        flat = _of_words(np.repeat(_hashes(batch.column(0)), size), _hashes(parts.flatten()))
        pairs = _pair_hash(flat, last - (size > 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(size > 1, pairs, flat[last]).view(np.int64))], names=["h"])


def _pair_hash(hash: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _run_hash(hash, at, 2)


def _run_hash(hash: np.ndarray, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Hashes of the `size` words from each place on."""
    run = hash[at]
    for k in range(1, int(np.max(size, initial=0))):
        run = np.where(size > k, words.mix(run * np.uint64(0x9E3779B97F4A7C15) + hash[np.minimum(at + k, len(hash) - 1)]), run)
    return run


def _slot(hash: np.ndarray, bits: int) -> np.ndarray:
    return (hash & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _packed(parts: list[np.ndarray]) -> np.ndarray:
    """One number for each tuple of small numbers; equal for equal tuples only."""
    code = parts[0]
    for part in parts[1:]:
        width = int(part.max()) + 1 if len(part) else 1
        if len(code) and int(code.max()) + 1 >= (1 << 62) // width:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code * width + part
    return code


def _has(bits: np.ndarray, hash: np.ndarray) -> np.ndarray:
    slot = (hash & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1


def _bitmap(rows: DataFrame) -> np.ndarray:
    """A bit for each hash or slot h, modulo the bitmap's size: at most 2**20 rows of two numbers reach the driver."""
    place = F.col("h").bitwiseAND((1 << BITS) - 1)
    found = rows.select(F.shiftright(place, 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("b")).groupBy("slot").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[found["slot"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return bits


def _may_start(tokens: Tokens, known: list) -> list[np.ndarray]:
    """For phrases of 1, 2 and more words, as many as bitmaps are known, the places where one stands that may be frequent."""
    found = [_has(known[0].value, tokens.hash)]
    for size, bits in enumerate(known[1:], 2):
        found.append(_both(tokens, found))
        places = np.flatnonzero(found[-1])
        found[-1][places] = _has(bits.value, _run_hash(tokens.hash, places, size))
    return found


def _both(tokens: Tokens, found: list[np.ndarray]) -> np.ndarray:
    """Where a phrase with one word more than the last of `found` begins and ends with one of these."""
    both = found[-1].copy()
    both[:-1] &= found[-1][1:]
    both[-1:] = False
    return both & tokens.joined if len(found) == 1 else both


def _strings(tokens: Tokens, at: np.ndarray, length: np.ndarray, most: int) -> pa.Array:
    """The space-joined words from each place on."""
    last = len(tokens.word) - 1
    columns = [pa.array(tokens.word[np.minimum(at + k, last)], mask=length <= k) for k in range(most)]
    return pc.binary_join_element_wise(*[tokens.words.take(c) for c in columns], pa.scalar(" ", pa.large_string()), null_handling="skip").cast(pa.string())


def _batch(tokens: Tokens, at: np.ndarray, **columns) -> pa.RecordBatch:
    head = {"lang": tokens.langs.take(pa.array(tokens.lang[at])).cast(pa.string())}
    return pa.RecordBatch.from_pydict(head | columns)


def _count_words(batches):
    """(lang, phrase, n) of the words of each chunk, and a row without a phrase for all of a language's words."""
    for batch in shared.gathered(batches, CHUNK):
        t = tokens(batch.column(0), batch.column(1))
        _, at, n = np.unique(_packed([t.lang, t.word]), return_index=True, return_counts=True)
        yield _batch(t, at, phrase=_strings(t, at, np.ones(len(at), int), 1), n=n)
        _, at, n = np.unique(t.lang, return_index=True, return_counts=True)
        yield _batch(t, at, phrase=pa.nulls(len(at), pa.string()), n=n)


def _count_slots(known: list, bits: int):
    """(part, slots in it, their counts) of the phrases with one word more than those whose bitmaps are known."""

    def run(batches):
        for batch in shared.gathered(batches, CHUNK):
            t = tokens(batch.column(0), batch.column(1))
            places = np.flatnonzero(_both(t, _may_start(t, known)))
            hash = _run_hash(t.hash, places, len(known) + 1)
            slot, n = np.unique(_slot(hash, bits), return_counts=True)
            part = slot >> PART_BITS
            order = np.lexsort((n, part))  # equal counts stand together
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
            bounds = pa.array(np.append(begin, len(part)), pa.int32())
            place = (slot & ((1 << PART_BITS) - 1)).astype(np.uint16).view(np.int16)
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x[order])) for x in (place, n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), *lists], names=["part", "slot", "n"])

    return run


def _sum_slots(least: int):
    """(slot, n) of the slots with at least so many occurrences; equal parts follow each other."""

    def often(part: int, sums: np.ndarray) -> pa.RecordBatch:
        slot = np.flatnonzero(sums >= least)
        return pa.RecordBatch.from_pydict({"h": (part << PART_BITS) + slot, "n": sums[slot].astype(np.int64)})

    def run(batches):
        last, sums = None, None
        for batch in batches:
            for begin, end in zip(*_runs([batch.column(0)])):
                part = batch.column(0)[int(begin)].as_py()
                if part != last:
                    if last is not None:
                        yield often(last, sums)
                    last, sums = part, np.zeros(1 << PART_BITS)
                slot, n = (batch.column(k).slice(begin, end - begin).flatten().to_numpy() for k in (1, 2))
                sums += np.bincount(slot.view(np.uint16), n, 1 << PART_BITS)  # as doubles, exact up to 2**53
        if last is not None:
            yield often(last, sums)

    return run


def _project(known: list, hot, bits: int):
    """Windows that start with a frequent pair: lang, part (of the pair, or of the window if its pair is hot), hot, windows with a line end between them, n of each."""

    def run(batches):
        for batch in shared.gathered(batches, CHUNK):
            t = tokens(batch.column(0), batch.column(1))
            found = _may_start(t, known)
            further = np.append(found[-1], np.zeros(LONGEST, bool))
            pairs = np.flatnonzero(found[1])
            if not len(pairs):
                continue
            length, going = np.full(len(pairs), PRUNED - 1), np.ones(len(pairs), bool)
            for k in range(LONGEST - PRUNED + 1):
                going &= further[pairs + k]
                length += going
            last = len(t.word) - 1
            first, n = [], []
            for most, some in ((2, np.flatnonzero(length == 2)), (LONGEST, np.flatnonzero(length > 2))):
                at, size = pairs[some], length[some]
                _, one, count = np.unique(_packed([t.lang[at], *[np.where(size > k, t.word[np.minimum(at + k, last)] + 1, 0) for k in range(most)]]), return_index=True, return_counts=True)
                first.append(some[one])
                n.append(count)
            first = np.concatenate(first)
            at, size = pairs[first], length[first]
            heavy = _has(hot.value, _pair_hash(t.hash, at))
            part = _slot(_run_hash(t.hash, at, np.where(heavy, size, 2)), bits) >> PART_BITS
            order = np.lexsort((part, heavy, t.lang[at]))
            at, size, heavy, part, n = at[order], size[order], heavy[order], part[order], np.concatenate(n)[order]
            begin, end = _runs([pa.array(x) for x in (t.lang[at], heavy, part)])
            bounds = pa.array(np.append(begin, end[-1]), pa.int32())
            windows = pc.binary_join(pa.ListArray.from_arrays(bounds, _strings(t, at, size, LONGEST)), "\n")
            yield _batch(t, at[begin], part=pa.array(part[begin].astype(np.int32)), hot=heavy[begin], windows=windows, n=pa.ListArray.from_arrays(bounds, pa.array(n.astype(np.int32))))

    return run


def _grow(least: int, enough: int):
    """Frequent pairs and extensions in each pair's windows; a hot pair's are all given, as other tasks have more of them."""

    def grown(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        windows = pc.split_pattern(table.column(3), "\n")
        row = np.repeat(np.arange(len(windows)), windows.value_lengths().to_numpy(zero_copy_only=False))
        parts = pc.split_pattern(windows.flatten(), " ")
        coded = parts.flatten().dictionary_encode()
        length = parts.value_lengths().to_numpy(zero_copy_only=False)
        begin = np.cumsum(length) - length
        flat = coded.indices.to_numpy(zero_copy_only=False)
        follow = np.full((LONGEST, len(length)), -1, np.int64)
        for k in range(LONGEST):
            has = length > k
            follow[k, has] = flat[begin[has] + k]
        lang = table.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)[row]
        order = np.lexsort((follow[1], follow[0], lang))
        row, lang, follow = row[order], lang[order], follow[:, order]
        n = table.column(4).flatten().to_numpy().astype(np.int64)[order]
        hot = table.column(2).to_numpy(zero_copy_only=False)[row]
        found: list[tuple[int, int, int]] = []

        def extend(pointers: np.ndarray, size: int, bound: int) -> None:
            word = follow[size, pointers]
            pointers = pointers[word >= 0]
            if not len(pointers):
                return
            word = follow[size, pointers]
            order = np.argsort(word, kind="stable")
            pointers, word = pointers[order], word[order]
            edge = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            total = np.add.reduceat(n[pointers], edge)
            stop = np.append(edge[1:], len(pointers))
            for k in np.flatnonzero(total >= bound).tolist():
                inner = pointers[edge[k] : stop[k]]
                found.append((int(inner[0]), size + 1, int(total[k])))
                if size + 1 < LONGEST:
                    extend(inner, size + 1, bound)

        for begin, end in zip(*_runs([pa.array(x) for x in (lang, follow[0], follow[1])])):
            total, bound = int(n[begin:end].sum()), 1 if hot[begin] else least
            if total >= bound:
                found.append((int(begin), 2, total))
                extend(np.arange(begin, end), 2, bound)
        at, size, total = (np.array(x, np.int64) for x in (zip(*found) if found else ([], [], [])))
        columns = [coded.dictionary.take(pa.array(follow[k, at], mask=size <= k)) for k in range(LONGEST)]
        phrase = pc.binary_join_element_wise(*columns, " ", null_handling="skip")
        return pa.RecordBatch.from_pydict({"lang": table.column(0).take(pa.array(row[at])), "phrase": phrase, "n": pa.array(total)})

    def run(batches):
        held: list[pa.RecordBatch] = []
        bytes_held, last = 0, None
        for batch in batches:
            for begin, end in zip(*_runs([batch.column(0), batch.column(1)])):
                here = (batch.column(0)[int(begin)].as_py(), batch.column(1)[int(begin)].as_py())
                if here != last and bytes_held >= enough:
                    yield grown(held)
                    held, bytes_held = [], 0
                last = here
                held.append(batch.slice(begin, end - begin))
                bytes_held += held[-1].column(3).nbytes
        if held:
            yield grown(held)

    return run


def _runs(columns: list) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches in which all columns stay the same."""
    n = len(columns[0])
    turn = np.zeros(n, bool)
    turn[:1] = True
    for column in columns:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        turn[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(turn)
    return begin, np.append(begin[1:], n)


def phrases(docs: DataFrame, *, least: int = 100, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(frequent phrases of 1 to 5 words: lang, phrase, size, f; words by language: lang, n)."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kind = "lang string, phrase string, n long"
    keep = F.col("phrase").isNull() | (F.col("n") >= least)
    sums = lambda rows: rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    counted = shared.cut(sums(texts.mapInArrow(_count_words, kind)).where(keep), "words")
    per_lang = counted.where("phrase is null").select("lang", "n")
    single = counted.where("phrase is not null")
    total = per_lang.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    heavy = min(max(int(total * HOT_SHARE), HOT_LEAST), HOT_MOST)
    bits = min(max(int(total // WORDS_A_SLOT).bit_length(), BITS), MOST_BITS)
    known = [spark.sparkContext.broadcast(_bitmap(single.select("lang", "phrase").mapInArrow(_phrase_hashes, "h long")))]
    for size in range(2, PRUNED + 1):
        counts = texts.mapInArrow(_count_slots(list(known), bits), "part int, slot array<smallint>, n array<int>")
        slots = shared.cut(counts.repartition("part").sortWithinPartitions("part").mapInArrow(_sum_slots(least), "h long, n long"), f"slots{size}")
        known.append(spark.sparkContext.broadcast(_bitmap(slots)))
        if size == 2:
            hot = spark.sparkContext.broadcast(_bitmap(slots.where(F.col("n") > heavy)))
    windows = texts.mapInArrow(_project(known, hot, bits), "lang string, part int, hot boolean, windows string, n array<int>")
    dealt = windows.repartition("lang", "part").sortWithinPartitions("lang", "part")
    every = single.unionByName(sums(dealt.mapInArrow(_grow(least, HELD), kind)).where(F.col("n") >= least))
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1
    return shared.cut(every.select("lang", "phrase", size.alias("size"), F.col("n").alias("f")), "phrases"), per_lang


def _part(of: str, count: Column) -> Column:
    """The first words of a phrase, or the last where the count is negative."""
    return F.call_function("substring_index", F.col(of), F.lit(" "), count)


def score(found: DataFrame, per_lang: DataFrame, *, inside: int = 100) -> DataFrame:
    """Scored candidates: lang, phrase, a, l, r, n, score.

    A candidate goes if its words lie inside a longer one with at least `inside` percent of its occurrences. The longest
    phrases around it occur no more often than those with one word more, so these decide.
    """
    grown = found.where("size > 2").select("lang", "f", F.explode(F.array(_part("phrase", F.col("size") - 1), _part("phrase", 1 - F.col("size")))).alias("phrase"))
    around = grown.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    candidates = found.where("size > 1").join(around, ["lang", "phrase"], "left")
    kept = candidates.where(F.col("around").isNull() | (100 * F.col("around") < inside * F.col("f")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("phrase", F.col("k")).alias("first"), _part("phrase", F.col("k") - F.col("size")).alias("rest"))
    known = lambda part, f: found.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    counted = cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"]).join(per_lang, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    value = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))
    lowest = counted.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("at"))
    return lowest.select("lang", "phrase", "a", "at.l", "at.r", "n", "at.score")


def collocations(docs: DataFrame, *, least: int = 100, inside: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    scored = score(*phrases(docs, least=least, text_col=text_col, lang_col=lang_col), inside=inside)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = scored.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH piece AS (
  SELECT lang, i AS doc, j AS no, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, i, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS i,
      regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]') AS ps
    FROM documents))),
cnt AS (
  SELECT lang, list_slice(w, s, s + size - 1) AS ws, size, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s
        FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS size FROM piece) WHERE len(w) >= size)
  GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM cnt WHERE size = 1 GROUP BY lang),
often AS (SELECT * FROM cnt WHERE f >= 100),
around AS (
  SELECT lang, ws, max(f) AS most FROM (
    SELECT lang, f, list_slice(ws, s, s + k - 1) AS ws
    FROM (SELECT lang, f, ws, k, unnest(range(1, size - k + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS k FROM often WHERE size > 2)))
  GROUP BY lang, ws),
kept AS (SELECT o.* FROM often o LEFT JOIN around u ON u.lang = o.lang AND u.ws = o.ws WHERE o.size > 1 AND (u.most IS NULL OR 100 * u.most < 100 * o.f)),
cuts AS (SELECT lang, ws, size, f, k, list_slice(ws, 1, k) AS a1, list_slice(ws, k + 1, size) AS a2 FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.ws, c.f AS a, x.f AS l, y.f AS r, t.n, c.k,
    CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.ws = c.a1 JOIN often y ON y.lang = c.lang AND y.ws = c.a2 JOIN total t ON t.lang = c.lang),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
named AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM low)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM named) WHERE rank <= 2000
"""
