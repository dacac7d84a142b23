"""N-gram Jaccard self-join of documents: MinHash banding, then verification on whole n-gram sets.

1. Documents with the same n-gram set form one class; one of them stands for it from here on.
2. Each class gets a MinHash signature, cut into bands of rows; a shuffle on band hashes finds buckets.
   The smallest class of a bucket is its lead. Classes meet under leads: two classes that share a bucket
   share its lead, and a class has few different leads, so its text travels a few times, not once a band.
3. Under each lead, classes are dealt into blocks of bounded size; every pair of blocks is compared in one
   task by a product of incidence matrices, which gives exact Jaccard values. Pairs are never emitted: a
   block pair returns link counts per class and the edges of a spanning forest.
4. Link counts are summed, forests are joined into components.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewarden.llm import shared, words
from pulsewarden.llm.components import components


def choose_bands(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands still give `recall` at `threshold` within `most` hashes."""
    for rows in range(most, 0, -1):
        share = threshold**rows
        if share >= 1:
            return 1, rows
        bands = math.ceil(math.log1p(-recall) / math.log1p(-share))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding within that many hashes")


def _signer(n: int, bands: int, rows: int):
    draw = np.random.Generator(np.random.PCG64(1998))
    factors = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in shared.chunks(*shared.utf8(batch.column(2))):
                hashes, at = words.shingles(words.split(data, offsets), n)
                size = high - low
                sets = [np.unique(hashes[at[k] : at[k + 1]]) for k in range(size)]
                counts = np.array([len(s) for s in sets])
                some = np.flatnonzero(counts)
                sign = np.zeros((bands * rows, len(some)), np.uint64)
                first = second = np.zeros(size, np.uint64)
                if len(some):
                    joined = np.concatenate([sets[k] for k in some])
                    starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
                    first, second = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
                    first[some] = np.add.reduceat(words.mix(joined), starts)
                    second[some] = np.add.reduceat(words.mix(joined ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    for k in range(bands * rows):
                        sign[k] = np.minimum.reduceat(joined * factors[k] + shifts[k], starts)
                band = np.zeros((bands, len(some)), np.uint64)
                for k in range(bands * rows):
                    band[k // rows] = words.mix(band[k // rows] ^ sign[k]) + np.uint64(k // rows)
                lists = np.zeros(size + 1, np.int32)
                lists[1:][some] = bands
                both = np.column_stack([first, second]).astype(">u8").tobytes()
                keys = pa.Array.from_buffers(pa.binary(16), size, [None, pa.py_buffer(both)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, size), batch.column(1).slice(low, size), pa.array(counts, pa.int64()), keys, pa.array(first.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.cumsum(lists, dtype=np.int32)), pa.array(np.ascontiguousarray(band.T).ravel().view(np.int64)))],
                    names=["id", "text_hash", "n_grams", "key", "half", "bands"],
                )

    return run


def _roots(n: int, pairs: np.ndarray) -> list[int]:
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def _verifier(n: int, threshold: float, width: int = 8192):
    """Exact links within one pair of blocks; see the module's text."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable").reset_index(drop=True)
        data, offsets = shared.utf8(pa.array(part["text"], pa.large_string()))
        sets = []
        for _, _, some, at in shared.chunks(data, offsets):
            hashes, rows = words.shingles(words.split(some, at), n)
            sets += [np.unique(hashes[a:b]) for a, b in zip(rows[:-1], rows[1:])]
        size = np.array([len(s) for s in sets], np.float64)
        grams, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        twice = seen[column] > 1
        row, column = row[twice], np.unique(column[twice], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [low, low + width])
            used, slim = np.unique(row[a:b], return_inverse=True)
            matrix = np.zeros((len(used), width), np.float32)
            matrix[slim, column[a:b] - low] = 1
            common[np.ix_(used, used)] += matrix @ matrix.T
        similar = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
        left, right = np.nonzero(np.triu(similar, 1))
        block = part["block"].to_numpy()
        p, q = int(part["p"].iloc[0]), int(part["q"].iloc[0])
        lead = part["lead"].iloc[0]
        crosses = (block[left] != block[right]) if p != q else np.ones(len(left), bool)
        left, right = left[crosses], right[crosses]
        leads = [set(x) for x in part["leads"]]
        own = np.fromiter((min(leads[a] & leads[b]) == lead for a, b in zip(left.tolist(), right.tolist())), bool, len(left))
        left, right = left[own], right[own]
        keys, copies = part["key"].to_numpy(), part["copies"].to_numpy()
        links = np.bincount(left, copies[right], len(keys)) + np.bincount(right, copies[left], len(keys))
        root = _roots(len(keys), np.column_stack([left, right]))
        linked = links > 0
        return pd.DataFrame({"key": keys[linked], "links": links[linked].astype(np.int64), "root": keys[root][linked]})

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))


def _place(id_: Column) -> Column:
    """An id that compares and joins even if it is null."""
    return F.coalesce(id_, F.lit(-(1 << 63)))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999,
            block_rows: int = 400, block_bytes: int = 8 << 20, broadcast_rows: int = 200_000) -> DataFrame:
    """Per row of docs: id, text_hash, n_grams, class_id, set_id, n_links, and lead, the (id, text_hash) that stands for its class.

    Sets are known by 128 bits of their n-grams, never by ids, so ids may repeat with other texts.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    bands, rows = choose_bands(threshold, recall)
    texts = _rows(docs, id_col, text_col)
    signed = shared.cut(texts.mapInArrow(_signer(n, bands, rows), "id long, text_hash long, n_grams long, key binary, half long, bands array<long>"), "signatures")

    some = signed.where("n_grams > 0")
    firsts = F.min(F.struct(_place(F.col("id")).alias("place"), "text_hash")).alias("one")
    sets = some.groupBy("key").agg(F.min("id").alias("set_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max("n_grams").alias("n_grams"), F.first("half").alias("half"), firsts)
    sets = shared.cut(sets, "sets")
    dealt = sets.select("key", "half", F.explode("bands").alias("band"))
    buckets = dealt.groupBy("band").agg(F.count("*").alias("met"), F.min("half").alias("lead")).where("met > 1").select("band", "lead")
    under = dealt.join(buckets, "band").select("key", "lead").distinct()
    leads = under.groupBy("key").agg(F.sort_array(F.collect_list("lead")).alias("leads"))
    leads = shared.cut(leads.join(sets.select("key", "copies", "n_grams", "one.*"), "key"), "leads")

    groups = leads.select(F.explode("leads").alias("lead"), "n_grams").groupBy("lead").agg(F.count("*").alias("met"), F.sum("n_grams").alias("grams"))
    groups = groups.select("lead", F.greatest(F.ceil(F.col("met") / block_rows), F.ceil(F.col("grams") * 8 / block_bytes)).cast("int").alias("blocks"))
    groups = shared.cut(groups, "groups")
    small = lambda df: F.broadcast(df) if df.limit(broadcast_rows + 1).count() <= broadcast_rows else df
    members = texts.select(_place(F.col("id")).alias("place"), "text_hash", "text").join(small(leads), ["place", "text_hash"]).dropDuplicates(["key"])
    members = members.select("key", "text", "leads", "copies", F.explode("leads").alias("lead")).join(small(groups), "lead")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    members = members.withColumn("block", block)
    members = members.select("key", "text", "leads", "copies", "lead", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("key", "text", "leads", "copies", "lead", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    # dealt by block pair, as Spark would leave a hot lead in one task otherwise
    found = members.repartition("lead", "p", "q").groupBy("lead", "p", "q").applyInPandas(_verifier(n, threshold), "key binary, links long, root binary")
    found = shared.cut(found, "links")

    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    tree = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    repeated = signed.groupBy("id").agg((F.min("half") != F.max("half")).alias("several")).where("several AND id IS NOT NULL").select("id")
    named = some.join(repeated, "id", "left_anti").groupBy("key").agg(F.min("id").alias("own_id"))
    per_set = sets.select("key", "half", "set_id", "copies", "one").join(named, "key", "left").join(linked, "key", "left").join(tree, "key", "left")
    per_set = shared.cut(per_set.withColumn("component", F.coalesce("component", "key")), "classes")
    nameless = F.least(F.min("half"), -1 - F.min("half"))
    joined = per_set.where("links IS NOT NULL").groupBy("component").agg(F.coalesce(F.min("own_id"), nameless).alias("c_id"), F.min("one").alias("c_lead"))
    alone = F.coalesce("own_id", F.least(F.col("half"), -1 - F.col("half")))
    per_set = per_set.join(joined, "component", "left").select(
        "key", F.coalesce("c_id", alone).alias("class_id"), "set_id", F.coalesce("c_lead", "one").alias("lead"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = signed.select("id", "text_hash", "n_grams", F.when(F.col("n_grams") > 0, F.col("key")).alias("key")).join(per_set, "key", "left")
    return out.select(
        "id", "text_hash", "n_grams",
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("set_id")).alias("set_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("lead", F.struct(_place(F.col("id")).alias("place"), "text_hash")).alias("lead"),
    )


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, class_id (smallest id of its linked component), set_id, n_grams, n_links.

    set_id is the smallest id with the same n-gram set; n_links counts the other documents, copies
    included, whose n-gram Jaccard is at least `threshold`. Texts of fewer than n words have one n-gram
    of all their words; null texts and texts without words have no n-gram, no link and stand alone.
    Rows that repeat an id and text count as copies. An id that stands with several n-gram sets, or none, names no class: a
    class without any other id has a negative number of its own. Extra columns are ignored.
    """
    found = classes(docs, id_col=id_col, text_col=text_col, **how)
    return found.select(F.col("id").alias(id_col), "class_id", "set_id", "n_grams", "n_links")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each component, that with the smallest id (of equals, the smallest hash of its text); columns are unchanged.

    Rows that repeat both id and text stay together, as they are one document; rows without an id all stay.
    """
    found = classes(docs, id_col=id_col, text_col=text_col, **how)
    kept = found.where((F.col("id") == F.col("lead.place")) & (F.col("text_hash") == F.col("lead.text_hash"))).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    rows = docs.where(F.col(id_col).isNotNull())
    same = (rows[id_col].cast("long") == F.col("__id")) & (F.xxhash64(F.coalesce(rows[text_col], F.lit(""))) == F.col("__hash"))
    return rows.join(kept, same, "left_semi").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
