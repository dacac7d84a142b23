"""Interaction audit of five text filters over all orders of applying them.

What a filter does at a step depends on which filters were applied before, not on their order. So documents are
summed to the 80 edges of the lattice of applied subsets (subset, next filter), and each of the 120 orders is a path of
five edges: its 600 steps are joined to the edges' sums. Documents move as (id, digest of the text, part, outcome bits).

Null texts are empty; a null part is the empty string; rows without an id never repeat another and never make another a
repeat; rows that repeat an id count each, and do not make each other repeats; of several labels of an id, any that says 1
counts; an empty table gives no rows; other columns, whatever their names, are not read. Texts are told apart by SHA-256.
"""

from __future__ import annotations

import itertools
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def outcomes(text: Column) -> Column:
    """Bits 0 to 3: whether a text fails A (few words), B (few distinct words), C (capitals) and D (odd marks)."""
    words = F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    failed = [count < 50, 100 * distinct.cast("long") < 65 * count.cast("long"), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(failed)), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, failed, docs, good, toxic): documents by the filters they fail, all filters taken alone; bit k is filter k.

    Copies of a text differ in E alone: all but those with the smallest id fail it. A digest's rows are summed before they
    meet, so a text with very many copies is a few rows: one for each part, labels and task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), outcomes(F.col("text")).alias("bits"))
    rows = rows.groupBy("id", "part", "digest", "bits").agg(F.count("*").alias("copies"))
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    marked = rows.join(known, "id", "left").select("*", F.coalesce("good", F.lit(0)).alias("g"), F.coalesce("toxic", F.lit(0)).alias("x"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "copies")))
    kinds = marked.groupBy("digest", "part", "bits", "g", "x").agg(F.sum("copies").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("copies")).otherwise(0)).alias("unknown"), least.alias("least"))
    first = kinds.groupBy("digest").agg(F.min("least.id").alias("first"))
    joined = kinds.join(first, "digest").withColumn("spared", F.col("unknown") + F.when(F.col("least.id") == F.col("first"), F.col("least.copies")).otherwise(0))
    cases = F.array(F.struct(F.col("bits").alias("failed"), F.col("spared").alias("docs")), F.struct((F.col("bits") + (1 << 4)).alias("failed"), (F.col("n") - F.col("spared")).alias("docs")))
    each = joined.select("part", "g", "x", F.explode(cases).alias("c")).where("c.docs > 0")
    return each.groupBy("part", "c.failed").agg(F.sum("c.docs").alias("docs"), F.sum(F.col("c.docs") * F.col("g")).alias("good"), F.sum(F.col("c.docs") * F.col("x")).alias("toxic"))


def edges(counted: DataFrame) -> DataFrame:
    """Sums of the 80 edges of each part: part, applied (bits), filter (position), and what happens to its documents there.

    weight is the number of orders that pass an edge.
    """
    every = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(factorial(bin(s).count("1")) * factorial(4 - bin(s).count("1"))).alias("weight")) for f in range(5) for s in range(32) if not s >> f & 1])
    at = counted.select("*", F.explode(every).alias("edge")).select("part", "failed", "docs", "good", "toxic", "edge.*")
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    fails, gone = F.col("failed").bitwiseAND(bit) != 0, F.col("failed").bitwiseAND(F.col("applied")) != 0
    total = lambda condition, c="docs": F.sum(F.when(condition, F.col(c)).otherwise(0))
    return at.groupBy("part", "applied", "filter", "weight").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("failed") == bit).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"))


def steps(spark: SparkSession) -> DataFrame:
    """The 600 steps of the 120 orders: filter_order, step, applied, filter."""
    rows = [(("".join(FILTERS[f] for f in order)), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in itertools.permutations(range(5)) for k in range(5)]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, filter order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    summed = edges(judged(docs, labels, **columns))
    shares = summed.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    paths = summed.join(shares, ["part", "filter"]).join(F.broadcast(steps(docs.sparkSession)), ["applied", "filter"])
    return paths.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH first AS (SELECT coalesce(text, '') AS text, min(doc_id) AS d FROM documents GROUP BY 1),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
base AS (
  SELECT coalesce(d.source, '') AS part, coalesce(d.text, '') AS t, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, coalesce(d.doc_id > f.d, false) AS e,
    list_filter(regexp_split_to_array(coalesce(d.text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w
  FROM documents d JOIN first f ON f.text = coalesce(d.text, '') LEFT JOIN lab l ON l.doc_id = d.doc_id),
fail AS (
  SELECT part, good, toxic, {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': e} AS x FROM base),
bad AS (SELECT part, good, toxic, concat_ws('', CASE WHEN x.A THEN 'A' END, CASE WHEN x.B THEN 'B' END, CASE WHEN x.C THEN 'C' END, CASE WHEN x.D THEN 'D' END, CASE WHEN x.E THEN 'E' END) AS f FROM fail),
grp AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM bad GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || d.c || e.c || g.c AS o FROM letter a, letter b, letter d, letter e, letter g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
step AS (SELECT o, k, o[1:k - 1] AS before, o[k:k] AS c FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS k FROM orders)),
placed AS (
  SELECT g.*, s.o, s.k, s.c, contains(g.f, s.c) AS fails, len(translate(g.f, s.before, '')) < len(g.f) AS gone FROM grp g, step s),
sums AS (
  SELECT part, o AS filter_order, k AS step, c, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f = c THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM placed GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM sums
"""
