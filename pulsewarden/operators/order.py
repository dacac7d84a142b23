"""Order statistics of scores by key, exact and without any buffer or window that holds a key.

Scores are counted by value, sorted by (key, value) over range partitions and written once with the partition's number.
Counts of partitions, cumulated, say in which partition a rank or a value lies; only these partitions are looked into, and
no group is larger than a partition. Ranks count rows, or rows of quiet days alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewarden.operators import tables


class Ordered:
    """Scores (signal, score, y) in order; signal may be any key. Rows with a null score are left out."""

    def __init__(self, scores: DataFrame, partitions: int | None = None):
        spark = scores.sparkSession
        y = F.col("y") if "y" in scores.columns else F.lit(0)
        counted = scores.where(F.col("score").isNotNull()).groupBy("signal", "score").agg(F.sum(y).cast("long").alias("p"), F.sum(1 - y).cast("long").alias("q"))
        partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = counted.repartitionByRange(partitions, "signal", "score").select("signal", "score", "p", "q", F.spark_partition_id().alias("part"))
        self.rows = tables.committed(ranged, "ordered")
        before = Window.partitionBy("signal").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        own = self.rows.groupBy("signal", "part").agg(F.max("score").alias("high"), F.sum("p").alias("p"), F.sum("q").alias("q"))
        whole = Window.partitionBy("signal")
        ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        #: One row for each key and partition that has some of it.
        self.parts = own.select("signal", "part", "high", "p", "q", ahead("p").alias("p_before"), ahead("q").alias("q_before"), F.sum("p").over(whole).alias("positives"), F.sum("q").over(whole).alias("negatives"))

    def totals(self) -> DataFrame:
        """(signal, positives, negatives)."""
        return self.parts.select("signal", "positives", "negatives").distinct()

    def percentiles(self, shares: list[float], over: str = "all") -> DataFrame:
        """(signal, pos, thr, positives, negatives): interpolated percentiles, pos counts the shares.

        over='negatives' takes them over quiet rows, or over all where a key has none.
        """
        quiet = F.col("negatives") > 0 if over == "negatives" else F.lit(False)
        n = F.when(quiet, F.col("negatives")).otherwise(F.col("positives") + F.col("negatives"))
        listed = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares)])
        wanted = self.totals().select("*", quiet.alias("quiet"), n.alias("n"), F.explode(listed).alias("w")).select("*", F.col("w.pos").alias("pos"), ((F.col("n") - 1) * F.col("w.share")).alias("at")).drop("w")
        ranks = wanted.select("signal", "quiet", "pos", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
        weight = lambda p, q: F.when(F.col("quiet"), q).otherwise(p + q)
        begin, size = weight(F.col("p_before"), F.col("q_before")), weight(F.col("p"), F.col("q"))
        inside = ranks.join(self.parts, "signal").where((F.col("rank") >= begin) & (F.col("rank") < begin + size))
        inside = inside.select("signal", "part", "quiet", "pos", "rank", (F.col("rank") - begin).alias("within"))
        looked = inside.select("signal", "part", "quiet").distinct()
        running = Window.partitionBy("signal", "part", "quiet").orderBy("score")
        own = self.rows.join(looked, ["signal", "part"]).withColumn("n", weight(F.col("p"), F.col("q")))
        own = own.withColumn("until", F.sum("n").over(running)).withColumn("from", F.col("until") - F.col("n"))
        found = inside.join(own.select("signal", "part", "score", "from", "until"), ["signal", "part"]).where((F.col("within") >= F.col("from")) & (F.col("within") < F.col("until")))
        found = found.groupBy("signal", "pos").agg(F.min(F.struct("rank", "score")).alias("a"), F.max(F.struct("rank", "score")).alias("b"))
        share = F.col("at") - F.floor("at")
        thr = F.when(F.col("a.score") == F.col("b.score"), F.col("a.score")).otherwise(F.col("a.score") * (1 - share) + F.col("b.score") * share)
        return wanted.join(found, ["signal", "pos"]).select("signal", "pos", thr.alias("thr"), "positives", "negatives")

    def reached(self, thresholds: DataFrame) -> DataFrame:
        """thresholds (signal, pos, thr and others) with tp and fp: rows with and without outbreak whose score reaches thr."""
        holds = thresholds.join(self.parts.select("signal", "part", "high", "p_before", "q_before"), "signal").where(F.col("thr") <= F.col("high"))
        first = holds.groupBy("signal", "pos").agg(F.min(F.struct("part", "p_before", "q_before")).alias("at"))
        placed = thresholds.join(first, ["signal", "pos"], "left")
        lower = self.rows.join(placed.select("signal", F.col("at.part").alias("part"), "pos", "thr"), ["signal", "part"]).where(F.col("score") < F.col("thr"))
        lower = lower.groupBy("signal", "pos").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        joined = placed.join(lower, ["signal", "pos"], "left")
        above = lambda total, c: F.when(F.col("at").isNull(), 0).otherwise(F.col(total) - F.col(f"at.{c}_before") - F.coalesce(c, F.lit(0)))
        return joined.select(*[F.col(c) for c in thresholds.columns], above("positives", "p").alias("tp"), above("negatives", "q").alias("fp"))


def percentile(scores: DataFrame, share: float, name: str, column: str = "score") -> DataFrame:
    """(signal, name): one percentile a signal."""
    return Ordered(scores.select("signal", F.col(column).alias("score"))).percentiles([share]).select("signal", F.col("thr").alias(name))


def fraction(part: Column, whole: Column) -> Column:
    """part / whole, null where there is none."""
    return F.try_divide(part.cast("double"), whole)
