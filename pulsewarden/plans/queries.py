"""The engine's queries on the driver's tables, one per operator, and the same in DuckDB SQL.

Signal 1 counts lineitem by ship day and flags, signal 2 orders by order day and priority; outbreaks are
planted by a rule (panels.with_outbreaks). Series are shorter than the reference's, so train takes 2100 days.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewarden.functions import bilstm, farrington, features
from pulsewarden.operators import calibrate, detectors, ensemble, forest, metrics, ocsvm, order, recurrent, search, slices, tables
from pulsewarden.sources import panels, wide_files

TRAIN, TAIL = 2100, 343
KEYS = ["signal", "sim", "t"]


def events(spark: SparkSession, sf: str) -> list[tuple[DataFrame, str, list[str], int]]:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_shipdate", "l_returnflag", "l_linestatus")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderdate", "o_orderpriority")
    return [(lines, "l_shipdate", ["l_returnflag", "l_linestatus"], 1), (orders, "o_orderdate", ["o_orderpriority"], 2)]


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel of both signals, written once, as most queries use it in several jobs."""
    parts = [(rows, F.col(day), keys, signal) for rows, day, keys, signal in events(spark, sf)]
    return tables.committed(panels.with_outbreaks(panels.daily_panels(parts)), "panel")


PANEL = """
WITH ev AS (
  SELECT 1 AS signal, l_returnflag || '/' || l_linestatus AS key, CAST(l_shipdate AS DATE) AS day FROM lineitem
  UNION ALL SELECT 2, o_orderpriority, CAST(o_orderdate AS DATE) FROM orders),
cnt AS (SELECT signal, key, day, CAST(count(*) AS DOUBLE) AS x FROM ev GROUP BY ALL),
span AS (SELECT signal, min(day) AS f, max(day) AS l FROM cnt GROUP BY 1),
names AS (SELECT signal, key, CAST(row_number() OVER (PARTITION BY signal ORDER BY key) - 1 AS INT) AS sim_idx FROM (SELECT DISTINCT signal, key FROM cnt)),
cal AS (SELECT n.signal, n.key, n.sim_idx, CAST(d.t AS INT) AS t, s.f + CAST(d.t AS INT) AS day
        FROM names n JOIN span s USING (signal), range(0, 20000) d(t) WHERE s.f + CAST(d.t AS INT) <= s.l),
panel AS (SELECT cal.signal, 'sig' || cal.signal || '_sim' || sim_idx AS sim, sim_idx, t, coalesce(x, 0.0) AS x,
                 CASE WHEN (t + 31 * sim_idx) % 170 < 10 THEN 1 ELSE 0 END AS y
          FROM cal LEFT JOIN cnt USING (signal, key, day))"""
FULL = PANEL + """, ext AS (SELECT *, max(t) OVER (PARTITION BY signal, sim) + 1 AS n FROM panel)
, tail AS (SELECT * FROM ext WHERE t >= n - 343), train AS (SELECT * FROM ext WHERE t < 2100)"""
_W14 = "(PARTITION BY signal, sim ORDER BY t ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"


def _scores_sql() -> str:
    """Three stand-in detectors on the tail with 13 days of context: z, ratio and jump."""
    return FULL + f""", base AS (SELECT signal, sim, sim_idx, t, x, y, n, avg(x) OVER {_W14} AS m, stddev_pop(x) OVER {_W14} AS s,
      coalesce(x - lag(x) OVER (PARTITION BY signal, sim ORDER BY t), 0.0) AS d,
      row_number() OVER (PARTITION BY signal, sim ORDER BY t) AS rn FROM ext WHERE t >= n - 700),
good AS (SELECT * FROM base WHERE rn >= 14),
val AS (SELECT * FROM good WHERE t < n - 343), test AS (SELECT * FROM good WHERE t >= n - 343)"""


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(validation, test) rows with columns z, ratio, jump and mse, peak of the stand-ins."""
    from pyspark.sql import Window

    days = Window.partitionBy("signal", "sim").orderBy("t")
    w = days.rowsBetween(-13, 0)
    ext = panel(spark, sf).withColumn("n", F.max("t").over(Window.partitionBy("signal", "sim")) + 1).where("t >= n - 700")
    rows = ext.select(
        *KEYS, "sim_idx", "x", "y", "n", F.avg("x").over(w).alias("m"), F.stddev_pop("x").over(w).alias("s"),
        F.coalesce(F.col("x") - F.lag("x").over(days), F.lit(0.0)).alias("jump"), F.row_number().over(days).alias("rn")).where("rn >= 14")
    rows = rows.select(*KEYS, "sim_idx", "x", "y", "n", F.round((F.col("x") - F.col("m")) / (F.col("s") + 1e-6), 9).alias("z"),
                       F.round(F.col("x") / (F.col("m") + 1e-6), 9).alias("ratio"), "jump")
    return rows.where("t < n - 343").drop("n"), rows.where("t >= n - 343").drop("n")


_Z, _RATIO = "round((x - m) / (s + 1e-6), 9)", "round(x / (m + 1e-6), 9)"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# sources, slices, splits


@query(PANEL + " SELECT signal, sim, sim_idx, t, x, y FROM panel")
def daily_panel(spark, sf):
    return panel(spark, sf)


def _wide(spark, sf):
    """A wide table: a row per order day, a column per priority, as text."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    days = orders.select(F.col("o_orderdate").cast("date").alias("date"), F.split("o_orderpriority", "-")[0].alias("p"))
    wide = days.groupBy("date").pivot("p", ["1", "2", "3", "4", "5"]).count()
    return wide.select("date", *[F.when(F.col(c) > 2, "many").otherwise(F.col(c).cast("string")).alias(f"s{c}") for c in "12345"])


@query("""WITH w AS (SELECT CAST(o_orderdate AS DATE) AS date, 's' || split_part(o_orderpriority, '-', 1) AS sim_col, count(*) AS c FROM orders GROUP BY ALL),
d AS (SELECT DISTINCT date FROM w), k AS (SELECT d.date, s.sim_col, s.i FROM d, (VALUES ('s1', 0), ('s2', 1), ('s3', 2), ('s4', 3), ('s5', 4)) s(sim_col, i))
SELECT CAST(k.date AS VARCHAR) AS day, k.sim_col, CAST(k.i AS INT) AS sim_idx, CASE WHEN c <= 2 THEN CAST(c AS DOUBLE) END AS x FROM k LEFT JOIN w USING (date, sim_col)""")
def unpivot_wide(spark, sf):
    wide = _wide(spark, sf).withColumn("day", F.col("date").cast("string"))
    return panels.to_long(wide, "day")


@query(PANEL + """ SELECT signal, 'regular' AS label_set, sim, sim_idx, t, x, y FROM panel UNION ALL SELECT signal, 'seasonal', sim, sim_idx, t, x, CASE WHEN (t + 50) % 170 < 20 THEN 1 ELSE 0 END FROM panel WHERE signal = 2""")
def files_scan(spark, sf):
    """The panel as wide CSV files, counts, labels and seasonal labels of each signal apart, read back by one scan."""
    p, folder = panel(spark, sf), tables.folder(spark, "matrices")
    seasonal = p.withColumn("y", ((F.col("t") + 50) % 170 < 20).cast("int"))
    for signal in (1, 2):
        for kind, rows, value in (("totals", p, "x"), ("outbreaks", p, "y"), *([("seasonal_outbreaks", seasonal, "y")] if signal == 2 else [])):
            wide_files.write_matrix(rows.where(F.col("signal") == signal), f"{folder}/simulated_{kind}_sig{signal}.csv", value)
    return wide_files.scan(spark, folder)


@query(FULL + " SELECT signal, sim, CAST(row_number() OVER (PARTITION BY signal, sim ORDER BY t) - 1 AS INT) AS row, CASE WHEN x > 12 THEN 1.0 ELSE 0.0 END AS a FROM tail")
def alarm_files(spark, sf):
    """Alarms of each signal written as one matrix, a column a series and a row a day, and read back by row."""
    alarms, folder = slices.tail(panel(spark, sf), TAIL).withColumn("a", (F.col("x") > 12).cast("double")), tables.folder(spark, "alarms")
    for signal in (1, 2):
        wide_files.write_matrix(alarms.where(F.col("signal") == signal), f"{folder}/alarms_signal_{signal}.csv")
    read = wide_files.read_matrices(spark, f"{folder}/alarms_signal_*.csv")
    return read.select(F.regexp_extract("source", r"signal_(\d+)", 1).cast("int").alias("signal"), F.col("sim_col").alias("sim"), F.col("t").alias("row"), F.col("x").alias("a"))


@query(PANEL + " SELECT a.signal, a.sim, a.t, a.x, b.y FROM panel a JOIN panel b ON a.signal = b.signal AND a.sim = b.sim AND a.t = b.t")
def label_join(spark, sf):
    p = panel(spark, sf)
    return panels.join_labels(p.select(*KEYS, "x"), p.select(*KEYS, "y"))


@query(PANEL + " SELECT signal, sim, t, x FROM panel WHERE signal IN (SELECT signal FROM panel GROUP BY signal, sim HAVING count(*) >= 2443)")
def series_length_filter(spark, sf):
    return slices.long_enough(panel(spark, sf), TRAIN + TAIL).select(*KEYS, "x")


@query(FULL + " SELECT signal, sim, t, x, y FROM train")
def train_slice(spark, sf):
    return slices.head(panel(spark, sf), TRAIN).select(*KEYS, "x", "y")


@query(FULL + " SELECT signal, sim, t, x, y FROM tail")
def tail_slice(spark, sf):
    return slices.tail(panel(spark, sf), TAIL).select(*KEYS, "x", "y")


@query(FULL + " SELECT signal, sim, t, x FROM ext WHERE t >= n - 356 QUALIFY row_number() OVER (PARTITION BY signal, sim ORDER BY t) >= 14")
def tail_with_context(spark, sf):
    return slices.warmed_up(slices.tail(panel(spark, sf), TAIL, 13), 14).select(*KEYS, "x")


@query(PANEL + " SELECT signal, sim, t, x FROM panel WHERE t BETWEEN 2205 AND 2547")
def denominator_rows(spark, sf):
    return slices.in_rows(panel(spark, sf), metrics.FIRST_ROW, metrics.LAST_ROW).select(*KEYS, "x")


@query(PANEL + ", r AS (SELECT *, row_number() OVER (PARTITION BY signal, sim ORDER BY t) AS rn, count(*) OVER (PARTITION BY signal, sim) AS c FROM panel) SELECT signal, sim, t, x FROM r WHERE rn <= (SELECT min(c) FROM r)")
def trim_to_shortest(spark, sf):
    return slices.first_common(panel(spark, sf)).select(*KEYS, "x")


@query(FULL + " SELECT signal, sim, t, CASE WHEN x > 12 THEN 1 ELSE 0 END AS a, CASE WHEN t % 3 = 0 THEN y ELSE 0 END AS y FROM tail")
def align_tail(spark, sf):
    tail = slices.tail(panel(spark, sf), TAIL)
    return slices.align_tail(tail.select(*KEYS, (F.col("x") > 12).cast("int").alias("a")), tail.where("t % 3 = 0"))


@query(PANEL + """, n AS (SELECT DISTINCT sim FROM panel UNION ALL SELECT 'sig3_simX' UNION ALL SELECT 'xsig1_sim2')
SELECT sim, CASE WHEN regexp_matches(sim, '^sig\\d+_sim\\d+$') THEN CAST(regexp_extract(sim, '^sig(\\d+)_sim(\\d+)$', 1) AS INT) END AS parsed_signal,
CASE WHEN regexp_matches(sim, '^sig\\d+_sim\\d+$') THEN CAST(regexp_extract(sim, '^sig(\\d+)_sim(\\d+)$', 2) AS INT) END AS parsed_idx FROM n""")
def parse_sim_name(spark, sf):
    names = panel(spark, sf).select("sim").distinct().unionByName(spark.createDataFrame([("sig3_simX",), ("xsig1_sim2",)], "sim string"))
    signal, index = panels.parse_sim(F.col("sim"))
    return names.select("sim", signal.alias("parsed_signal"), index.alias("parsed_idx"))


@query(FULL + " SELECT signal, t, " + ", ".join(f"CAST(max(CASE WHEN sim_idx = {k} THEN CASE WHEN x > 12 THEN 1 ELSE 0 END END) AS INT) AS sim_{k}" for k in range(6)) + " FROM tail GROUP BY signal, t")
def wide_alarm_pivot(spark, sf):
    """Alarms of every series of every signal, a column a simulation; the names come from the small table of series."""
    tail = slices.tail(panel(spark, sf), TAIL).select("signal", "t", F.concat(F.lit("sim_"), F.col("sim_idx")).alias("sim"), (F.col("x") > 12).cast("int").alias("a"))
    names = sorted((r[0] for r in tail.select("sim").distinct().collect()), key=lambda x: int(x[4:]))
    return panels.wide(tail, names, "a", "sim", ("signal", "t"))


SPLITS = PANEL + """, sims AS (SELECT DISTINCT signal, sim FROM panel),
rk AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY md5('42:' || sim), sim) AS rn, count(*) OVER (PARTITION BY signal) AS n FROM sims),
held AS (SELECT *, floor(n * 0.6) AS tr FROM rk),
splits AS (SELECT signal, sim, CASE WHEN rn <= tr THEN 'train' WHEN rn - tr <= greatest(1, floor((n - tr) / 2)) THEN 'val' ELSE 'test' END AS split FROM held)"""


@query(SPLITS + " SELECT signal, sim, split FROM splits")
def split_60_20_20(spark, sf):
    return slices.split_sims(panel(spark, sf))


@query(SPLITS + """, given AS (SELECT * FROM splits WHERE split <> 'train' OR signal = 1), ok AS (SELECT DISTINCT signal FROM given WHERE split = 'train')
SELECT signal, sim, split FROM given UNION ALL
SELECT signal, sim, 'train' FROM sims s WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.signal = s.signal) AND NOT EXISTS (SELECT 1 FROM given g WHERE g.signal = s.signal AND g.sim = s.sim)""")
def split_adopt_leftover(spark, sf):
    p = panel(spark, sf)
    given = slices.split_sims(p).where("split <> 'train' OR signal = 1")
    return slices.adopt_splits(p.select("signal", "sim").distinct(), given)


@query(SPLITS + " SELECT signal, split, array_to_string(list_sort(list(sim)), ',') AS sims FROM splits GROUP BY ALL")
def split_list_by_signal(spark, sf):
    return slices.split_lists(slices.split_sims(panel(spark, sf))).withColumn("sims", F.concat_ws(",", "sims"))


@query(SPLITS + ", more AS (SELECT signal, sim, split FROM splits UNION ALL SELECT 1, 'sig1_sim99', 'val') SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM sims s WHERE s.signal = m.signal AND s.sim = m.sim)")
def split_missing_sims(spark, sf):
    p = panel(spark, sf)
    more = slices.split_sims(p).unionByName(spark.createDataFrame([(1, "sig1_sim99", "val")], "signal int, sim string, split string"))
    return slices.missing_sims(p.select("signal", "sim").distinct(), more)


@query(SPLITS + " SELECT signal, sim, split FROM splits WHERE split <> 'train' ")
def split_union(spark, sf):
    s = slices.split_sims(panel(spark, sf))
    return slices.read_splits(s.where("split = 'val'").drop("split"), s.where("split = 'test'"))


@query(SPLITS + " SELECT p.signal, p.sim, p.t, p.x FROM panel p JOIN splits USING (signal, sim) WHERE split = 'test'")
def test_sims_only(spark, sf):
    p = panel(spark, sf)
    return slices.restrict(p, slices.split_sims(p), "test").select(*KEYS, "x")


@query("""WITH c AS (SELECT o_orderpriority AS sim, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY ALL)
SELECT sim, CAST(day AS VARCHAR) AS day, CAST(row_number() OVER (PARTITION BY sim ORDER BY day) - 1 AS INT) AS t, x FROM c""")
def day_ordinal(spark, sf):
    """Days by their position in their series, days without an order not counted."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("sim"), F.col("o_orderdate").cast("date").alias("day"))
    counted = orders.groupBy("sim", "day").agg(F.count("*").cast("double").alias("x"))
    return panels.with_ordinal(counted, "day", ("sim",)).withColumn("day", F.col("day").cast("string"))


@query(FULL + " SELECT signal, sim, t, x FROM train ORDER BY md5('42:' || signal || ':' || sim || ':' || t), signal, sim, t LIMIT 5000")
def subsample_train(spark, sf):
    return slices.subsample(slices.head(panel(spark, sf), TRAIN).select(*KEYS, "x"), KEYS, 5000)


# features


def _features20_sql(w: int) -> str:
    f7, fw = (f"(PARTITION BY signal, sim ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (7, w))
    o = "(PARTITION BY signal, sim ORDER BY t)"
    return FULL + f""", b AS (SELECT signal, sim, t, x, row_number() OVER {o} AS rn, avg(x) OVER {f7} AS mean7, avg(x) OVER {fw} AS meanw, max(x) OVER {f7} AS max7, max(x) OVER {fw} AS maxw,
 min(x) OVER {fw} AS minw, stddev_pop(x) OVER {f7} AS std7, stddev_pop(x) OVER {fw} AS stdw, first_value(x) OVER {fw} AS f, coalesce(x - lag(x, 1) OVER {o}, 0) AS diff1,
 coalesce(x - lag(x, 7) OVER {o}, 0) AS diff7, coalesce(x - lag(x, 14) OVER {o}, 0) AS diff14, median(x) OVER {fw} AS med, list(x) OVER {fw} AS v, list(x) OVER {f7} AS v7 FROM tail),
c AS (SELECT *, list_median(list_transform(v, lambda e: abs(e - med))) AS mad FROM b WHERE rn >= {w}), d AS (SELECT *, (x - f) / ({w} + 1e-6) AS sl FROM c)
SELECT signal, sim, t, x, round(mean7, 6) AS mean7, round(meanw, 6) AS meanw, max7, maxw, round(x / (mean7 + 1e-6), 6) AS ratio7, round(x / (meanw + 1e-6), 6) AS ratiow,
 round(len(list_filter(v7, lambda e: e <= x)) / len(v7), 6) AS rank7, round(len(list_filter(v, lambda e: e <= x)) / len(v), 6) AS rankw, diff1, diff7, diff14, round(std7, 6) AS std7, round(stdw, 6) AS stdw,
 round(stdw / (meanw + 1e-6), 6) AS cv, round(sl, 6) AS slope, round(x - (f + sl * ({w} - 1)), 6) AS residual, round((x - meanw) / (stdw + 1e-6), 6) AS z,
 round(0.6745 * (x - med) / CASE WHEN mad = 0 THEN 1e-6 ELSE mad END, 6) AS robust_z, round((x - minw) / (maxw - minw + 1e-6), 6) AS minmax FROM d"""


for _w in (7, 14, 21):
    Q[f"features20_w{_w}"] = lambda spark, sf, w=_w: _rounded(features.features20(slices.tail(panel(spark, sf), TAIL), w))
    SQL[f"features20_w{_w}"] = _features20_sql(_w)


@query(FULL + f", b AS (SELECT *, row_number() OVER (PARTITION BY signal, sim ORDER BY t) AS rn, avg(x) OVER {_W14} AS m, stddev_pop(x) OVER {_W14} AS s FROM tail) SELECT signal, sim, t, x, round(m, 6) AS mean, round(s, 6) AS std, round(x / (m + 1e-6), 6) AS ratio FROM b WHERE rn >= 14")
def features4_w14(spark, sf):
    return _rounded(features.features4(slices.tail(panel(spark, sf), TAIL), 14))


@query(FULL + f", b AS (SELECT *, list(x) OVER {_W14} AS v, row_number() OVER (PARTITION BY signal, sim ORDER BY t) AS rn FROM tail) SELECT signal, sim, t, array_to_string(list_transform(v, lambda e: CAST(e AS INT)), ',') AS seq, y FROM b WHERE rn >= 14")
def seq_windows14(spark, sf):
    got = features.sequences(slices.tail(panel(spark, sf), TAIL), 14)
    return got.withColumn("seq", F.concat_ws(",", F.transform("seq", lambda v: v.cast("int").cast("string"))))


@query(FULL + ", m AS (SELECT signal, avg(x) AS m, stddev_pop(x) AS s FROM train GROUP BY 1) SELECT signal, sim, t, round((x - m) / s, 6) AS x FROM tail JOIN m USING (signal)")
def standardize(spark, sf):
    p = panel(spark, sf)
    return _rounded(features.standardise(slices.tail(p, TAIL).select(*KEYS, "x"), slices.head(p, TRAIN), ["x"]))


_M14 = ", ".join(f"avg({c}) AS m{k}, stddev_pop({c}) AS s{k}" for k, c in enumerate(("x", "m", "s", "r")))


@query(SPLITS + f""", f AS (SELECT p.*, avg(x) OVER {_W14} AS m, stddev_pop(x) OVER {_W14} AS s, row_number() OVER (PARTITION BY signal, sim ORDER BY t) AS rn, max(t) OVER (PARTITION BY signal, sim) AS n FROM panel p),
g AS (SELECT f.*, split, x / (m + 1e-6) AS r FROM f JOIN splits USING (signal, sim) WHERE rn >= 14), k AS (SELECT signal, {_M14} FROM g WHERE split = 'train' AND t < {TRAIN} AND y = 0 GROUP BY 1)
SELECT signal, sim, t, {", ".join(f"round(({c} - m{k}) / s{k}, 6) AS f{k}" for k, c in enumerate(("x", "m", "s", "r")))} FROM g JOIN k USING (signal) WHERE split <> 'train' AND t > n - {TAIL}""")
def features_with_context(spark, sf):
    """Rows to score with windows that reach back before the tail, scaled on train days without outbreaks."""
    p = panel(spark, sf)
    rows = search.inputs(p, slices.split_sims(p), [14], features.NAMES4, TRAIN, TAIL, tail_context=True, train_exclude_outbreaks=True)[1]
    return _rounded(rows.select(*KEYS, *[F.col("features")[k].alias(f"f{k}") for k in range(4)]))


_K = 2209
WEEKS = PANEL + f""", wk AS (SELECT s.signal, s.sim, CAST(w.w AS INT) AS week, coalesce((SELECT sum(x) FROM panel p WHERE p.signal = s.signal AND p.sim = s.sim AND p.t + 1 BETWEEN {_K} - 7 * (316 - w.w) - 6 AND {_K} - 7 * (316 - w.w) AND {_K} - 7 * (316 - w.w) - 6 >= 1), 0.0) AS cases
FROM (SELECT DISTINCT signal, sim FROM panel) s, range(1, 317) w(w))"""


@query(WEEKS + " SELECT * FROM wk")
def weekly_rollup_anchor(spark, sf):
    return features.weekly(panel(spark, sf), _K)


@query(WEEKS + ", z AS (SELECT *, coalesce(min(CASE WHEN cases > 0 THEN week END) OVER (PARTITION BY signal, sim), max(week) OVER (PARTITION BY signal, sim)) AS first_week FROM wk) SELECT signal, sim, week, CASE WHEN week >= first_week THEN cases END AS cases, first_week FROM z")
def leading_zero_trim(spark, sf):
    return features.trim_leading_zeros(features.weekly(panel(spark, sf), _K))


@query(PANEL + " SELECT signal, sim, t, sum(x) OVER w AS recent, sum(x) OVER w >= 5 AS enough FROM panel WINDOW w AS (PARTITION BY signal, sim ORDER BY t ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)")
def enough_cases(spark, sf):
    return features.recent_cases(panel(spark, sf))


@query("""WITH c AS (SELECT i, CAST(round(52.18 * i) AS INT) AS c FROM range(0, 7) r(i)), l AS (SELECT CAST(lag AS INT) AS lag FROM range(28, 266) q(lag)),
m AS (SELECT lag, max(c.c) AS c FROM l JOIN c ON l.lag >= c.c - 3 GROUP BY lag),
g AS (SELECT lag, CAST(CASE WHEN lag - c <= 3 OR lag - c > 48 THEN 1 ELSE 2 + (lag - c - 4) // 5 END AS INT) AS season FROM m), """ + WEEKS.replace("WITH ", "", 1).lstrip() + """
SELECT signal, sim, season, count(*) AS weeks, sum(cases) AS cases FROM wk JOIN g ON g.lag = 316 - week GROUP BY ALL""")
def season_groups(spark, sf):
    """Cases of each series in each seasonal group of the weeks back from one day."""
    groups = spark.createDataFrame(farrington.group_table(), "lag int, season int")
    weeks = features.weekly(panel(spark, sf), _K).withColumn("lag", 316 - F.col("week"))
    return weeks.join(F.broadcast(groups), "lag").groupBy("signal", "sim", "season").agg(F.count("*").alias("weeks"), F.sum("cases").alias("cases"))


@query(FULL + """, s AS (SELECT signal, sim, t, sum(x) OVER w AS c, count(*) OVER w AS days FROM panel WINDOW w AS (PARTITION BY signal, sim ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
k AS (SELECT a.signal, a.sim, a.t, (a.t - s.t) // 7 AS lag, s.c FROM tail a JOIN s ON s.signal = a.signal AND s.sim = a.sim AND s.t <= a.t AND (a.t - s.t) % 7 = 0 AND s.days = 7 AND (a.t - s.t) // 7 < 266)
SELECT signal, sim, t, count(*) AS weeks, sum(c) AS cases, sum(c * (lag % 53)) AS placed, CAST(max(CASE WHEN c > 0 THEN lag END) AS INT) AS oldest FROM k GROUP BY ALL""")
def weekly_rollup_anchors(spark, sf):
    """What the weeks back from every day of the tail hold: how many, their cases, where these lie and the oldest week with any."""
    p = panel(spark, sf)
    weeks = features.anchored_weeks(p).join(slices.tail(p, TAIL).select(*KEYS), KEYS)
    each = weeks.select(*KEYS, F.posexplode("weeks").alias("lag", "c"))
    return each.groupBy(*KEYS).agg(F.count("*").alias("weeks"), F.sum("c").alias("cases"), F.sum(F.col("c") * (F.col("lag") % 53)).alias("placed"), F.max(F.when(F.col("c") > 0, F.col("lag"))).alias("oldest"))


# calibration


def _val(spark, sf, column="z"):
    return _scored(spark, sf)[0].select(*KEYS, F.col(column).alias("score"), "y")


def _grid_sql(percents: list[float], negatives: bool = False, source: str = "sc", name: str = "g") -> str:
    listed = ", ".join(f"({k}, {p!r}, {p / 100!r})" for k, p in enumerate(percents))
    quant = "quantile_cont(score, g.q)"
    cases = " UNION ALL ".join(
        f"SELECT signal, {k} AS pos, {p!r} AS percent, " + (f"coalesce(quantile_cont(score, {p / 100!r}) FILTER (WHERE y = 0), quantile_cont(score, {p / 100!r}))" if negatives else f"quantile_cont(score, {p / 100!r})") + f" AS thr FROM {source} GROUP BY signal"
        for k, p in enumerate(percents))
    del listed, quant
    return f""", {name}t AS ({cases}),
{name} AS (SELECT t.signal, t.pos, t.percent, t.thr, sum(CASE WHEN y = 1 AND score >= thr THEN 1 ELSE 0 END) / nullif(sum(y), 0) AS sens, sum(CASE WHEN y = 0 AND score < thr THEN 1 ELSE 0 END) / nullif(sum(1 - y), 0) AS spec
 FROM {name}t t JOIN {source} USING (signal) GROUP BY ALL)"""


_SC = _scores_sql() + f", sc AS (SELECT signal, sim, t, {_Z} AS score, y FROM val)"
_OBJ = "2 * sens + 3 * spec"


def _first_sql(parts: list[tuple[str, str, str, str]], percent: str = "percent") -> str:
    """Rows of the first part that has any: (name, grid, condition, objective)."""
    unions = " UNION ALL ".join(f"SELECT {k} AS rank, '{n}' AS stage, signal, pos, {percent} AS percent, thr, sens, spec, CAST({o} AS DOUBLE) AS obj FROM {g} WHERE {c} AND ({o}) IS NOT NULL" for k, (n, g, c, o) in enumerate(parts))
    return f" SELECT signal, stage, round(percent, 6) AS percent, round(thr, 6) AS thr, round(sens, 6) AS sens, round(spec, 6) AS spec FROM ({unions}) QUALIFY row_number() OVER (PARTITION BY signal ORDER BY rank, obj DESC, pos) = 1"


@query(_SC + _grid_sql([100 - 100 * c for c in calibrate.CONTAMINATION]) + _grid_sql([100 - 100 * c for c in calibrate.CONTAMINATION_FALLBACK], name="h")
       + _first_sql([("main", "g", "spec >= 0.97", _OBJ), ("fallback", "h", "true", "spec")], "100 - percent"))
def tune_contamination(spark, sf):
    return _rounded(calibrate.contamination(_val(spark, sf)))


@query(_SC + _grid_sql([100 - p for p in calibrate.SVM_PERCENTILES]) + _first_sql([("main", "g", "spec >= 0.95", _OBJ), ("fallback", "g", "pos = 1", "0.0")]))
def tune_percentile(spark, sf):
    return _rounded(calibrate.percentiles(_val(spark, sf)))


def _two_sql(target: float) -> str:
    return _first_sql([("first", "g", f"spec >= {target}", _OBJ), ("second", "h", f"spec >= {target}", _OBJ), ("last", "h", "pos = 0", "0.0")])


@query(_SC + _grid_sql(calibrate.STAGE_1) + _grid_sql(calibrate.STAGE_2, name="h") + _two_sql(0.97))
def tune_two_stage(spark, sf):
    return _rounded(calibrate.two_stage(_val(spark, sf)))


# fixed values
MIXES = [(1.0, 0.0), (0.95, 0.05), (0.9, 0.1), (0.8, 0.2), (0.7, 0.3), (0.6, 0.4), (0.4, 0.6), (0.3, 0.7), (0.2, 0.8), (0.1, 0.9), (0.05, 0.95), (0.0, 1.0)]


def _mix_sql() -> str:
    parts = []
    for k, (a, b) in enumerate(MIXES):
        parts.append(f"SELECT signal * 100 + {k} AS signal, y, {a!r} * {_Z} + {b!r} * jump AS score FROM (SELECT *, d AS jump FROM val)")
    sc = ", sc AS (" + " UNION ALL ".join(parts) + ")"
    tuned = _two_sql(0.97).strip()
    return _scores_sql() + sc + _grid_sql(calibrate.STAGE_1) + _grid_sql(calibrate.STAGE_2, name="h") + f""", tuned AS ({tuned}),
k AS (SELECT signal // 100 AS sig, signal % 100 AS mix, stage, percent, thr, sens, spec, stage <> 'last' AND sens IS NOT NULL AND spec IS NOT NULL AS met FROM tuned)
SELECT CAST(sig AS INT) AS signal, CAST(mix AS INT) AS mix, stage, percent, thr, sens, spec FROM k QUALIFY row_number() OVER (PARTITION BY sig ORDER BY met DESC, CASE WHEN met THEN 2 * sens + 3 * spec ELSE spec END DESC NULLS LAST, mix) = 1"""


@query(_mix_sql())
def tune_mix(spark, sf):
    val = _scored(spark, sf)[0].select(*KEYS, "y", F.col("z").alias("mse"), F.col("jump").alias("peak"))
    return _rounded(calibrate.mixes(val, MIXES))


def _tail_sql(target: float, beta: bool) -> str:
    fb = "CASE WHEN 0.25 * s + p + 1e-12 <= 0 THEN 0.0 ELSE 1.25 * s * p / (0.25 * s + p + 1e-12) END"
    extra = ", CASE WHEN meets THEN fb END DESC NULLS LAST" if beta else ""
    return _grid_sql([100 - p for p in calibrate.TAIL_GRID], True) + f""", a AS (SELECT *, coalesce(sens, 0.0) AS s, coalesce(spec, 0.0) AS p FROM g), e AS (SELECT *, {fb} AS fb, p >= {target} AND s >= 0 AS meets FROM a),
tuned AS (SELECT signal, meets, 100 - percent AS percent, thr, s AS sens, p AS spec, fb AS f_beta FROM e QUALIFY row_number() OVER (PARTITION BY signal ORDER BY meets DESC, CASE WHEN meets THEN s END DESC NULLS LAST, CASE WHEN meets THEN p END DESC NULLS LAST{extra}, CASE WHEN meets THEN pos END, abs(p - {target}), p DESC, s DESC, pos) = 1)"""


_TUNED = " SELECT signal, meets, round(percent, 6) AS percent, round(thr, 6) AS thr, round(sens, 6) AS sens, round(spec, 6) AS spec, round(f_beta, 6) AS f_beta FROM tuned"


@query(_SC + _tail_sql(0.95, False) + _TUNED)
def tune_negative_tail(spark, sf):
    return _rounded(calibrate.negative_tail(_val(spark, sf), 0.95))


@query(_SC + _tail_sql(0.97, True) + _TUNED)
def tune_negative_tail_beta(spark, sf):
    return _rounded(calibrate.negative_tail(_val(spark, sf), 0.97, beta=0.5))


_TRAIN_SC = f", trs AS (SELECT signal, {_Z} AS score FROM (SELECT signal, x, avg(x) OVER {_W14} AS m, stddev_pop(x) OVER {_W14} AS s, row_number() OVER (PARTITION BY signal, sim ORDER BY t) AS rn FROM train) WHERE rn >= 14)"


@query(_SC + _tail_sql(0.95, False) + _TRAIN_SC + ", r AS (SELECT signal, quantile_cont(score, 0.95) AS rail FROM trs GROUP BY 1) SELECT r.signal, round(thr, 6) AS tuned, round(rail, 6) AS rail, round(greatest(thr, rail), 6) AS thr FROM r LEFT JOIN tuned USING (signal)")
def guard_rail(spark, sf):
    """Thresholds tuned on validation days, held up by a percentile of the scores of the train days."""
    tuned = calibrate.negative_tail(_val(spark, sf), 0.95)
    train = features.features4(slices.head(panel(spark, sf), TRAIN), 14)
    scores = train.select("signal", F.round((F.col("x") - F.col("mean")) / (F.col("std") + 1e-6), 9).alias("score"))
    return _rounded(calibrate.guard_rail(tuned, scores))


@query(_scores_sql() + f", q AS (SELECT signal, quantile_cont({_Z}, CASE signal WHEN 1 THEN 0.97 ELSE 0.95 END) AS thr FROM test GROUP BY 1) SELECT t.signal, sim, t, y, CASE WHEN {_Z} >= thr THEN 1 ELSE 0 END AS a FROM test t JOIN q USING (signal)".replace("quantile_cont(" + _Z + ", CASE signal WHEN 1 THEN 0.97 ELSE 0.95 END)", f"CASE signal WHEN 1 THEN quantile_cont({_Z}, 0.97) ELSE quantile_cont({_Z}, 0.95) END"))
def transductive_alarms(spark, sf):
    test = _scored(spark, sf)[1].select(*KEYS, F.col("z").alias("score"), "y")
    shares = spark.createDataFrame([(1, 3.0), (2, 5.0)], "signal int, percent double")
    return calibrate.transductive(test, shares).drop("score")


_CFG = _scores_sql() + ", sc AS (" + " UNION ALL ".join(f"SELECT signal * 100 + {k} AS signal, y, {e} AS score FROM val" for k, e in enumerate((_Z, _RATIO, "d"))) + ")"


@query(_CFG + _grid_sql(calibrate.STAGE_1) + _grid_sql(calibrate.STAGE_2, name="h") + f""", tuned AS ({_two_sql(0.97).strip()}), k AS (SELECT signal // 100 AS sig, signal % 100 AS config, sens, spec, CASE WHEN spec >= 0.97 THEN 2 * sens + 3 * spec ELSE spec END AS objective FROM tuned)
SELECT CAST(sig AS INT) AS signal, CAST(config AS INT) AS config, sens, spec, round(objective, 6) AS objective FROM k QUALIFY row_number() OVER (PARTITION BY sig ORDER BY objective DESC NULLS LAST, config) = 1""")
def config_select(spark, sf):
    val = _scored(spark, sf)[0]
    rows = [calibrate.two_stage(val.select(*KEYS, F.col(c).alias("score"), "y")).select("signal", F.lit(k).alias("config"), F.round("sens", 6).alias("sens"), F.round("spec", 6).alias("spec")) for k, c in enumerate(("z", "ratio", "jump"))]
    return _rounded(calibrate.choose_config(rows[0].unionByName(rows[1]).unionByName(rows[2]), 0.97))


_CHOSEN = ", chosen AS (SELECT CAST(sig AS INT) AS signal, CAST(config AS INT) AS config, thr FROM k QUALIFY row_number() OVER (PARTITION BY sig ORDER BY objective DESC NULLS LAST, config) = 1)"


@query(_CFG + _grid_sql(calibrate.STAGE_1) + _grid_sql(calibrate.STAGE_2, name="h") + f""", tuned AS ({_two_sql(0.97).strip()}), k AS (SELECT signal // 100 AS sig, signal % 100 AS config, thr, CASE WHEN spec >= 0.97 THEN 2 * sens + 3 * spec ELSE spec END AS objective FROM tuned){_CHOSEN}
SELECT t.signal, sim, t, config, y, CASE WHEN CASE config WHEN 0 THEN {_Z} WHEN 1 THEN {_RATIO} ELSE d END >= thr THEN 1 ELSE 0 END AS a FROM test t JOIN chosen USING (signal)""")
def chosen_config_alarms(spark, sf):
    """Thresholds and the configuration of each signal from validation days, alarms and labels of the test days."""
    val, test = _scored(spark, sf)
    stacked = lambda rows: rows.select(*KEYS, "y", F.posexplode(F.array("z", "ratio", "jump")).alias("config", "score"))
    keyed = stacked(val).select(F.struct("signal", "config").alias("signal"), "sim", "t", "score", "y")
    tuned = _rounded(calibrate.two_stage(keyed, 0.97).select("signal.signal", "signal.config", "thr", "sens", "spec"))
    return calibrate.apply_choice(stacked(test), calibrate.choose_config(tuned, 0.97)).drop("score")


_BESIDE = FULL.replace("WITH ev AS", ", ev AS", 1)
_MSE = f", trm AS (SELECT signal, {_Z} * {_Z} AS mse FROM (SELECT signal, x, avg(x) OVER {_W14} AS m, stddev_pop(x) OVER {_W14} AS s, row_number() OVER (PARTITION BY signal, sim ORDER BY t) AS rn FROM train) WHERE rn >= 14)"


@query("WITH mixed AS (" + _mix_sql().strip().replace("FROM val)", "FROM val WHERE signal = 1)") + ")" + _BESIDE + _MSE + """ SELECT signal, mix, stage, CAST(percent AS DOUBLE) AS percent, thr, sens, spec FROM mixed
UNION ALL SELECT signal, 3, 'default', CAST(95 AS DOUBLE), round(quantile_cont(mse, 0.95), 6), NULL, NULL FROM trm WHERE signal NOT IN (SELECT signal FROM mixed) GROUP BY signal""")
def mix_without_validation(spark, sf):
    """The best mix of a signal with validation days; a signal without any gets the default mix and a percentile of its train errors."""
    val = _scored(spark, sf)[0].where("signal = 1").select(*KEYS, "y", F.col("z").alias("mse"), F.col("jump").alias("peak"))
    train = features.features4(slices.head(panel(spark, sf), TRAIN), 14)
    z = F.round((F.col("x") - F.col("mean")) / (F.col("std") + 1e-6), 9)
    return _rounded(calibrate.with_default(calibrate.mixes(val, MIXES), train.select("signal", (z * z).alias("mse")), MIXES.index((0.8, 0.2))))


# metrics


@query(_scores_sql() + " SELECT signal, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(100 * avg(y), 6) AS rate FROM test GROUP BY signal")
def positives_report(spark, sf):
    return _rounded(metrics.positives(_scored(spark, sf)[1]))


_AL = _scores_sql() + f", al AS (SELECT signal, sim, t, y, CASE WHEN {_Z} >= 1.5 THEN 1.0 WHEN x = 0 THEN 1e-300 ELSE 0.0 END AS a FROM test)"
_PER = """, ps AS (SELECT signal, sim, sum(CASE WHEN a = 1 AND y > 0 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN a = 1 AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN a = 0 AND y = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN a = 0 AND y > 0 THEN 1 ELSE 0 END) AS fn,
 sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS quiet, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS outbreak, count(*) AS n, min(CASE WHEN y > 0 THEN t END) AS first, max(CASE WHEN y > 0 THEN t END) AS last, min(CASE WHEN a = 1 AND y > 0 THEN t END) AS hit FROM al GROUP BY ALL)"""
_POD = "round(avg(CASE WHEN hit IS NULL THEN 0.0 ELSE 1.0 END), 6) AS pod, round(sum(coalesce((hit - first) / (last - first + 1), 1.0)) / count(*), 6) AS timeliness"


def _alarmed(spark, sf):
    test = _scored(spark, sf)[1]
    return test.select(*KEYS, "y", F.when(F.col("z") >= 1.5, 1.0).when(F.col("x") == 0, 1e-300).otherwise(0.0).alias("a"))


@query(_AL + _PER + " SELECT signal, sim, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn FROM ps")
def confusion_per_sim(spark, sf):
    return metrics.per_sim(_alarmed(spark, sf)).select("signal", "sim", "tp", "fp", "tn", "fn")


@query(_AL + _PER + """, w AS (SELECT signal, sim, sum(CASE WHEN t BETWEEN 2205 AND 2547 AND y = 0 THEN 1 ELSE 0 END) AS n0, sum(y) AS p, min(CASE WHEN t BETWEEN 2205 AND 2547 AND y > 0 THEN t END) AS f1, max(CASE WHEN t BETWEEN 2205 AND 2547 AND y > 0 THEN t END) AS l1 FROM panel GROUP BY ALL)
SELECT signal, round(sum(tp) / sum(p), 6) AS sensitivity, round(sum(tn) / sum(n0), 6) AS specificity, round(sum(fp) / sum(n0), 6) AS fpr, """ + _POD.replace("(hit - first) / (last - first + 1)", "(hit - f1) / (l1 - f1 + 1)") + " FROM ps JOIN w USING (signal, sim) GROUP BY signal")
def metrics_r(spark, sf):
    return _rounded(metrics.comparator(_alarmed(spark, sf), panel(spark, sf)))


@query(_AL + _PER + " SELECT signal, round(sum(tp) / sum(outbreak), 6) AS sensitivity, round(sum(tn) / sum(quiet), 6) AS specificity, round(sum(fp) / sum(quiet), 6) AS fpr, " + _POD + " FROM ps GROUP BY signal")
def metrics_tail(spark, sf):
    return _rounded(metrics.tail_only(_alarmed(spark, sf)))


_ORIGINAL = " SELECT signal, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS sensitivity, round(sum(tn) / nullif(sum(tn) + sum(fp), 0), 6) AS specificity, " + _POD + " FROM ps GROUP BY signal"


@query(_AL + _PER + _ORIGINAL)
def metrics_original(spark, sf):
    return _rounded(metrics.original(_alarmed(spark, sf)))


_EACH = "signal, sim, round(tp / nullif(tp + fn, 0), 6) AS sens, round(tn / nullif(tn + fp, 0), 6) AS spec, CASE WHEN outbreak > 0 THEN CASE WHEN hit IS NULL THEN 0.0 ELSE 1.0 END END AS pod, round(CASE WHEN outbreak > 0 THEN coalesce((hit - first) / (last - first + 1), 1.0) END, 6) AS timeliness, n AS n_points"


@query(_AL + _PER + f" SELECT {_EACH} FROM ps")
def metrics_per_sim(spark, sf):
    return _rounded(metrics.each_sim(_alarmed(spark, sf)))


@query(_AL + _PER + f", s AS ({_ORIGINAL.strip()}) SELECT round(avg(sensitivity), 6) AS sensitivity, round(avg(specificity), 6) AS specificity, round(avg(pod), 6) AS pod, round(avg(timeliness), 6) AS timeliness FROM s")
def summary_means(spark, sf):
    return _rounded(metrics.means(_rounded(metrics.original(_alarmed(spark, sf))), ["sensitivity", "specificity", "pod", "timeliness"]))


_SETS = _AL.replace(", al AS (", ", al0 AS (") + ", al AS (SELECT signal, label_set AS sim0, label_set || ' ' || sim AS sim, t, a, CASE WHEN label_set = 'regular' THEN y ELSE CASE WHEN (t + 50) % 170 < 20 THEN 1 ELSE 0 END END AS y FROM al0, (VALUES ('regular'), ('seasonal')) v(label_set) WHERE label_set = 'regular' OR signal = 2)"


@query(_SETS + _PER + " SELECT signal, split_part(sim, ' ', 1) AS label_set, round(sum(tp) / sum(outbreak), 6) AS sensitivity, round(sum(tn) / sum(quiet), 6) AS specificity, round(sum(fp) / sum(quiet), 6) AS fpr, " + _POD + " FROM ps GROUP BY ALL")
def metrics_seasonal_labels(spark, sf):
    regular = _alarmed(spark, sf).withColumn("label_set", F.lit("regular"))
    seasonal = regular.where("signal = 2").withColumn("label_set", F.lit("seasonal")).withColumn("y", ((F.col("t") + 50) % 170 < 20).cast("int"))
    return _rounded(metrics.tail_only(regular.unionByName(seasonal), ("signal", "label_set")))


# ensembles


def _tuned_of(k: int, expression: str) -> str:
    body = _tail_sql(0.95, False)
    for name in ("gt", "g", "a", "e", "tuned"):
        body = body.replace(f", {name} AS (", f", {name}{k} AS (").replace(f"\n{name} AS (", f"\n{name}{k} AS (")
    body = body.replace("FROM gt t JOIN sc", f"FROM gt{k} t JOIN sc{k}").replace(" FROM sc GROUP", f" FROM sc{k} GROUP").replace("FROM g)", f"FROM g{k})").replace("FROM a)", f"FROM a{k})").replace("FROM e QUALIFY", f"FROM e{k} QUALIFY")
    return f", sc{k} AS (SELECT signal, sim, t, {expression} AS score, y FROM val)" + body


_THREE = _scores_sql() + _tuned_of(0, _Z) + _tuned_of(1, _RATIO) + _tuned_of(2, "d")
_NAMES = ("z", "ratio", "jump")


def _three(spark, sf):
    val, test = _scored(spark, sf)
    return val, test, [calibrate.negative_tail(val.select(*KEYS, F.col(c).alias("score"), "y"), 0.95) for c in _NAMES]


@query(_THREE + ", c AS (" + " UNION ALL ".join(f"SELECT {k} AS candidate, '{n}' AS detector, * FROM tuned{k}" for k, n in enumerate(_NAMES)) + """) SELECT signal, CAST(candidate AS INT) AS candidate, detector, meets, round(percent, 6) AS percent, round(thr, 6) AS thr, round(sens, 6) AS sens, round(spec, 6) AS spec, round(f_beta, 6) AS f_beta FROM c
QUALIFY row_number() OVER (PARTITION BY signal ORDER BY meets DESC, sens DESC NULLS LAST, spec DESC NULLS LAST, f_beta DESC NULLS LAST, candidate) = 1""")
def choose_per_signal(spark, sf):
    tuned = _three(spark, sf)[2]
    rows = [t.select("signal", F.lit(k).alias("candidate"), F.lit(n).alias("detector"), "meets", "percent", "thr", "sens", "spec", "f_beta") for k, (n, t) in enumerate(zip(_NAMES, tuned))]
    return _rounded(ensemble.choose(rows[0].unionByName(rows[1]).unionByName(rows[2])))


_VOTE = _THREE + f", al AS (SELECT t.signal, sim, t, CASE WHEN (CASE WHEN {_Z} >= t0.thr THEN 1 ELSE 0 END) + (CASE WHEN {_RATIO} >= t1.thr THEN 1 ELSE 0 END) + (CASE WHEN d >= t2.thr THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE 0 END AS a, y FROM test t JOIN tuned0 t0 USING (signal) JOIN tuned1 t1 USING (signal) JOIN tuned2 t2 USING (signal))"


def _voted(spark, sf):
    _, test, tuned = _three(spark, sf)
    parts = [calibrate.alarms(test.select(*KEYS, F.col(n).alias("score"), "y"), t).withColumn("detector", F.lit(n)) for n, t in zip(_NAMES, tuned)]
    return ensemble.vote(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(_VOTE + " SELECT signal, sim, t, a, y FROM al")
def vote_2of3(spark, sf):
    return _voted(spark, sf)


@query(_VOTE + _PER + _ORIGINAL)
def vote_metrics(spark, sf):
    return _rounded(metrics.original(_voted(spark, sf)))


@query(_scores_sql() + f""", u AS (SELECT signal, 'z' AS detector, {_Z} AS score, y, sim, t FROM val UNION ALL SELECT signal, 'jump', d, y, sim, t FROM val WHERE rn >= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY signal, detector ORDER BY sim DESC, t DESC) AS back FROM u)
SELECT a.signal, a.back, a.y, round(a.score, 6) AS z, round(b.score, 6) AS jump FROM r a JOIN r b ON a.signal = b.signal AND a.back = b.back AND a.detector = 'z' AND b.detector = 'jump'""")
def vote_global_tail_align(spark, sf):
    val = _scored(spark, sf)[0]
    short = slices.warmed_up(val, 7).select(*KEYS, F.lit("jump").alias("detector"), F.col("jump").alias("score"), "y")
    both = val.select(*KEYS, F.lit("z").alias("detector"), F.col("z").alias("score"), "y").unionByName(short)
    got = ensemble.align_global_tail(both, ["z", "jump"])
    return _rounded(got.withColumn("back", F.col("back").cast("long")))


@query(_VOTE.replace("FROM test t JOIN", "FROM val t JOIN") + _PER + f" SELECT {_EACH} FROM ps")
def vote_on_validation(spark, sf):
    """Metrics per series of the vote on the validation days that the thresholds were tuned on."""
    val, _, tuned = _three(spark, sf)
    parts = [calibrate.alarms(val.select(*KEYS, F.col(n).alias("score"), "y"), t).withColumn("detector", F.lit(n)) for n, t in zip(_NAMES, tuned)]
    return _rounded(metrics.each_sim(ensemble.vote(parts[0].unionByName(parts[1]).unionByName(parts[2]))))


@query(_scores_sql() + ", n AS (SELECT signal, count(*) AS n FROM val GROUP BY 1 UNION ALL SELECT signal, count(*) FROM val WHERE rn >= 20 GROUP BY 1) SELECT signal, min(n) AS length, 20 AS window FROM n GROUP BY signal")
def common_span(spark, sf):
    val = _scored(spark, sf)[0]
    both = val.select("signal", F.lit("z").alias("detector")).unionByName(slices.warmed_up(val, 7).select("signal", F.lit("jump").alias("detector")))
    return ensemble.common_span(both, {"z": 14, "jump": 20})


# detectors


@query()
def farrington_alarms(spark, sf):
    return farrington.detect(panel(spark, sf))


@query()
def farrington_alarms_b(spark, sf):
    """The second variant, with a reported trend of 0."""
    return farrington.detect(panel(spark, sf), trend=False, variant="b")


@query()
def farrington_trace(spark, sf):
    """The same results by a table function, as SQL calls it: one partition a series, in the order of days."""
    farrington.register(spark)
    panel(spark, sf).select(*KEYS, "x").createOrReplaceTempView("pulsewarden_panel")
    return spark.sql("SELECT * FROM farrington_trace(TABLE(pulsewarden_panel) PARTITION BY (signal, sim) ORDER BY t)")


@query(WEEKS + """, r AS (SELECT *, avg(cases) OVER (PARTITION BY signal, sim) AS mu FROM wk), s AS (SELECT *, 1.5 * (pow(cases, 2.0 / 3) * pow(mu, -1.0 / 6) - sqrt(mu)) / sqrt(1.2) AS s FROM r),
w AS (SELECT *, CASE WHEN s > 2.58 THEN 1 / (s * s) ELSE 1.0 END AS w FROM s) SELECT signal, sim, week, round(w * count(*) OVER v / sum(w) OVER v, 6) AS weight FROM w WINDOW v AS (PARTITION BY signal, sim)""")
def farrington_weights(spark, sf):
    """Weights of the weeks of each series around its mean, with a dispersion of 1.2 and no leverage."""
    def weigh(part):
        y = part["cases"].to_numpy()[None, :]
        full = lambda v: np.full(y.shape, float(v))
        weight = farrington.down_weights(y, full(y.mean()), np.array([1.2]), full(0), np.ones(y.shape, bool))[0]
        return part[["signal", "sim", "week"]].assign(weight=weight)

    weeks = features.weekly(panel(spark, sf), _K)
    return _rounded(weeks.groupBy("signal", "sim").applyInPandas(weigh, "signal int, sim string, week int, weight double"))


def _vectors(spark, sf, names=features.NAMES20):
    """(train, test) rows of the features of 14 days as arrays, standardised on train."""
    p = panel(spark, sf)
    train, test = (features.by_windows(rows, (14,), names) for rows in (slices.head(p, TRAIN), slices.tail(p, TAIL)))
    return tuple(features.standardise_arrays(rows, train, ["signal"]).select(*KEYS, "features") for rows in (train, test))


@query()
def iforest_scores(spark, sf):
    train, test = _vectors(spark, sf)
    return forest.IsolationForest([forest.Config(200, 0.9, 0.6)]).fit(train).score(test).drop("config")


@query()
def ocsvm_scores(spark, sf):
    train, test = _vectors(spark, sf, features.NAMES4)
    return ocsvm.OneClassSVM([0.05]).fit(train).score(test).drop("config")


def _autoencoder(p, splits):
    """Autoencoders of the train days of train series, which stop by the loss on the last days of validation series.

    They are narrower than the default and take longer steps, as an epoch here is one step over all sequences.
    """
    train = features.sequences(slices.head(slices.restrict(p, splits, "train"), TRAIN)).withColumn("held", F.lit(False))
    val = features.sequences(slices.tail(slices.restrict(p, splits, "val"), TAIL, 13)).withColumn("held", F.lit(True))
    rows = tables.committed(train.unionByName(val).select("signal", "held", "seq"), "sequences")
    return recurrent.SequenceAutoencoder(bilstm.Shape(14, (16, 8), 4, (0.1, 0.1)), epochs=30, rate=0.02, floor=10).fit(rows)


@query()
def seq_recon_scores(spark, sf):
    p = panel(spark, sf)
    return _autoencoder(p, slices.split_sims(p)).score(features.sequences(slices.tail(p, TAIL, 13)))


@query()
def seq_linear_scores(spark, sf):
    """The linear counterpart of the recurrent model, one for all signals."""
    p = panel(spark, sf)
    model = detectors.SequenceReconstructor().fit(features.sequences(slices.head(p, TRAIN)))
    return model.score(features.sequences(slices.warmed_up(slices.tail(p, TAIL, 13), 1)))


def _searched(spark, sf, name):
    """The whole grid of a detector: every configuration fitted, tuned on validation series, the best applied to test series."""
    p = panel(spark, sf)
    splits = tables.committed(slices.split_sims(p), "splits")
    if name == "iforest":
        grid, names, tune, target = search.FOREST_GRID, features.NAMES20, calibrate.contamination, 0.97
        detector = forest.IsolationForest([forest.Config(*g[1:]) for g in grid])
    else:
        grid, names, tune, target = search.SVM_GRID, features.NAMES4, calibrate.percentiles, 0.95
        detector = ocsvm.OneClassSVM([g[1] for g in grid])
    train, rows = search.inputs(p, splits, [g[0] for g in grid], names, TRAIN, TAIL)
    return search.search(detector, train, rows, p, splits, tune, target, grid)


@query()
def iforest_search(spark, sf):
    return _searched(spark, sf, "iforest").alarms


@query()
def ocsvm_search(spark, sf):
    return _searched(spark, sf, "ocsvm").alarms


@query()
def ensemble_full(spark, sf):
    """Isolation forest, one-class SVM and recurrent reconstruction, voted: metrics per signal.

    Detectors are fitted on the train days of train series, thresholds tuned on the last days of validation series,
    and alarms are those of test series. Scores of both are written once.
    """
    p = panel(spark, sf)
    labels, splits = p.select(*KEYS, "y"), tables.committed(slices.split_sims(p), "splits")
    scored = []
    for detector, names in ((forest.IsolationForest([forest.Config(200, 0.9, 0.6)]), features.NAMES20), (ocsvm.OneClassSVM([0.05]), features.NAMES4)):
        train, rows = search.inputs(p, splits, [14], names, TRAIN, TAIL)
        scored.append(detector.fit(train).score(rows).drop("config"))
    scored.append(_autoencoder(p, splits).score(features.sequences(slices.tail(p, TAIL, 13))))
    every = scored[0].withColumn("detector", F.lit(0)).unionByName(scored[1].withColumn("detector", F.lit(1))).unionByName(scored[2].withColumn("detector", F.lit(2)))
    held = tables.committed(every.join(labels, KEYS), "ensemble-scores")
    keyed = slices.restrict(held, splits, "val").select(F.struct("signal", "detector").alias("signal"), "sim", "t", "score", "y")
    tuned = calibrate.negative_tail(keyed, 0.95).select("signal.signal", "signal.detector", "thr")
    alarms = slices.restrict(held, splits, "test").join(F.broadcast(tuned), ["signal", "detector"])
    return metrics.original(ensemble.vote(alarms.select(*KEYS, "detector", (F.col("score") >= F.col("thr")).cast("int").alias("a"), "y")))


@query(FULL + f", b AS (SELECT *, row_number() OVER (PARTITION BY signal, sim ORDER BY t) AS rn, avg(x) OVER {_W14} AS m, stddev_pop(x) OVER {_W14} AS s FROM tail), sc AS (SELECT signal, sim, t, y, round((x - m) / (s + 1e-6), 9) AS score FROM b WHERE rn >= 14), q AS (SELECT signal, quantile_cont(score, 0.95) AS thr FROM sc GROUP BY 1), al AS (SELECT sc.signal, sim, t, y, CASE WHEN score >= thr THEN 1 ELSE 0 END AS a FROM sc JOIN q USING (signal))" + _PER + f" SELECT {_EACH} FROM ps")
def surveillance_slice(spark, sf):
    """Panel, four features on the tail, z score, percentile threshold, alarms, metrics per series."""
    tail = slices.tail(panel(spark, sf), TAIL)
    scored = features.features4(tail, 14).join(tail.select(*KEYS, "y"), KEYS).select(*KEYS, "y", F.round((F.col("x") - F.col("mean")) / (F.col("std") + 1e-6), 9).alias("score"))
    return _rounded(metrics.each_sim(calibrate.alarms(scored, order.percentile(scored, 0.95, "thr"))))
