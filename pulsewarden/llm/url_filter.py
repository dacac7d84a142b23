"""URL filters: allow and block rules by host and path prefix, and gradient-boosted trees for the rest.

All features are lexical and computed by SQL functions; the trees are those of Spark ML, which run in the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewarden.llm import shared

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio", "host_digit_ratio",
    "hyphens", "host_entropy", "url_entropy", "parameters", "has_fragment", "ends_in_slash", "secure", "suffix_rate", "suffix_known",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end.

    Both are empty for a null url or one without ://. Characters may be of any kind, line breaks included.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    after = rest.substr(F.length(host) + 1, F.length(rest))
    path = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.translate(host, _UPPER, _LOWER), path


def apply_rules(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule ('host/path' or null) and rule_verdict: of the fitting rules the longest, of equals the first.

    A rule (verdict, host, path prefix) fits its host and all subdomains. Rules are few and become one
    expression; no join is made.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):  # the last that fits counts
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of all characters of a string, from the runs of equal ones once they are sorted."""
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    share = F.transform(runs, lambda run: F.length(run) / F.length(text).cast("double"))
    return F.when(F.length(text) > 0, -F.aggregate(share, F.lit(0.0), lambda s, p: s + p * F.log2(p))).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical(rows: DataFrame) -> DataFrame:
    """Lexical feature columns of url, host, path, over the whole strings."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.when(F.instr(url, "?") > 0, F.substring_index(url.substr(F.instr(url, "?") + 1, F.length(url)), "#", 1)).otherwise(F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    return rows.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        F.length(query).cast("double").alias("query_length"),
        _count(F.col("path"), "/[^/]").alias("depth"),
        F.size(F.split("host", "[.]")).cast("double").alias("labels"),
        (_count(url, "[0-9]") / size).alias("digit_ratio"),
        (_count(F.col("host"), "[0-9]") / F.greatest(F.length("host"), F.lit(1))).alias("host_digit_ratio"),
        _count(F.col("host"), "-").alias("hyphens"),
        _entropy(F.col("host")).alias("host_entropy"),
        _entropy(url).alias("url_entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1).alias("parameters"),
        (F.instr(url, "#") > 0).cast("double").alias("has_fragment"),
        F.col("path").endswith("/").cast("double").alias("ends_in_slash"),
        url.startswith("https:").cast("double").alias("secure"),
        F.substring_index("host", ".", -1).alias("suffix"),
    )


class Filter:
    """Rules, boosted trees and suffix statistics fitted on labelled URLs."""

    def __init__(self, rules: list[tuple[str, str, str]], *, bound: int = 20_000, trees: int = 12, depth: int = 4, prior: float = 20.0, folds: int = 5, broadcast_rows: int = 200_000):
        self.rules, self.bound, self.trees, self.depth = rules, bound, trees, depth
        self.prior, self.folds, self.broadcast_rows = prior, folds, broadcast_rows
        self.model, self.suffixes, self.base = None, None, 0.0
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")

    def _with_suffix_rate(self, rows: DataFrame, held_out: bool = False) -> DataFrame:
        """Share of blocked URLs by host suffix, drawn towards the overall share.

        With held_out, rates are those of the other folds: of labelled rows none counts its own label.
        """
        whole = self.suffixes.groupBy("suffix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        small = whole.limit(self.broadcast_rows + 1).count() <= self.broadcast_rows
        out = rows.join(F.broadcast(whole) if small else whole, "suffix", "left")
        b, n = F.coalesce("b", F.lit(0.0)), F.coalesce("n", F.lit(0))
        if held_out:
            own = self.suffixes.select("suffix", F.col("fold"), F.col("b").alias("b_own"), F.col("n").alias("n_own"))
            out = out.withColumn("fold", self._fold()).join(own, ["suffix", "fold"], "left")
            b, n = b - F.coalesce("b_own", F.lit(0.0)), n - F.coalesce("n_own", F.lit(0))
        return out.withColumn("suffix_rate", F.coalesce(F.try_divide(b + self.prior * self.base, n + self.prior), F.lit(self.base))).withColumn("suffix_known", (n > 0).cast("double"))

    def _fold(self) -> Column:
        return F.pmod(F.xxhash64(F.lit("fold"), F.col("url")), F.lit(self.folds))

    def fit(self, labelled: DataFrame) -> "Filter":
        """Fit on (url, blocked) rows: suffix rates on all of them, trees on `bound` different ones, those whose urls hash lowest.

        Rows that repeat a url and label are one with their number as weight. Null labels and urls are left out.
        Without both labels among the rows no trees are grown, and every URL that no rule decides gets the commoner
        label (allow if there are none).
        """
        some = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()).groupBy("url", F.col("blocked").cast("double").alias("blocked")).agg(F.count("*").cast("double").alias("weight"))
        host, path = host_and_path(F.col("url"))
        some = some.withColumn("host", host).withColumn("path", path)
        suffix = F.substring_index("host", ".", -1).alias("suffix")
        stats = some.groupBy(suffix, self._fold().alias("fold")).agg(F.sum(F.col("blocked") * F.col("weight")).alias("b"), F.sum("weight").cast("long").alias("n"))
        self.suffixes = shared.cut(stats, "suffixes")
        blocked, count = self.suffixes.agg(F.coalesce(F.sum("b"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).head()
        self.base = blocked / count if count else 0.0
        rows = shared.cut(self._with_suffix_rate(lexical(some.orderBy(F.xxhash64("url"), "url", "blocked").limit(self.bound)), True).select(*FEATURES, "blocked", "weight"), "labelled-urls")
        least, most = rows.agg(F.min("blocked"), F.max("blocked")).head()
        if least is not None and least != most:
            ready = self.assembler.transform(rows).select("features", "blocked", "weight")
            self.model = GBTClassifier(labelCol="blocked", weightCol="weight", maxIter=self.trees, maxDepth=self.depth, seed=7).fit(ready)
        return self

    def judge(self, pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
        """(page_id, host, path, rule, verdict, blocked_score) of every row; nulls count as empty urls."""
        host, path = host_and_path(F.col("url"))
        rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
        rows = apply_rules(rows, self.rules)
        if self.model is None:
            score = F.lit(float(self.base))
            scored = rows.withColumn("blocked_score", score)
        else:
            from pyspark.ml.functions import vector_to_array

            featured = self.assembler.transform(self._with_suffix_rate(lexical(rows)))
            scored = self.model.transform(featured).withColumn("blocked_score", vector_to_array("probability")[1])
        own = F.when(F.col("blocked_score") > 0.5, BLOCK).otherwise(ALLOW)
        return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "blocked_score")


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str, str]], *, url_col: str = "url") -> DataFrame:
    """(url, blocked) of the URLs that rules decide: the labelled URLs the trees learn from."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).withColumn("host", host).withColumn("path", path)
    ruled = apply_rules(rows, rules).where(F.col("rule").isNotNull())
    return ruled.select("url", (F.col("rule_verdict") == BLOCK).cast("double").alias("blocked"))


#: The rules of the query.
RULES = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]
