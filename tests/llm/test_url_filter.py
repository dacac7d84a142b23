from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsewarden.llm import url_filter as u

def host_path_rule(url: str | None, rules=tuple(u.RULES)) -> tuple[str, str, str | None, str | None]:
    """Reference for tests: (host, path, rule, verdict of the rule)."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        rest = ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    cut = min(ends, default=len(rest))
    host, after = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = after[: min([after.find(c) for c in "?#" if c in after], default=len(after))]
    fit = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None, key=lambda x: x[0])  # of equals the first
    return host, path, best and best[1], best and best[2]


ODD = [None, "", "no mark", "http://", "HTTP://WWW.Example.COM/en/1", "https://a.net/es/x?y=1#z", "a://b://c/d", "http://x.net", "http://net/fr/", "http://xnet/fr/", "http://www.example.com/en", "x://É.COM/é?q", "http://a.com?x=/en/", "http://b.com/\nq#/", "http://q.example.com/en/" + "z" * 30000]


def check(spark, urls):
    pages = spark.createDataFrame([(k, x, "h") for k, x in enumerate(urls)], "page_id long, url string, host string")
    labelled = u.labelled_by_rules(pages, u.RULES)
    model = u.Filter(u.RULES, trees=2).fit(labelled)
    for row in model.judge(pages).collect():
        host, path, rule, verdict = host_path_rule(urls[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if verdict else row.verdict in ("allow", "block")
    return model


def test_rules_and_odd_urls(spark):
    check(spark, ODD + ODD)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(st.sampled_from("ahtp:/?#.=&- éZ\n")) | st.sampled_from(ODD), min_size=1, max_size=60))
def test_any_urls(spark, urls):
    check(spark, urls)


def test_learns_and_empty(spark):
    rows = [(f"https://site{k}.example/{'a' * (k % 9)}", 0.0) for k in range(300)] + [(f"http://x{k}{k * 7919}-9.bad/q?a=1&b={k}&c=2", 1.0) for k in range(300)]
    labelled = spark.createDataFrame(rows, "url string, blocked double")
    model = u.Filter([], trees=4).fit(labelled)
    held = spark.createDataFrame([(1, "http://x77123-9.bad/q?a=1&b=5&c=2"), (2, "https://site991.example/aaa"), (None, None)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in model.judge(held).collect()}
    assert got[1] == "block" and got[2] == "allow" and None in got
    empty = labelled.limit(0)
    assert u.Filter([]).fit(empty).judge(held.limit(0)).collect() == []


def test_features_look_at_whole_strings_and_ties_go_to_the_first(spark):
    import math
    from collections import Counter

    rng = __import__("random").Random(4)
    urls = ["", "aab", "http://é\n☃☃.x/" + "".join(rng.choice("abcdefgh0123") for _ in range(5000)) + "z" * 3000]
    rows = spark.createDataFrame([(x, "", "") for x in urls], "url string, host string, path string")
    for row in u.lexical(rows).collect():
        counts = Counter(row.url).values()
        assert abs(row.url_entropy - sum(-n / len(row.url) * math.log2(n / len(row.url)) for n in counts)) < 1e-9
    rules = [("allow", "com", "/"), ("block", "com", "/")]
    pages = spark.createDataFrame([(1, "http://com/")], "page_id long, url string")
    assert u.Filter(rules).fit(u.labelled_by_rules(pages, rules)).judge(pages).head().verdict == "allow"


def test_suffix_rates_of_all_suffixes_leave_out_the_own_fold(spark):
    rows = [(f"http://h{k}.s{k % 700}/", float(k % 700 < 350)) for k in range(2100)]
    model = u.Filter([], trees=1, prior=0.0).fit(spark.createDataFrame(rows + rows[:1] * 50, "url string, blocked double"))
    assert model.suffixes.select("suffix").distinct().count() == 700
    one = spark.createDataFrame([("http://q.alone/", "q.alone", "alone")], "url string, host string, suffix string")
    assert model._with_suffix_rate(one.withColumn("suffix", F.lit("s1"))).head().suffix_rate == 1.0
    assert model._with_suffix_rate(one).head().suffix_known == 0.0
