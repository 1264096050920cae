"""URL filters against plain string tests of every rule."""

import random

from prospectra.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "http:///x", "http://COM/", "http://com", "HTTP://Www.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/en", "https://notexample.com/en/1",
    "http://a.b.example.com/en/1", "http://x.net/es/", "http://x.net/fr/a?b", "http://x.net/de/", "http://.com/", "http://x..com/", "http://example.com:80/en/", "x://y://z.com/",
    "http://www.example.com?/en/", "http://www.example.com#/en/", "http://é.com/ü", "http://İ.COM/", "http://xn--a.com/\n/en/", "http://com./", "ftp://u@net/es/1", "://net/es/", "http://" + "a." * 3000 + "net/fr/" + "p/" * 3000,
]


def plain(url, rules, default="allow"):
    """(host, path, rule, verdict) by looking at every rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h) + len(p), len(h), v == "block", h, p, v) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return (host, path, best[3] + best[4], best[5]) if best else (host, path, None, default)


def got(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_against_every_rule(spark):
    rng = random.Random(1)
    urls = URLS + [f"http://{'.'.join(rng.choice('abc') for _ in range(rng.randint(1, 5)))}/{'/'.join(rng.choice('xyz') for _ in range(rng.randint(0, 4)))}" for _ in range(200)]
    rows = list(enumerate(urls)) + [(5, URLS[5]), (None, URLS[7]), (None, None), (8, URLS[8])]
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in rows], "page_id long, url string, host string, rule_verdict string").repartition(3)
    assert got(U.judge(pages, U.rule_table(spark))) == sorted(repr((k, *plain(u, U.RULES))) for k, u in rows)
    many = [(".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), "/" + "/".join(rng.choice("xyz") for _ in range(rng.randint(0, 3))), rng.choice(("allow", "block"))) for _ in range(80)]
    many = list({(h, p): (h, p, v) for h, p, v in many}.values()) + [("b", "", "block"), ("c", "/x/", "allow"), (None, "/", "block"), ("a", None, "block")]
    for most in (U.BROADCAST_RULES, 1):
        U.BROADCAST_RULES, kept = most, U.BROADCAST_RULES
        assert got(U.judge(pages, spark.createDataFrame(many, "host string, path string, verdict string"), "block")) == sorted(repr((k, *plain(u, many, "block"))) for k, u in rows)
        U.BROADCAST_RULES = kept


def test_ties_empty_tables_and_filter(spark):
    pages = spark.createDataFrame([(k, u, "t") for k, u in enumerate(URLS)], "page_id long, url string, blocked_url string")
    twice = spark.createDataFrame([("com", "/", "allow"), ("COM", "/", "block"), ("com", "/", "allow")], "host string, path string, verdict string")
    verdicts = {r.page_id: r.verdict for r in U.judge(pages, twice).collect()}
    assert verdicts[5] == "block" and verdicts[0] == "allow"
    none = twice.limit(0)
    assert {(r.rule, r.verdict) for r in U.judge(pages, none).collect()} == {(None, "allow")}
    assert U.judge(pages.limit(0), twice).collect() == []
    kept = {k for k, u in enumerate(URLS) if plain(u, U.RULES)[3] == "allow"}
    left = U.allowed(pages, U.rule_table(spark))
    assert left.columns == pages.columns and {r.page_id for r in left.collect()} == kept
    strict = {k for k, u in enumerate(URLS) if plain(u, U.RULES, "block")[3] == "allow"}
    assert {r.page_id for r in U.allowed(pages, U.rule_table(spark), "block").collect()} == strict


def test_the_rules_are_broadcast_and_html_is_not_read(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "http://a.com/", "<p>")], "page_id long, url string, html string").write.parquet(path)
    plan = U.judge(spark.read.parquet(path), U.rule_table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan.split("Relation")[0]
