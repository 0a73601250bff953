"""URL filters against a loop over rules, and cascades against sets."""

import numpy as np

from axisframe.llm import queries, urlfilter

RULES = [*queries.URL_RULES, ("a.b", None, "allow"), ("a.b", "", "block"), ("", "/", "block"), (None, "/x", "block"), ("b", "/deep/er", "allow")]
LISTED = ["bad.net", "worse.example.com", "bad.net", "", None]


def _plain(rows, rules, listed):
    rules = [(h, p or "", v) for h, p, v in rules if h]
    listed = {h for h in listed if h}
    out = []
    for key, url in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            tail = rest[cut:]
            path = tail[: min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))]
        under = lambda h: host == h or host.endswith("." + h)  # noqa: B023, E731
        fits = [(len(h + p), h + p, v == "block") for h, p, v in rules if under(h) and path.startswith(p)]
        rule, blocks = max(fits)[1:] if fits else (None, any(under(h) for h in listed))
        out.append((key, host, path, rule, "block" if blocks else "allow"))
    return sorted(out, key=str)


URLS = [
    "http://x.example.org/es/1", "http://example.org/en/148.html?q#f", "HTTP://Www.Example.ORG/EN/1", "https://notexample.org/es/", "http://org/", "http://org", "http://a.com/fr/", "http://com/de/x",
    "http://a.com/it/", "http://bad.net/", "http://www.bad.net?x=/fr/", "http://notbad.net/", "http://worse.example.com#a", "http://worse.example.com/fr/1", "no scheme", "", None, "://", "x://y://z/es/",
    "http://a.b", "http://q.a.b/deep/er", "http://b/deep/er", "http://b/deep", "http://..org/", "http://İ.ORG/é", "http://a b.com/de/ c", "http://x.example.org/es/1",
]


def _frames(spark, rows, rules=RULES, listed=LISTED):
    pages = spark.createDataFrame([(k, u, "h", 1, True) for k, u in rows], "page_id long, url string, host string, `__keys` int, rule boolean").repartition(3)
    return pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(h,) for h in listed], "host string")


def test_verdicts_equal_a_loop(spark):
    rows = [*enumerate(URLS), (None, URLS[0]), (3, URLS[3])]
    got = urlfilter.judge(*_frames(spark, rows))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == _plain(rows, RULES, LISTED)


def test_parts_give_the_same(spark):
    rows = list(enumerate(URLS))
    got = urlfilter.judge(*_frames(spark, rows), part_keys=2).collect()
    assert sorted([tuple(r) for r in got], key=str) == _plain(rows, RULES, LISTED)


def test_empty_tables_and_lists(spark):
    rows = list(enumerate(URLS))
    pages, rules, listed = _frames(spark, rows)
    assert urlfilter.judge(pages.where("false"), rules, listed).count() == 0
    got = urlfilter.judge(pages, rules.where("false"), listed.where("false")).collect()
    assert sorted([tuple(r) for r in got], key=str) == _plain(rows, [], [])


def test_a_cascade_is_exact_over_its_universe(spark):
    """Thousands of keys, so that several levels are needed; keys outside the universe may be taken wrongly."""
    universe = spark.range(60_000).selectExpr("concat('k', id) as k")
    listed = spark.range(0, 60_000, 7).selectExpr("concat('k', id) as k")
    cascade = urlfilter.build(listed.union(listed), universe)
    assert len(cascade.levels) > 4
    rows = urlfilter._with_hashes(universe).toArrow()
    found = cascade.contains(rows.column("h1").to_numpy(), rows.column("h2").to_numpy())
    assert found.tolist() == [int(k[1:]) % 7 == 0 for k in rows.column("k").to_pylist()]
    bits = sum(level.bits for level in cascade.levels)
    assert bits < 12 * 60_000 // 7
    assert not urlfilter.build(listed.where("false"), universe).contains(np.zeros(1, np.int64), np.zeros(1, np.int64)).any()
