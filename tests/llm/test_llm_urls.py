import random

import pytest

from foliospark.llm import url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.c", "", "block"), ("b.c", "/x/long/path", "allow")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:end]


def brute(url, rules):
    host, path = split(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


@pytest.mark.parametrize("rows_per_range", [1_000_000, 40])
def test_against_brute_force(spark, rows_per_range):
    rng = random.Random(1)
    hosts = ["a.net", "NET", "x.example.net", "example.net", "example.com", "w.example.com", "org", "q.org", "a.b.c", "z.a.b.c", "b.c", "net-x.com", "", "com.", "..net"]
    paths = ["", "/", "/en/", "/en/5", "/de/1?x=/fr/", "/fr/2#a", "?q=1", "#", "/x/long/path/y", "/é"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(600)] + [None, "", "nothing", "http:/x", "://", "http://a.net/"] + ["https://hot.example.net/en/1"] * 300
    table = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("net", "/", None)], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(table, rules, ["page_id"], rows_per_range=rows_per_range).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls)}


def test_empty_tables_and_equal_rules(spark):
    rules = spark.createDataFrame([("x", "/", "allow"), ("x", "/", "block"), ("X", None, "allow")], "host string, path string, verdict string")
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.judge(none, rules, ["page_id"]).count() == 0
    one = spark.createDataFrame([(1, "http://x/a"), (1, "http://x/a"), (2, "http://x")], "page_id bigint, url string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(one, rules, ["page_id"]).collect())
    assert got == [(1, "x/", "block"), (1, "x/", "block"), (2, "x", "allow")]
    assert {r["verdict"] for r in url_filter.judge(one, rules.limit(0), ["page_id"], default="block").collect()} == {"block"}
