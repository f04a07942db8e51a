import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import url_filter
from skyloom.llm.url_filter import digest_array, digests, url_verdicts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return rest[:cut].translate(LOWER), path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


def brute(urls, rules, default="allow"):
    out = []
    for key, url in urls:
        host, path = split(url)
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((key, host, path, best and best[2], best[3] if best else default))
    return sorted(out, key=repr)


def frames(spark, urls, rules):
    pages = spark.createDataFrame([(k, u, "h", "p", 1) for k, u in urls], "page_id long, url string, host string, path string, verdict int")
    return pages, spark.createDataFrame(rules, "host string, path string, verdict string")


ODD = [None, "", "no scheme/net/", "http://", "http://net", "http://NET/", "http://a.net/en/", "http://example.net/en/x?y#z", "https://EXAMPLE.NET/EN/", "http://xexample.net/en/",
       "http://sub.example.net/enx", "ftp://a.b.org/fr/", "http://org?/fr/", "http://org#://", "x://y://net/", "http://a..net/", "http://.net/", "http://net./", "http://u@example.com:80/de/",
       "http://é.example.com/de/ü", "http://a.example.com/de/\nmore", "http://" + "a." * 50_000 + "net/x", "http://net/" + "b" * 100_000, "://net/", "http://ÉX.net/"]


def test_odd_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.org", "", "block"), ("a.example.com", "/d", "allow"), ("com", "/de/ü", "block")]
    urls = [(i, u) for i, u in enumerate(ODD)] + [(None, "http://a.net/"), (5, "http://a.net/"), (5, "http://a.net/")]
    pages, ruled = frames(spark, urls, rules)
    for default in ("allow", "block"):
        got = url_verdicts(pages, ruled, default)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(urls, rules, default)
    assert url_verdicts(pages.limit(0), ruled).collect() == []
    assert sorted(map(tuple, url_verdicts(pages, ruled.limit(0)).collect()), key=repr) == brute(urls, [])


def test_many_rules_in_shards(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 150)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(1, 3)))
    rules = {(".".join(word() for _ in range(rng.integers(1, 4))), "/" + "/".join(word() for _ in range(rng.integers(0, 3)))): str(rng.choice(["allow", "block"])) for _ in range(1500)}
    urls = [(i, "http://" + ".".join(word() for _ in range(rng.integers(1, 6))) + "/" + "/".join(word() for _ in range(rng.integers(0, 5)))) for i in range(3000)]
    rules = [(*k, v) for k, v in rules.items()]
    pages, ruled = frames(spark, urls, rules)
    assert len(digest_array(ruled)) > 3
    assert sorted(map(tuple, url_verdicts(pages, ruled).collect()), key=repr) == brute(urls, rules)


def test_rules_are_checked_and_merged(spark):
    pages, ruled = frames(spark, [(1, "http://a.b/c")], [("A.b", "/c", "allow"), ("a.B", "/c", "block")])
    assert url_verdicts(pages, ruled).first()["verdict"] == "block"
    for bad in ((None, "/", "block"), ("", "/", "block"), ("a", None, "block"), ("a", "b", "block"), ("a", "/", "drop"), ("a/b", "/", "block"), ("a", "/?", "allow")):
        with pytest.raises(Exception, match="not a rule"):
            digest_array(spark.createDataFrame([bad], "host string, path string, verdict string"))


def test_digests_are_those_of_spark_and_collisions_are_told_apart(spark, monkeypatch):
    keys = ["", "net/", "é" * 50, "x" * 1000]
    want = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(F.xxhash64("k")).collect()]
    assert digests(keys).tolist() == want
    pages, ruled = frames(spark, [], [(f"h{i}.net", "/", "block") for i in range(50)])
    shards = url_filter.Shards(digest_array(ruled))
    # as if all keys asked for had the digest of one that is there
    one = digests(["h7.net/"])[0]
    monkeypatch.setattr(url_filter, "digests", lambda keys: np.full(len(keys), one))
    assert set(shards.find(["h7.net/", "h8.net/", "other"])) == {"h7.net/"}
