import re

from creditspark.llm import urls as U

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


def rule(host, path):
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


ODD = [None, "", "x", "http://NET", "http://a.NET/", "HTTP://ex.ORG/fr/x?y#z", "http://notnet/", "http://a.example.net/en/1", "a://b://c/d",
       "http://example.com?/de/", "http://x.example.com/de/\n/k", "://", "http://İ.net/É?x", "http://" + "a" * 200_000 + "/", "http://u:p@h.org:80/fr/"]


def test_hosts_paths_rules_and_verdicts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(10_000 + i % 14, u, "x") for i, u in enumerate(ODD)], "page_id long, url string, host string")
    df = pages.unionByName(odd, allowMissingColumns=True)
    want = sorted([(r.page_id, *parts(r.url), rule(*parts(r.url))[0]) for r in df.collect()], key=str)
    out = U.judge(df).collect()
    assert sorted([(r.page_id, r.host, r.path, r.rule) for r in out], key=str) == want
    for r in out:
        ruled = rule(r.host, r.path)[1]
        assert r.verdict == (ruled or ("block" if r.score >= 0.5 else "allow"))


def test_trees_tell_unseen_sites_apart(spark):
    rows = [(i, f"https://{h}.example.com/en/{i}") for i, h in enumerate(
        ["cheap-pills", "www.spam-farm", "blog.casino-win", "free-bets", "ads-track", "garden", "www.letters", "blog.tionble", "orchestra", "ththre"])]
    out = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [out[i] for i in range(10)] == ["block"] * 5 + ["allow"] * 5


def test_without_labels_or_pages(spark):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, label int")
    assert [r.verdict for r in U.judge(df, none).collect()] == ["allow"]
    assert [r.verdict for r in U.judge(df, spark.createDataFrame([("u", 1)], "url string, label int")).collect()] == ["block"]
    assert U.judge(df.limit(0)).collect() == []
