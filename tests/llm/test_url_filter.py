import re

from riskloom.llm import url_filter as U


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = [
    "http://a.example.org/en/1x", "https://EXAMPLE.org/es/", "http://example.org/en/2", "http://x.example.com/fr/q?x#y", "http://com/de/", "http://notcom/de/", "http://a.com/DE/", "ftp://a.org", "http://a.org?x=/es/",
    "http://a.org#/es/", "http://a.org/", None, "", "nothing", "://", "http://", "http://É.ORG/é", "a://b://c/d", "http://a.net/fr/\n/x", "http://org/x?y#z", "http://free-bets.example.net/en/", "http://news.example.net/en/" + "a" * 5000,
]


def test_rules_equal_the_definition(spark):
    pages = spark.createDataFrame([(i, u, "<html>", "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in U.filter_urls(pages).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == (verdict or ("block" if r.score >= U.THRESHOLD else "allow"))


def test_held_out_urls_and_plan(spark):
    poor = ["http://m.casino-win.example.com/en/4033.html", "https://free-bets.example.net/en/5462#top", "https://www.cheap-pills.example.com/es/6652.html", "http://casino.example.net/fr/1"]
    good = ["http://tiontion.example.net/en/7817?utm_source=feed", "https://m.ththha.example.net/en/1570", "http://www.ththst.example.com/en/1837/", "https://mountain.example.com/es/5"]
    pages = spark.createDataFrame(list(enumerate(poor + good)), "page_id bigint, url string")
    df = U.filter_urls(pages)
    assert {r.page_id: r.verdict for r in df.collect()} == {i: "block" if i < len(poor) else "allow" for i in range(len(poor) + len(good))}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("Scan ExistingRDD", "")) and "Exchange" not in plan


def test_empty_table_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id bigint, url string")
    assert U.filter_urls(pages).count() == 3 and U.filter_urls(pages.limit(0)).count() == 0
