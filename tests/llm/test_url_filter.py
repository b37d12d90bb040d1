import random

from spindrift.llm.url_filter import judge_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("Shop.Example.com", "", "block"), ("org", "/fr/x", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(m) for m in "/?#" if m in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min([rest.find(m) for m in "?#" if m in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def brute(url, rules, default="allow"):
    host, path = parts(url)
    best = None
    for h, p, v in rules:
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best, (len(h + p), v == "block", h, p, v)) if best else (len(h + p), v == "block", h, p, v)
    return host, path, best and best[2] + best[3], best[4] if best else default


def test_equals_brute_force(spark):
    rnd = random.Random(1)
    urls = [None, "", "no scheme", "://", "http://", "http://net", "http://a.net?x=/", "HTTP://WWW.ExÄmple.NET/en/é", "http://example.net.evil/en/", "x://a.b.org/fr/x#?", "http://u@h:8/p://q/", "http://.net/", "http://net./", "a" * 5000 + "://" + "b." * 3000 + "org/fr/" + "c" * 5000, "http://a.net#/en/?", "http://shop.example.com"]
    for _ in range(400):
        urls.append(rnd.choice(["http", "https"]) + "://" + rnd.choice(["", "www.", "a.b.", "Shop."]) + rnd.choice(["example.net", "example.com", "example.org", "EXAMPLE.Net", "notexample.net", "xorg"]) + rnd.choice(["", "/", "/en/", "/de/", "/fr/", "/fr/x", "/en", "/EN/"]) + rnd.choice(["", "1", "?q=/en/", "#/de/", "é"]))
    rows = [(i, u, "old") for i, u in enumerate(urls)] + [(1, urls[40], "old"), (None, urls[41], "old")]
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("", "", "block"), ("x", "/", None)], "host string, path string, verdict string")
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), rules)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str)
    assert got == sorted(((i, *brute(u, RULES)) for i, u, _ in rows), key=str)


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in judge_urls(pages, rules, default="block").collect()] == [(1, "http://a.net/", "a.net", "/", None, "block")]
    assert judge_urls(pages.limit(0), rules).count() == 0
