import random

from maskwright.llm import url_rules


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    hosts = ["net", "a.net", "b.a.net", "xa.net", "org", "a.org", "", "net.", "ünï.net", "a..net", "NET", "a.NET:80", "u@net"]
    paths = ["", "/", "/en/", "/en", "/english/x", "/de/a/b", "/EN/"]
    rules = [(rng.choice(hosts[:6]), p, rng.choice(["block", "allow"])) for p in ["/", "/en/", "/en", "", "/de/a/", "/de/a/b", "/"]]
    rules += [("a.net", "/x", "allow"), ("net", "/axx", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "allow")]
    urls = [f"{rng.choice(['http', 'https', 'HTTP'])}://{h}{p}{rng.choice(['', '?q=/en/', '#/de/', '?a://b'])}" for h in hosts for p in paths]
    urls += [None, "", "net/", "://net/", "x://", "a\nb://net/\n/x", "http://" + "s." * 60 + "net/" + "en/" * 3000, urls[0], urls[0], "//net/en/", "http://net?x://org/"]
    pages = spark.createDataFrame([(None if i == 5 else i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    got = url_rules.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert sorted((r.host, r.path, str(r.rule), r.verdict) for r in got.collect()) == sorted((*b[:2], str(b[2]), b[3]) for b in (brute(u, rules) for u in urls))


def test_empty_tables_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "BROADCAST_ROWS", -1)
    pages = spark.createDataFrame([(1, "http://a.net/en/")], "page_id bigint, url string")
    rules = spark.createDataFrame([("net", "/", "block"), (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    assert url_rules.judged(pages, rules).first().verdict == "block"
    assert url_rules.judged(pages, rules.limit(0)).first().verdict == "allow"
    assert url_rules.judged(pages.limit(0), rules).count() == 0
