import random
import re

from weir.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "allow"), ("b.net", "/e", "block"), ("org", "", "block")]
SCHEMA = "page_id long, url string, host string, verdict int"


def judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url) if url else None
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for h, p, action in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, "", ""), (len(h + p), len(h), h + p, action))
    return host, path, best[2] if best else None, best[3] if best else "allow"


def rows():
    rng = random.Random(1)
    made = [None, "", "no url", "http://", "http://EXAMPLE.com/en/x?y", "x://a.b.net/es/#z", "http://ÄB.com/", "a\nb://www.example.com/en/\nq", "http://x.org", "http://com", "http://.com/", "http://com./", "s://u:p@b.net:80/es/", "http://evilexample.com/en/"]
    for _ in range(300):
        host = ".".join(rng.choice(["com", "net", "org", "example", "www", "b", ""]) for _ in range(rng.randint(1, 4)))
        made.append(f"{rng.choice(['http', '', 'a://b'])}://{host}{rng.choice(['', '/', '/en/', '/es/x', '/e', '?q', '#f'])}{rng.choice(['', 'x' * 5000])}")
    return [(k, u, "clash", k) for k, u in enumerate(made)] + [(0, None, "clash", 0), (4, made[4], "clash", 1), (None, made[4], "clash", 1)]


def check(spark):
    data = rows()
    got = url_filter.url_filter(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(RULES, "host string, path string, action string")).collect()
    want = sorted((str(i), str(u), *map(str, judge(u))) for i, u, _, _ in data)
    assert sorted((str(r.page_id), str(r.url), r.host, r.path, str(r.rule), r.verdict) for r in got) == want


def test_against_brute_force(spark):
    check(spark)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    check(spark)


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    assert url_filter.url_filter(spark.createDataFrame([], SCHEMA), rules).count() == 0
    out = url_filter.url_filter(spark.createDataFrame([(1, "http://a.com/", "", 1)], SCHEMA), rules.limit(0)).collect()
    assert [(r.rule, r.verdict) for r in out] == [(None, "allow")]
