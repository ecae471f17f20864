from helpers import sql_rows, table_rows

from matchweave.llm import url_rules


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert table_rows(url_rules.op5_url_rules(spark, sf)) == sql_rows(url_rules.OP5_SQL, sf)


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else "allow"


def test_nested_rules_and_odd_urls(spark):
    rules = url_rules.RULES + [
        ("allow", "b.example.com", "/"), ("block", "a.b.example.com", "/x"), ("block", "example.com", "/de/y"),
        ("block", "b.example.com", "/x/y/z"), ("allow", "exam", "/"),
    ]
    urls = [
        None, "", "no scheme", "http://", "://net", "http://NET", "http://net/", "http://a.net/?q", "http://xnet/", "http://net./",
        "http://a.b.example.com/x/1", "http://c.a.b.example.com/x/y/zz", "http://b.example.com/q#f", "http://bb.example.com/de/y",
        "https://example.com/de/?a=/b", "https://w.org/fr/x", "https://w.org/FR/", "http://exam/", "http://example.com:80/de/",
        "http://x.example.net/en/a://b", "http://Ä.NET/", "http://a..net/", "http://net?x", "http://a.b.example.com" + "/x" * 50_000,
    ]
    pages = spark.createDataFrame([(k % 20, u, "k", 1) for k, u in enumerate(urls * 3)], "page_id long, url string, key string, cell int")
    got = url_rules.judge(pages, url_rules.rule_table(spark, rules)).collect()
    want = [(k % 20, *brute(u, rules)) for k, u in enumerate(urls * 3)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    rules = url_rules.rule_table(spark)
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_rules.judge(pages.where("false"), rules).count() == 0
    assert [r.verdict for r in url_rules.judge(pages, rules.where("false")).collect()] == ["allow"]
