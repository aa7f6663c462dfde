"""URL rules against a plain version."""

import re

from reelgrid.llm import urls as u


def plain(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if not m else m.groups()
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fits = [(-len(h + p), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(min(fits)[1:] if fits else (None, "allow")))


URLS = [None, "", "no scheme", "http://", "HTTP://Example.ORG/en/12?x#y", "http://example.org",
        "https://a.b.example.org/es/", "https://xexample.org/es/", "http://org/", "http://ORG/a",
        "http://shop.com/fr/x", "http://shop.com/de/x://y.org/", "ftp://com/de", "://com/de/#",
        "http://a.com?x=/de/", "http://user@a.com:80/de/", "http://ÄB.org/ß", "http://.org/",
        "http://" + "a." * 2000 + "com/de/" + "x" * 5000, "http://a.com/fr\n/", "http://a.com./fr/"]


def test_rules(spark):
    rows = [(k, x, "taken") for k, x in enumerate(URLS)] + [(None, URLS[4], "t"), (4, URLS[4], "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame(u.RULES, "host string, path string, verdict string")
    want = sorted(((k, *plain(x, u.RULES)) for k, x, _ in rows), key=repr)
    for blocks in (u.MAX_BLOCKS, 1):
        got = u.judge_urls(pages, rules, max_blocks=blocks).collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([(None, "/", "block")], "host string, path string, verdict string")
    assert [tuple(r) for r in u.judge_urls(pages, none).collect()] == [
        (1, "a.org", "/", None, "allow")]
    rules = spark.createDataFrame(u.RULES, "host string, path string, verdict string")
    assert u.judge_urls(pages.where("page_id > 1"), rules).count() == 0


def test_many_listed_urls(spark):
    listed = [(f"h{k % 97}.net", f"/p{k}", "block") for k in range(5000)]
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, f"http://w.h{k % 97}.net/p{k}") for k in range(0, 9000, 7)],
                                  "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in u.judge_urls(pages, rules).collect()}
    want = {}
    for k in range(0, 9000, 7):
        fits = [h + p for h, p, _ in listed[k % 97::97]
                if f"/p{k}".startswith(p)]
        want[k] = min(fits, key=lambda x: (-len(x), x)) if fits else None
    assert got == want
