"""Verdicts equal a rule-by-rule comparison."""

import random

import pytest

from fixtures_llm import ODD  # noqa: F401
from cohortloom.llm import url_filter
from cohortloom.llm.queries import URL_RULES

RULES = [*URL_RULES, ("org", "/", "block"), ("a.b.org", "", "allow"), ("x.com", "/de/very/long/path", "allow")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:] if rest[cut:cut + 1] == "/" else ""
    end = min([i for i in (path.find(c) for c in "?#") if i >= 0] or [len(path)])
    return host, path[:end]


def verdict(host, path, rules, default="allow"):
    fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fit)[2], max(fit)[3]) if fit else (None, default)


def urls():
    rnd = random.Random(3)
    made = ["".join(rnd.choice(["http://", "HTTPS://", "://", "", "ftp:"]) + rnd.choice(
        ["example.org", "EXAMPLE.Org", "a.example.org", "a.b.org", "x.com", "com", "org", "notorg", "é.com", ""])
        + rnd.choice(["", "/", "/es/", "/es", "/en/1", "/en/12", "/de/very/long/path/x", "/fr/a", "?/fr/", "#x"])
        + rnd.choice(["", "?q=1", "#top", "?a://b/"])) for _ in range(400)]
    return [*made, None, "", "://", "http://", "a" * 50_000, "http://" + "a." * 30_000 + "org/" + "x" * 50_000]


def test_like_rule_by_rule(spark):
    rows = list(enumerate(urls())) + [(None, "http://example.org/es/"), (0, urls()[0])]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = [tuple(r) for r in url_filter.judge(pages, rules).collect()]
    want = [(i, *parts(u), *verdict(*parts(u), RULES)) for i, u in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_pages_or_rules(spark):
    schema = "host string, path string, verdict string"
    rules, none = spark.createDataFrame(RULES, schema), spark.createDataFrame(
        [(None, "/", "block"), ("", "/", "block"), ("org", None, "block")], schema)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, rules).count() == 0
    page = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert tuple(url_filter.judge(page, none, default="block").first()) == (1, "a.org", "/", None, "block")


def test_rule_too_long(spark):
    rules = spark.createDataFrame([("org", "/" * 3000, "block")], "host string, path string, verdict string")
    with pytest.raises(ValueError):
        url_filter.judge(spark.createDataFrame([(1, "x")], "page_id long, url string"), rules)
