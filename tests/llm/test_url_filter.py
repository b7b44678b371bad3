"""Allow and block lists against a plain search through all rules."""

from __future__ import annotations

import random

import pytest

from tracelode.llm import url_filter
from tracelode.llm.queries import URL_RULES, op13_url_filter


def plainly(url, rules, default="allow"):
    url = url or ""
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[3:] if fit else (None, default))


def _rules(spark, rules):
    return spark.createDataFrame(rules, url_filter.RULES_SCHEMA)


def _check(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame([(i if i % 7 else None, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string").repartition(3)
    found = url_filter.judge_pages(pages, _rules(spark, rules), default).collect()
    wanted = [(i if i % 7 else None, *plainly(u, rules, default)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


URLS = [None, "", "no scheme", "http://", "http://COM/", "https://A.Example.com/en/x?q#f", "https://www.example.com/en/", "https://www.example.com/en", "https://www.example.com?x=/en/", "x://y.net/es/1://z", "ftp://net/fr/#a", "http://notexample.com/en/", "http://example.com.:80/en/", "http://é.Net/es/ä", "http://u@b.com:80/en/", "://com/a", "http://a..com//en/", "http://com/" + "a/" * 5000, "http://" + "a." * 500 + "net/es/"]


def test_awkward_urls(spark):
    rules = [tuple(r) for r in url_filter.parse_rules(spark, URL_RULES).collect()]
    assert rules == [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    _check(spark, URLS + URLS[4:9], rules)
    _check(spark, URLS, rules, "block")
    _check(spark, URLS, [("", "", "block"), ("com", "", "allow"), ("com", "", "block"), ("net", "/e", "allow"), ("net", "/es/1", "block")])
    _check(spark, URLS, [])
    assert url_filter.judge_pages(spark.createDataFrame([], "page_id long, url string"), _rules(spark, rules)).count() == 0


def test_unknown_verdicts_are_refused(spark):
    with pytest.raises(ValueError, match="allow or block"):
        url_filter.judge_pages(spark.createDataFrame([], "page_id long, url string"), _rules(spark, [("com", "/", "maybe")]))


@pytest.mark.parametrize("most", [url_filter.MOST_RULES, 40])
def test_random_rules_in_one_trie_and_in_several(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_RULES", most)
    draw = random.Random(7)
    host = lambda: ".".join(draw.choices(["a", "b", "com", "net"], k=draw.randint(1, 4)))
    path = lambda: "".join("/" + draw.choice(["en", "e", "", "fr"]) for _ in range(draw.randint(0, 4)))
    rules = [(host(), path(), draw.choice(["allow", "block"])) for _ in range(120)]
    _check(spark, [f"http://{host()}{path()}{draw.choice(['', '?q', '/#f'])}" for _ in range(500)], rules)


def test_a_whole_table(spark, tiny):
    rules = [tuple(r) for r in url_filter.parse_rules(spark, URL_RULES).collect()]
    table = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "url").collect()
    found = op13_url_filter(spark, tiny).collect()
    assert sorted(map(tuple, found)) == sorted((r["page_id"], *plainly(r["url"], rules)) for r in table)
