from __future__ import annotations

import re

from feedlode.llm import url_templates as u
from tests.llm.cases import MIDDLE, SMALL, small_rows


def plain(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, after = rest[:end], rest[end:]
    path = after[:min([i for i in (after.find(c) for c in "?#") if i >= 0], default=len(after))]
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def plain_rule(host: str, path: str) -> u.Rule | None:
    fits = [r for r in u.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    None, "", "no scheme/here", "http://", "https://Example.ORG", "http://example.org/es/1", "http://a.example.org/en/12?x#y",
    "http://xexample.org/es/", "http://org/a", "http://x.com/de/", "http://x.com/de", "ftp://É.com/fr/x", "http://x.com?p=/fr/",
    "http://u:p@H.net:80//a//b", "http://x.com#a://b/de/", "a://b://c/d", "http://x.net/en/1\nb", "http://x.net/en/1\nb",
]


def check(rows, urls) -> None:
    for row in rows:
        host, path = plain(urls(row))
        rule = plain_rule(host, path)
        assert (row["host"], row["path"]) == (host, path)
        assert row["rule"] == (rule.name if rule else None)
        assert row["verdict"] in ("allow", "block")
        if rule:
            assert row["verdict"] == rule.verdict


def test_query_against_plain_rules(spark):
    for sf_dir in (SMALL, MIDDLE):
        urls = {r[0]: r[1] for r in small_rows("pages", sf_dir)}
        rows = u.op9_url_filter(spark, sf_dir).collect()
        assert len(rows) == len(urls)
        check(rows, lambda row: urls[row["page_id"]])


def test_odd_rows(spark):
    rows = [(i, url, "x", 1, 2) for i, url in enumerate(URLS)] + [(None, URLS[5], "x", 1, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, found_host string, Template int, shape int")
    got = u.judge(pages).collect()
    assert len(got) == len(rows) and got[0]["found_host"] == "x" and got[0]["shape"] == 1 + 1
    check(got, lambda row: row["url"])
    assert u.judge(pages.where("false")).collect() == []
    assert {r["verdict"] for r in u.judge(pages, []).collect()} == {"allow"}


def test_templates(spark):
    rows = [("h", f"/en/{i}", 0, 0) for i in range(20)] + [("h", f"/spam/{i}.html", 0, 3) for i in range(20)]
    rows += [("h", f"/news/{i}.html", 3, 0) for i in range(20)] + [("h", "/a/b/c/d/e/f/g/h", 0, 0), ("other", "/spam/1.html", 0, 0)]
    found = u.templates(spark.createDataFrame(rows, "host string, path string, allowed long, blocked long"))
    of = {(r["host"], r["path"]): r["template"] for r in found.collect()}
    assert len(of) == len(rows)
    # Numbers are a wildcard; branches whose labels differ stay apart, the unlabelled one does not.
    assert of["h", "/spam/3.html"] == of["h", "/spam/4.html"] == "/spam/{9.a}"
    assert of["h", "/news/3.html"] == "/news/{9.a}"
    assert of["h", "/en/3"] == "/~/{9}"
    assert of["h", "/a/b/c/d/e/f/g/h"].endswith("/**")
    share = {(r["host"], r["template"]): r["share"] for r in u.purity(found).collect()}
    assert share["h", "/spam/{9.a}"] > u.REJECT > 0.5 > share["h", "/news/{9.a}"]


def test_templates_differ_below_the_sixth_segment(spark):
    rows = [("h.org", f"/en/2024/05/01/sport/news/{kind}/a/{i}", int(kind == "good"), int(kind == "spam"))
            for kind in ("good", "spam") for i in range(20)]
    found = u.templates(spark.createDataFrame(rows, "host string, path string, allowed long, blocked long"))
    by_kind = {kind: {r["template"] for r in found.collect() if f"/{kind}/" in r["path"]} for kind in ("good", "spam")}
    assert len(by_kind["good"]) == len(by_kind["spam"]) == 1 and by_kind["good"] != by_kind["spam"]
