from urllib.parse import urljoin

import pytest

from tapeloom.llm import url_rules as U

SCHEMA = "page_id long, url string, html string, node string, fits string, component string, rule int"
PAGES = [
    (1, "https://A.Example.com/en/1", '<link href="http://b.net/x" rel=canonical>'),
    (2, "https://c.example.com/en/2#top", "<META HTTP-EQUIV='refresh' content='0; URL=https://a.example.com/en/1'>"),
    (3, "http://c.example.com/en/2/?utm_source=feed", None),
    (4, "http://d.example.com/en/4", '<link rel="canonical" href="/fr/q&amp;z">'),
    (5, "http://e.org/fr/5", '<link rel="canonical" href="http://d.example.com/en/4">'),
    (6, "http://d.example.com/fr/q&z", ""),
    (7, "http://net", ""), (8, "http://x.net/", ""), (9, "http://example.net/en/9", ""), (10, "http://xexample.net/en/9?q", ""),
    (11, "http://www.example.com/de/1", ""), (12, "http://www.example.com/de", ""), (13, None, None), (14, "no scheme/x", "<link rel=canonical href=http://q.net/>"),
    (15, "", ""), (16, "://h.org/fr/", ""), (17, "http://lone.io?x=http://y.net/", ""), (18, "http://b.org/fr/1://z", ""), (18, "http://b.org/fr/1://z", ""),
]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:k], rest[k:]
    e = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:e]


def rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


@pytest.fixture
def found(spark):
    return {r.page_id: r for r in U.decide_urls(spark.createDataFrame([(*p, "n", "f", "c", 1) for p in PAGES], SCHEMA)).collect()}


def test_hosts_paths_and_rules(found):
    for page_id, url, _ in PAGES:
        r, want = found[page_id], rule(*split(url))
        assert (r.host, r.path, r.rule) == (*split(url), want and want[1])
        if want:
            assert r.verdict == want[0]


def test_aliases_carry_decisions(found):
    # 1 leads to a blocked host, 2 to 1, and 3 names the same page as 2.
    assert [found[k].verdict for k in (1, 2, 3)] == ["block"] * 3
    assert len({found[k].component for k in (1, 2, 3)}) == 1
    # 5 is allowed, and with it 4 and what 4 leads to.
    assert [found[k].verdict for k in (4, 5, 6)] == ["allow"] * 3
    assert found[12].verdict == "allow" and found[11].verdict == "block"


def test_allow_comes_before_block(spark):
    pages = [(1, "http://x.io/1", '<link rel=canonical href="http://b.net/">'), (2, "http://b.net/", ""), (3, "http://e.org/fr/3", '<link rel=canonical href="http://x.io/1">')]
    got = {r.page_id: r.verdict for r in U.decide_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow"}


def test_rows_and_empty(spark, found):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert U.decide_urls(df).count() == len(PAGES)
    assert U.decide_urls(df.limit(0)).count() == 0
    assert [found[k].verdict for k in (13, 14, 15)] == ["allow"] * 3 and found[13].component is None


def test_targets_resolve(spark):
    base = "http://h.io/a/b"
    for t in ("/x", "//o.io/y", "z", "http://q.io/"):
        got = spark.createDataFrame([(t, base)], "t string, u string").select(U._resolved(U.F.col("t"), U.F.col("u")).alias("r")).first().r
        assert got == urljoin(base, t)
