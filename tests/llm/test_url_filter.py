import random
import re

from docvet.llm import url_filter
from docvet.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM", "http://Example.com/en/x?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/1", "x://y://z/p",
    "http://net/es/", "http://notnet/es/a", "http://a.net/fr/b", "http://a.net/fr", "http://b.com?x", "http://b.com:80/q/?b=2&utm_source=z&a=1", "http://b.com/q?a=1&b=2",
    "http://user@b.com:8443/", "http://ÄÖ.com/É", "http://c.org/" + "x" * 200_000, "http://c.org/a\nb",
]


def judge(url, names):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "block" if url in names else "allow"


def test_rules_and_list(spark):
    rng = random.Random(2)
    urls = URLS + [f"http://h{rng.randrange(50)}.org/{rng.randrange(300)}" for _ in range(3000)]
    pages = spark.createDataFrame([(k, u, "html", "x", 1) for k, u in enumerate(urls)], "page_id bigint, url string, html string, listed string, block int")
    names = {u for u in urls[20:] if rng.random() < 0.1}
    listed = spark.createDataFrame([(u,) for u in [*names, *names, None, ""]], "url string")
    for bits, limit in ((16, 1 << 20), (1, 1 << 20), (16, 0)):  # few bits give many false positives; no room means a shuffled join
        got = {r.page_id: r for r in url_filter.judge_urls(pages, listed, URL_RULES, bits_per_key=bits, broadcast_bytes=limit).collect()}
        assert len(got) == len(urls)
        for k, u in enumerate(urls):
            assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == judge(u, names), u
        assert all(r.maybe_listed for r in got.values() if r.listed)
        if bits == 1:
            assert any(r.maybe_listed and not r.listed for r in got.values())


def test_canonical_form_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, URLS[14]), (1, URLS[14])], "page_id bigint, url string")
    listed = spark.createDataFrame([(URLS[15],)], "url string")
    assert [r.verdict for r in url_filter.judge_urls(pages, listed).collect()] == ["block", "block"]
    assert url_filter.judge_urls(pages.where("false"), listed).count() == 0
    assert [r.listed for r in url_filter.judge_urls(pages, listed.where("false")).collect()] == [False, False]
