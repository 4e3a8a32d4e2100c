from datebook.llm.url_filter import RULES, url_filter


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    rest = rest[len(host) :]
    ends = [rest.find(c) for c in "?#" if c in rest]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[: min(ends)] if ends else rest


def ruled(host, path):
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/7x?y", "https://a.example.net/de/81", "x://É.org?x=/es/", "http://a.org/es/1#f", "http://com/en/", "http://b.com/fr//1///2/", "a://b://c/d", "http://h.net/a\nb?c"]


def test_rules_and_parts(spark):
    urls = URLS + [f"http://site{i % 3}.example.org/{'fr' if i % 2 else 'es'}/{i}.html" for i in range(60)] + [f"http://spam-farm.example.net/x/{i}" for i in range(10)] + [f"http://big.io/tag/name{chr(97 + i % 26)}{chr(97 + i // 26)}/view" for i in range(200)]
    pages = spark.createDataFrame([(i, u, "h", "c") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host string, verdict string")
    rows = {r.page_id: r for r in url_filter(pages).collect()}
    assert set(rows) == set(range(len(urls) + 3))
    for i, u in enumerate(urls):
        host, path = parsed(u)
        rule, verdict = ruled(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == verdict or verdict is None
    own = {r.host: set() for r in rows.values()}
    for r in rows.values():
        if r.rule is None:
            own[r.host].add(r.verdict)
    assert own["spam-farm.example.net"] == {"block"} and own["site0.example.org"] == {"allow"} and own[""] == {"allow"}
    assert {r.template for r in rows.values() if r.host == "big.io"} == {"/tag/*/view"}
    for r in rows.values():
        assert r.rule is not None or r.verdict == ("block" if r.purity >= 0.5 else "allow")
    assert url_filter(pages.limit(0)).count() == 0
