from datebook.llm.url_filter import url_filter


def name(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(3))


def test_few_hits_do_not_block_a_host(spark):
    urls = [f"http://news.io/news/{name(i)}" for i in range(500)] + ["http://news.io/news/cheap-a", "http://news.io/news/spam-b"]
    urls += [f"http://shop.com/{name(i)}/x" for i in range(40)] + ["http://shop.com/en/x"]
    deep = ["http://deep.io/a/b/c/d/e/f/g/casino"] * 9 + ["http://deep.io/a/b/c/d/e/f/g/plain"] * 9
    urls += deep
    rows = [tuple(r) for r in url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).select("page_id", "host", "path", "verdict", "template").collect()]
    assert len(rows) == len(urls)
    clean = {v for _, h, p, v, _ in rows if h in ("news.io", "shop.com") and "cheap" not in p and "spam" not in p and not p.startswith("/en/")}
    assert clean == {"allow"}
    assert {v for _, h, p, v, _ in rows if p == "/en/x"} == {"block"}
    assert {(t, v) for _, h, p, v, t in rows if h == "deep.io"} == {("/a/b/c/d/e/f/g/casino", "block"), ("/a/b/c/d/e/f/g/plain", "allow")}
