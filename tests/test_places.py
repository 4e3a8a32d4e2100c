"""Events get the elements that taking them one after the other would give."""

import random

from pyspark.sql import functions as F

from datebook.operators.places import page_texts, placed_events, text_nodes

EVENTS = "page_id long, pos int, title string, preview string, startDate string, startTime string"


def plain(x):
    return " ".join(x.lower().replace("–", "-").replace("—", "-").split())


def one_after_the_other(events, pages):
    out = {}
    for page, html in pages:
        nodes, used = text_nodes(html), set()
        for p, pos, title, preview, date, time in sorted((e for e in events if e[0] == page), key=lambda e: e[1]):
            holds = lambda x: {n[0] for n in nodes if x and len(x) >= 3 and plain(n[5]) and plain(x)[:15] in plain(n[5])}
            best = None
            for node, element, tag, first, last, text in nodes:
                if node in holds(title or preview) and element not in used:
                    score = 1 + sum(2 for x in (date, time) if any(first <= n <= last for n in holds(x)))
                    if best is None or score > best[-1]:
                        best = (element, tag, node, text, score)
            if best:
                used.add(best[0])
                out[page, pos] = best
    return out


def test_texts_know_their_title_and_box():
    html = "<p>loose <b>bold</b></p><ul><li>one <i>day</i></li></ul><script>x</script><article><h2>Head <u>line</u></h2><div>when</div></article>"
    rows = [(t, text.strip(), first, last) for _, _, t, first, last, text in text_nodes(html)]
    assert rows == [("p", "loose", 0, 5 + 1), ("b", "bold", 0, 1), ("li", "one", 2, 3), ("li", "day", 2, 3), ("h2", "Head", 4, 6), ("h2", "line", 4, 6), ("div", "when", 6, 6)]
    assert text_nodes(None) == text_nodes("") == []


def test_same_as_one_after_the_other(spark):
    rng = random.Random(5)
    titles = ["Jazz Night at the Pier", "jazz  night at the pier", "Jazz Night at the Quay", "Open Day", "Tea", "go", "   ", "", "café — late show now"]
    dates, times = ["2026-03-05", "2026-03-06", None, "x"], ["7:30 PM", "19:00", None]
    pages, events = [], []
    for page in range(12):
        card = lambda: "<{0}>{1}<{2}>{3}</{2}> <p>{4}</p><p>{5}</p></{0}>".format(rng.choice(["article", "p", "li", "div", "u"]), rng.choice(["", "Tea "]), rng.choice(["h2", "a", "i"]), rng.choice(titles), rng.choice(dates) or "", rng.choice(times) or "")
        pages.append((page, "<body>" + "".join(card() for _ in range(rng.randrange(0, 14))) + "</body>"))
        events += [(page, k, rng.choice(titles + [None]), rng.choice(["Open Day", None]), rng.choice(dates), rng.choice(times)) for k in range(rng.randrange(0, 16))]
    got = placed_events(spark.createDataFrame(events, EVENTS), page_texts(spark.createDataFrame(pages, "page_id long, html string"))).collect()
    expected = one_after_the_other(events, pages)
    assert {(r.page_id, r.pos): (r.element, r.tag, r.node, r.text, r.score) for r in got} == expected
    assert len(got) == len(expected) > 30


def test_repeats_nulls_and_nothing(spark):
    pages = spark.createDataFrame([(1, "<h1>Open Day</h1><h1>Open Day</h1>"), (2, None), (None, "<b>Open Day</b>")], "page_id long, html string")
    row = lambda page, pos, title: (page, pos, title, None, None, None)
    events = [row(1, 0, "Open Day"), row(1, 0, "Open Day"), row(1, 1, "Open Day!"), row(1, None, "Open Day"), row(None, 0, "Open Day"), row(2, 0, "Open Day"), row(1, 2, "open day")]
    got = placed_events(spark.createDataFrame(events, EVENTS), page_texts(pages)).collect()
    assert {(r.page_id, r.pos, r.node) for r in got} == {(1, 0, 0), (1, 2, 1)}
    assert placed_events(spark.createDataFrame([], EVENTS), page_texts(pages)).count() == 0


def test_few_and_many_terms_find_the_same_texts(spark, monkeypatch):
    """Pages of few terms are searched term by term, those of many by runs of characters; markup is not cut into runs for few."""
    from datebook.operators import places

    terms = spark.createDataFrame([(p, t) for p in (1, 2) for t in ("", "ja", "jazz night in th", "zz n", "2031-03-05", "none")], "page_id int, term string").withColumn("term", F.substring("term", 1, 15))
    texts = spark.createDataFrame([(1, 0, "Jazz  Night in the hall"), (1, 1, " "), (1, 2, "on 2031-03-05"), (2, 0, "ja"), (3, 0, "jazz")], "page_id int, node int, text string")
    found = lambda: sorted(map(tuple, places.texts_with(terms, texts).collect()))
    few = found()
    monkeypatch.setattr(places, "FEW", 0)
    assert few == found() and (1, "2031-03-05", 2) in few and (2, "ja", 0) in few
