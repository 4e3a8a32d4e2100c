import random

import numpy as np

from datebook.llm.common import alnum_words
from datebook.llm.decontamination import FmIndex, contamination, decontaminated
from datebook.llm.wavelet import Bits, WaveletMatrix


def brute(text, items):
    words, hit, found = alnum_words(text), set(), set()
    for item, phrase in items:
        p = alnum_words(phrase)
        for w in [p[i : i + 10] for i in range(max(1, len(p) - 9))] if p else []:
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(item)
    return len(words), hit, sorted(x for x in found if x is not None)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        text = rng.integers(0, 37, n).astype(np.uint16)
        matrix = WaveletMatrix.of(text, 6)
        assert (matrix.symbols() == text).all() and (matrix.access(np.arange(n)) == text).all()
        for s in (0, 5, 36):
            want = np.append(0, np.cumsum(text == s))
            assert (matrix.rank(np.full(n + 1, s), np.arange(n + 1)) == want).all()
            assert (matrix.select(s, np.arange(want[-1])) == np.flatnonzero(text == s)).all()
        bits = rng.random(n) < 0.3
        b = Bits.of(bits)
        assert (b.select(np.arange(b.ones)) == np.flatnonzero(bits)).all() and (b.select(np.arange(n - b.ones), False) == np.flatnonzero(~bits)).all()


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(0, 4, 500), 0)
    index = FmIndex(text, 2)
    assert sorted(index.locate(np.arange(len(text)))) == list(range(len(text)))
    phrases = np.unique(rng.integers(1, 4, (40, 3)), axis=0)
    row, low, high = index.search(phrases)
    got = {int(r): sorted(index.locate(np.arange(a, b)).tolist()) for r, a, b in zip(row, low, high)}
    want = {i: [k for k in range(len(text) - 2) if (text[k : k + 3] == p).all()] for i, p in enumerate(phrases)}
    assert got == {i: k for i, k in want.items() if k}


def rows():
    rng = random.Random(9)
    word = lambda: rng.choice("a b c d e f é 日本 x1".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(20)] + [(30, None), (30, "q r s"), (None, "u v w"), (4, "t t t t t t t t t t t t")]
    docs = [None, "", "...", "q R. s", "u v w", "t " * 30, "T t"] + [" ".join(rng.choice([word(), word() + ".", "zzz"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    docs += [f"zzz {t}, zzz {t}" for _, t in items if t] + ["q q r s r s", "zzz " * 30_000 + "q r s"]
    return items, docs + docs[:3]


def test_hits_match_brute_force(spark):
    items, texts = rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (10_000_000, 120):
        for r in contamination(docs, bench, most=most).collect():
            n, hit, found = brute(texts[r.doc_id], items)
            assert (r.n_words, {k for s in r.spans for k in range(s.start, s.end)}, list(r["items"])) == (n, hit, found), r.doc_id
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert contamination(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0 and contamination(docs.limit(0), bench).count() == 0


def test_cut_leaves_no_phrase_and_clean_texts_alone(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "q r s"), (3, None)]
    texts = ["Before. One two three four five six seven eight nine TEN eleven, after!", "q q r s r s q", "q r s", "clean text here", None, "", "..."]
    docs = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_chars long")
    out = {r.doc_id: r for r in decontaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {i: r.text for i, r in out.items()} == {0: "Before. , after!", 1: " q", 3: "clean text here", 4: None, 5: "", 6: "..."}
    assert out[0].n_chars == len(out[0].text)


def test_parts_of_the_benchmark_cut_alike(spark):
    items, texts = rows()
    items = items + [(41, "b2 b3"), (42, "a c1 c2 b"), (43, "n1 n2"), (44, "m1 m2")]
    texts = texts + ["keep a c1 b2 b3 c2 b keep", "n1 m1 n1 n2 m2 n2 end", "m1 n1 m1 n1 n2 m2 n2 m2", "c1 b2 b3 c2"]
    docs = spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, marks string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: r for r in decontaminated(docs, bench).collect()}
    for most in (200, 40):
        cut = decontaminated(docs, bench, most=most)
        assert cut.columns == docs.columns and {r.doc_id: r for r in cut.collect()} == whole
    assert all(not brute(r.text, items)[1] for r in whole.values())
    assert whole[len(texts) - 4].text == "keep  keep" and whole[len(texts) - 3].text.strip() == "end"
