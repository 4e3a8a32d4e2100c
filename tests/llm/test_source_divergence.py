import re
from collections import Counter

import numpy as np

from datebook.llm.source_divergence import FITS, shares, source_divergence

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    found = []
    for lang in {r[1] for r in rows}:
        texts = [(s, Counter(LETTERS.findall(t.translate(LOWER)))) for t, x, s in rows if x == lang]
        df = Counter(w for _, c in texts for w in c)
        kept = {w for w, n in df.items() if n >= least}
        counts = {s: Counter() for s, _ in texts}
        for s, c in texts:
            counts[s].update({w: n for w, n in c.items() if w in kept})
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, own in counts.items():
            pairs = [(o, sum(f(p(own, w), p(other, w)) for w in kept)) for o, other in counts.items() if o != s]
            terms = [(w, f(p(own, w), p(whole, w))) for w in kept if own[w] and p(own, w) > p(whole, w)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                found += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ordered, 1)]
    return sorted(found)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def sample():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "éÉ", "ﬁ", "𝒳y", "Straße"]
    rows = []
    for i in range(240):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        words = rng.zipf(1.4, 30) % len(vocabulary) + (i % 5)
        rows.append((" ".join(vocabulary[w % len(vocabulary)].upper() if w % 4 == 0 else vocabulary[w % len(vocabulary)] for w in words), ["en", "fr", None][i % 3 % 2 + (i % 11 == 0)], source if i % 13 else None))
    return rows + [(None, "en", "none"), ("", "en", "empty"), ("12 34\x00--", "xx", "a"), ("one", "xx", "b"), (None, None, None)] + rows[:9]


def test_against_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(*r, i, 7) for i, r in enumerate(rows)], "text string, lang string, source string, n long, `rank` int").repartition(3)
    for least, top, tile in ((3, 4, 128), (10, 10, 2)):
        assert rows_of(source_divergence(docs, least, top, tile)) == brute(rows, least, top)


def test_no_term_is_kept_and_no_rows(spark):
    docs = spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y"), ("d", "de", "z")], "text string, lang string, source string")
    assert rows_of(source_divergence(docs)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert source_divergence(docs.limit(0)).count() == 0


def test_counts_beyond_64_bits():
    counts = np.array([[FITS + 5, 1], [0, 2**40]], np.int64)
    sizes = [FITS + 5, 2**41]
    assert shares(counts, sizes, 3).tolist() == [[1 + 10**9 * (int(c) + 2) // (n + 6) for c, n in zip(row, sizes)] for row in counts.tolist()]
