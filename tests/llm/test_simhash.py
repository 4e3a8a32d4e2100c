import random

import pytest
from xxhash import xxh64_intdigest

from datebook.llm.components import connected_components
from datebook.llm.simhash import keep_one_of_each, links, simhash_components


def fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """prints: (id, fingerprint); brute force over all pairs."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in prints:
        for j, y in prints:
            if bin(x ^ y).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in prints}


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("alpha beta gamma delta eins zwei drei été É 日本 x y z".split())
    texts = [None, "", " \n", "one", "one two", "ONE two"] + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [" ".join([word() for _ in range(400)]) for _ in range(5)] + ["same words " * 9000]
    for t in texts[40:60]:
        texts.append(t + " z")
    texts += texts[6:20]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in simhash_components(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")).collect()}
    want = components([(i, fingerprint(t)) for i, t in rows])
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == {i: fingerprint(t) for i, t in rows}
    assert {i: r.component_id for i, r in got.items()} == want


@pytest.mark.parametrize("crowded", [1, 4, 1000])
def test_links_are_complete_in_dense_balls(spark, crowded):
    rng = random.Random(3)
    prints = set()
    for centre in (0, 0xFFFFFFFFFFFFFFFF, rng.getrandbits(64)):
        prints |= {centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}) for _ in range(120)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {tuple(sorted((r.a, r.b))) for r in links(spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, node long"), crowded).collect()}
    assert got == {(i, j) for i, x in enumerate(prints) for j, y in enumerate(prints[:]) if i < j and bin(x ^ y).count("1") <= 2}


def test_chain_and_empty_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 9)], "a long, b long")
    assert {r.node: r.component for r in connected_components(chain).collect()} == {i: 100 for i in range(100, 161)} | {7: 7, 9: 7}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "A b c d", "x"), (3, "other words here", "y"), (3, "other words here", "y"), (None, "loose", "z"), (None, "a b c d", "z")], "doc_id long, text string, component_id string")
    assert sorted((r.doc_id or 0, r.component_id) for r in keep_one_of_each(docs).collect()) == [(0, "z"), (0, "z"), (1, "x"), (3, "y")]
    assert keep_one_of_each(docs.limit(0)).count() == 0
