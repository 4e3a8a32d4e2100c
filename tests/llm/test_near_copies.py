import random

import corpus_pipeline
from datebook.llm.near_copies import similar_components
from datebook.llm.simhash import text_fingerprints


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows, least=0.8, bits=-1):
    """Brute force over all pairs."""
    prints = dict(zip([i for i, _ in rows], text_fingerprints([t for _, t in rows], 5).tolist()))
    root, sets = {i: i for i, _ in rows}, {i: shingles(t) for i, t in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and (x == y or len(x & y) >= least * len(x | y) or (prints[i] ^ prints[j]).bit_count() <= bits):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    out = [None, "", " ", "one two", "ONE  two", "one"]
    for group in range(12):
        base = [word() for _ in range(120)]
        for _ in range(60 if group == 0 else 4):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return list(enumerate(out))


def test_components_match_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    want = components(rows)
    for few in (2, 16, 1000):
        assert {r.doc_id: r.component_id for r in similar_components(docs, few=few).collect()} == want


def test_pipeline_stage_drops_edited_copies(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i, g in components(rows, bits=2).items() if i == g}
