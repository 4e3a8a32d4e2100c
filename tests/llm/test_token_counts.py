import random

import public_tokenizers as P
from tokenizers import Tokenizer, models, pre_tokenizers

from datebook.llm.token_counts import CountingViterbi, load_vocabulary, token_counts

TEXTS = [None, "", " ", "  two  spaces ", "Hello world", "ünïcode 日本語 😀😀 \u0378 x", "tab\tand\nline", "▁already▁there", "a" * 5000, "word " * 20_000, "<unk> <s> <0x41>"]


def reference(vocabulary):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    return t


def test_counts_match_the_library(spark):
    path = P.path("piece_bpe_32k.model")
    library = reference(load_vocabulary(path))
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("theandofing  é日zq.\n") for _ in range(rng.randint(1, 200))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts + texts[:2])], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, path).collect()}
    assert got == {i: len(library.encode(t).ids) if t else 0 for i, t in enumerate(texts + texts[:2])}


def test_ties_follow_the_library():
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abab", -4.0), ("ba", -2.0), ("▁a", -2.0), ("aa", -2.0), ("aaa", -3.0)]
    library, viterbi, rng = reference(vocabulary), CountingViterbi(vocabulary), random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert viterbi.count("▁" + word) == len(library.encode(word).ids), word


def test_empty(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), P.path("piece_bpe_32k.model")).count() == 0
