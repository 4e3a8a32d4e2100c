import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from datebook.llm.token_shards import TokenShard, document_digests, read_documents, token_occurrences, write_shards

PATH = P.path("byte_bpe_50k.json")
TEXTS = [None, "", "  a  b \n\n c", "don't  I'll\t\tx 日本語 😀 1234 # \0", "Die der, die. " * 50, "ab" * 3000, "word " * 20_000, " lead", "tail ", "# # #"] + [f"text {i} of many words" for i in range(200)]


def test_shards_give_back_every_token(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(7 * i % 210, t, "x") for i, t in enumerate(TEXTS)] + [(3, "twice", "x"), (3, "again", "x"), (None, "no id", "x")]
    want = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))]
    shards = write_shards(spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(3), PATH, P.PATTERN, 2, shard_tokens=5000)
    assert shards.count() > 1
    got = sorted(read_documents(shards).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.tokens) for r in got] == want
    starts = np.cumsum([0] + [len(t) for _, t in want])[:-1].tolist()
    assert [r.start for r in got] == starts
    digests = sorted(document_digests(shards, 2).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in digests] == [(d, s, len(t), zlib.crc32(np.array(t, "<u4").tobytes()), t[0], t.count(2)) for (d, t), s in zip(want, starts)]
    flat = [x for _, t in want for x in t]
    assert sorted(r.place for r in token_occurrences(shards, 2).collect()) == [i for i, x in enumerate(flat) if x == 2]


def test_shard_queries():
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 50_000, 3000) % rng.integers(1, 50_000, 3000)
    shard = TokenShard.from_bytes(TokenShard.of([5, None], np.array([1000, 2000]), tokens).to_bytes())
    assert (shard.tokens() == tokens).all() and (shard.document(1) == tokens[1000:]).all()
    for t in (int(tokens[0]), 0, 49_999):
        assert (shard.occurrences(t) == np.flatnonzero(tokens == t)).all() and shard.count(t, 700) == (tokens[:700] == t).sum()


def test_a_token_costs_a_frame_of_each_plane():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 900, 300_000)
    shard = TokenShard.from_bytes(TokenShard.of([1, 2, 3], np.array([100_000, 65_536, 134_464]), tokens).to_bytes())
    assert shard.first_tokens().tolist() == tokens[[0, 100_000, 165_536]].tolist()
    planes = shard.matrix.planes
    assert len(planes) == 10 and all(len(p.loaded) <= 3 for p in planes)
    for t in (0, 5, 899, 900):
        assert (shard.occurrences(t) == np.flatnonzero(tokens == t)).all()
        assert shard.counts_before(t, np.array([0, 65_536, 300_000])).tolist() == [int((tokens[:n] == t).sum()) for n in (0, 65_536, 300_000)]
    assert (shard.tokens() == tokens).all()
    for n in (0, 1, 63, 64, 65_535, 65_536, 131_072):
        some = TokenShard.from_bytes(TokenShard.of([1], np.array([n]), tokens[:n]).to_bytes())
        assert (some.tokens() == tokens[:n]).all() and (some.occurrences(7) == np.flatnonzero(tokens[:n] == 7)).all()


def test_empty(spark):
    shards = write_shards(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN, 2)
    assert document_digests(shards, 2).count() == 0 and read_documents(shards).count() == 0
