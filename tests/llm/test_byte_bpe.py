import hashlib

import public_tokenizers as P
import tiktoken

from datebook.llm.byte_bpe import byte_bpe, decode_ids, digests, load_ranks

TEXTS = [None, "", " ", "  a  b \n\n c", "aaa aaaa aaaaaaaaaaaaa", "don't  I'll\t\tx   y\x1c z 日本語 😀😀 1234 \0 <|endoftext|>", "Erö ungö, keit.\nDie der die die", "xyxyxyxy " * 400, "word " * 30_000, "ab" * 50_000]


def test_ids_match_tiktoken_and_decode_back(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS + TEXTS[:3])], "doc_id long, text string, ids string").repartition(2)
    got = {r.doc_id: r for r in byte_bpe(docs, path, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS + TEXTS[:3]):
        assert got[i].ids == encoding.encode_ordinary(t or ""), i
        assert bytes(got[i].decoded) == (t or "").encode()
    again = {r.doc_id: bytes(r.decoded) for r in decode_ids(byte_bpe(docs, path, P.PATTERN, decode=False), path).collect()}
    assert again == {i: bytes(r.decoded) for i, r in got.items()}
    row = digests(byte_bpe(docs, path, P.PATTERN)).filter("doc_id = 6").first()
    assert (row.n_tokens, row.ids_sha256) == (len(got[6].ids), hashlib.sha256(",".join(map(str, got[6].ids)).encode()).hexdigest())


def test_empty_table(spark):
    assert byte_bpe(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
