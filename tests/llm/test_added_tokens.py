import public_tokenizers as P
from tokenizers import Tokenizer

from datebook.llm.token_shards import read_documents, write_shards

PATH = P.path("byte_bpe_50k.json")
TEXTS = ["a<|endoftext|>b", "plain words", None, "<|endoftext|>", "", "two <|endoftext|> of <|endoftext|>\n them", "  <|endoftext", "<|ENDOFTEXT|> end", "last one"]


def test_added_tokens_as_by_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    shards = write_shards(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1), PATH, P.PATTERN, 2)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in TEXTS]
    assert want[0] == [64, 50256, 65, 2]
    assert [r.tokens for r in sorted(read_documents(shards).collect(), key=lambda r: r.start)] == want
