"""Byte-level BPE encoding and decoding by replaying the merges over a block of the corpus.

The merge of a piece depends on the piece alone, so a block of documents is encoded as one small
corpus: its distinct pieces that the worker hasn't met yet are laid out as one symbol array with
linked neighbours, an inverted index keeps for each rank the positions where that pair stands, and
the ranks are taken in order.  A merge rewrites only the two pairs that touch it.  Nothing is
shuffled, and a lost task is simply run again.

Edge cases: null and empty texts give no ids and decode to empty bytes; repeated rows give one
result each; other columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.llm.common import map_rows, table
from datebook.llm.pieces import PieceStore

SEPARATOR = (1 << 17) - 1

#: Characters of text that are encoded together, which bounds a worker's memory.
BLOCK_CHARS = 12_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeTable:
    """Ranks of all token pairs whose bytes together are a token, as one sorted array of keys."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 17 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the two don't merge."""
        key = left.astype(np.int64) << 17 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def _held(self, at, same, rank, symbol, before, after, word) -> np.ndarray:
        """Which of the pairs at ``at`` must wait: not first in a piece where a merge makes a pair of no higher rank."""
        made = np.full(len(at), rank, np.int32)
        new = np.stack([self.rank(made, symbol[after[after[at]]]), self.rank(symbol[before[at]], made), self.rank(made, made)])
        early = ((new >= 0) & (new <= rank)).any(axis=0)
        return same & np.isin(word[at], word[at[early]]) if early.any() else np.zeros(len(at), bool)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the number of ids of each piece.

        In a piece the lowest rank goes first and the leftmost of equal ranks; a merge can make a
        pair of a lower rank than its own, which then comes before the piece's other merges.  In a
        piece where that can happen a step applies one merge alone; the rest of that rank goes back
        to the index.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = int(lengths.sum()) + len(pieces) + 1
        word = np.repeat(np.arange(len(pieces) + 1, dtype=np.int32), np.append(lengths + 1, 1))
        symbol = np.full(total, SEPARATOR, np.int32)
        inner = np.ones(total, bool)
        inner[np.append(0, np.cumsum(lengths + 1))] = False  # a separator before each piece and at the end
        word[:] = np.cumsum(~inner) - 1
        symbol[inner] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
        now = np.full(total, -1, np.int32)  # rank of the pair that starts here
        now[:-1] = self.rank(symbol[:-1], symbol[1:])
        index: dict[int, list[np.ndarray]] = {}

        def add(ranks: np.ndarray, places: np.ndarray) -> list[int]:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            starts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if len(ranks) else np.array([], int)
            new = []
            for rank, lo, hi in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranks)]):
                if rank in index:
                    index[rank].append(places[lo:hi])
                else:
                    index[rank] = [places[lo:hi]]
                    new.append(rank)
            return new

        first = np.flatnonzero(now >= 0).astype(np.int32)
        heap = add(now[first], first)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[now[at] == rank]
            if not len(at):
                continue
            same = np.append(False, word[at[1:]] == word[at[:-1]])
            if same.any():
                hold = self._held(at, same, rank, symbol, before, after, word)
                if hold.any():
                    index[rank] = [at[hold]]
                    heappush(heap, rank)
                # Of pairs that overlap, as in a run of one symbol, every other one is merged.
                linked = np.append(False, after[at[:-1]] == at[1:])
                place = np.arange(len(at))
                at = at[~hold & ((place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 0)]
            gone = after[at]
            symbol[at], now[gone] = rank, -1
            symbol[gone] = -1
            right, left = after[gone], before[at]
            after[at], before[right] = right, at
            now[at], now[left] = self.rank(symbol[at], symbol[right]), self.rank(symbol[left], symbol[at])
            touched = np.concatenate([at, left])
            touched = touched[now[touched] >= 0]
            for r in add(now[touched], touched):
                heappush(heap, r)
        alive = inner & (symbol >= 0)
        return symbol[alive], np.bincount(word[alive], minlength=len(pieces))[: len(pieces)]


#: What ``\\s`` of the pattern stands for in the tokenizer's own library (Unicode White_Space).
WHITE_SPACE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """``id_col``, ``ids array<int>`` and, with ``decode``, ``decoded binary`` of every whole text.

    ``ranks_path`` names a ``.tiktoken`` file that each executor can read, ``pattern`` is what
    splits a text before the merges.  Special tokens are ordinary text.
    """
    schema = f"{id_col} long, ids array<int>" + ", decoded binary" * decode

    def work(slices):
        merges = MergeTable(load_ranks(ranks_path))
        store = PieceStore(regex.compile(pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")), lambda new: merges.replay([p.encode() for p in new]))
        for ids, texts in slices:
            flat, counts = store.encode(texts)
            offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
            out = [ids, pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))]
            if decode:
                tokens = merges.tokens
                out.append([b"".join([tokens[i] for i in flat[lo:hi].tolist()]) for lo, hi in zip(offsets, offsets[1:])])
            yield out

    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), work, schema, rows=20_000, chars=BLOCK_CHARS)


def decode_ids(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``decoded binary`` from ``ids``; null ids decode to empty bytes."""

    def work(slices):
        tokens = [b""] * (1 << 17)
        for token, rank in load_ranks(ranks_path).items():
            tokens[rank] = token
        for ids, lists in slices:
            yield [ids, [b"".join([tokens[i] for i in x or ()]) for x in lists]]

    return map_rows(encoded.select(F.col(id_col).cast("long"), "ids"), work, f"{id_col} long, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns from ``ids`` and ``decoded``."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
