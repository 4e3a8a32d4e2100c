"""Numbers of tokens under a unigram vocabulary, without making the tokens.

Over each distinct word an Aho-Corasick automaton enumerates the pieces that stand in it, and dynamic
programming carries for each place the best score, the number of pieces and whether the last one is
unknown.  The rules are those of the tokenizers library's unigram model: places are taken from left to
right and a piece replaces what a place has only if its score is strictly higher; a character without a
piece of its own is unknown at ten below the lowest score, and unknown neighbours are one token.

Words are split before the space that leads them, as the metaspace pre-tokenizer does, and each
distinct word of a block is counted once.

Edge cases: null and empty texts have no tokens; repeated rows each give a row; other columns are left
out.
"""

from __future__ import annotations

from math import log

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.llm.common import map_rows, table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece model with unigram scores by their rank (Zipf's law); unknown first.

    Control, byte and unknown pieces can't stand in a text and are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = log(sum(1 / (i + 1) for i in range(len(pieces))))
    return [("<unk>", 0.0)] + [(p, -log(i + 1) - total) for i, p in enumerate(pieces)]


class CountingViterbi:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        """``vocabulary``: pieces and scores; the first is the unknown token."""
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            self.automaton.add_word(piece, (len(piece), score, i == 0))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        """Tokens of one pre-tokenized word."""
        n = len(word)
        by_start: list[list[tuple[int, float, bool]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(word):
            by_start[end + 1 - piece[0]].append(piece)
        best: list = [None] * (n + 1)  # score, tokens, ends in an unknown
        best[0] = (0.0, 0, False)
        for i in range(n):
            score, tokens, unknown = best[i]
            single = False
            for length, s, is_unknown in sorted(by_start[i]):
                single |= length == 1
                now = best[i + length]
                if now is None or score + s > now[0]:
                    best[i + length] = (score + s, tokens + (not (unknown and is_unknown)), is_unknown)
            if not single:
                now = best[i + 1]
                if now is None or score + self.unknown > now[0]:
                    best[i + 1] = (score + self.unknown, tokens + (not unknown), True)
        return best[n][1]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", cached: int = 500_000) -> DataFrame:
    """``id_col, n_words long, n_tokens long`` of every whole text; ``cached`` bounds what a worker remembers."""

    def work(slices):
        viterbi, known = CountingViterbi(load_vocabulary(vocabulary_path)), {}
        for ids, texts in slices:
            if len(known) > cached:
                known = {}
            words, tokens = [], []
            for text in texts:
                parts = text.replace(SPACE, " ").split(" ") if text else []
                parts = parts[1:] if parts and not parts[0] else parts  # a text that starts with a space gets no other
                for w in parts:
                    if w not in known:
                        known[w] = viterbi.count(SPACE + w)
                words.append(len(parts))
                tokens.append(sum(map(known.__getitem__, parts)))
            yield [ids, words, tokens]

    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), work, f"{id_col} long, n_words long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
