"""Texts to ids through their distinct pieces, for tokenizers that split a text before they merge."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Two white-space characters in a row; a superset of every library's ``\\s``.
_WIDE = re.compile(r"\s\s")


class _Codes(dict):
    """Gives each new key the next code and remembers it in ``new``."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        self[key] = code = len(self)
        self.new.append(key)
        return code


class _Flat:
    """Growing arrays of ids by code."""

    def __init__(self):
        self.ids, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.start = np.append(self.start, len(self.ids) + np.cumsum(counts) - counts)
        self.count = np.append(self.count, counts)
        self.ids = np.append(self.ids, ids)

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[codes]
        ends = np.cumsum(counts)
        at = np.repeat(self.start[codes] - ends + counts, counts)
        at += np.arange(len(at))
        return self.ids[at], counts


class PieceStore:
    """Encodes texts by chunk and piece, each distinct one once.

    A space between two characters that aren't white space always starts a piece of the pattern, so
    a text without wide white space is the sequence of its space-led chunks.  Chunks are looked up
    whole; those not met before are split by the pattern, and the pieces not met before are encoded
    together.  Beyond ``most`` entries both stores start anew, so memory is bounded.
    """

    def __init__(self, pattern, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.pattern, self.encode_pieces, self.most = pattern, encode, most
        self.reset()

    def reset(self) -> None:
        self.chunks, self.pieces, self.of_chunk, self.of_piece = _Codes(), _Codes(), _Flat(), _Flat()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        if len(self.chunks) > self.most or len(self.pieces) > self.most:
            self.reset()
        per_text, sizes = [], np.zeros(len(texts), np.int64)
        code = self.chunks.__getitem__
        for i, text in enumerate(texts):
            if not text:
                continue
            if _WIDE.search(text):
                keys = self.pattern.findall(text)
            else:
                keys = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.pattern.findall(text)
            per_text.append(np.fromiter(map(code, keys), np.int64, len(keys)))
            sizes[i] = len(keys)
        if self.chunks.new:
            new, self.chunks.new = self.chunks.new, []
            find, code = self.pattern.findall, self.pieces.__getitem__
            split = [find(chunk) for chunk in new]
            codes = np.fromiter((code(p) for parts in split for p in parts), np.int64, sum(map(len, split)))
            if self.pieces.new:
                fresh, self.pieces.new = self.pieces.new, []
                self.of_piece.extend(*self.encode_pieces(fresh))
            ids, counts = self.of_piece.take(codes)
            owner = np.repeat(np.arange(len(new)), np.fromiter(map(len, split), np.int64, len(new)))
            self.of_chunk.extend(ids, np.bincount(owner, counts, minlength=len(new)).astype(np.int64))
        if not per_text:
            return np.zeros(0, np.int32), sizes
        ids, counts = self.of_chunk.take(np.concatenate(per_text))
        return ids, np.bincount(np.repeat(np.arange(len(texts)), sizes), counts, minlength=len(texts)).astype(np.int64)
