"""Licence notices, exact phrases and short notices with a few errors.

A notice that may have ``k`` errors is cut into ``k + 1`` seeds, one of which must then stand in the text
unchanged.  An Aho-Corasick automaton finds all seeds in one pass; around each the regular
expression of the whole notice, with ``{e<=k}``, confirms the match and gives its span and errors.

Before that white space is folded: a run of it is one space, and so is a line end with the mark of a comment
on the next line (``*``, ``//``, ``#``, ``;``, ``--``, ``%``, ``>``).  Spans are those of the text as it stands.  Matches are found from the left, each
in its best fit, and the search goes on behind it, so none hides another.

Edge cases: null text is empty text: no words, no labels, score 0; every place of a base phrase counts,
overlapping ones too; spans of one notice that overlap are one, the one of fewest errors; repeated rows
each give a row; other columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.llm.common import alnum_words, map_rows, table

#: Phrases whose words must stand consecutively, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices that are found with errors, and their labels.
NOTICES = {
    "licensed under the apache license": "apache-2.0",
    "permission is hereby granted, free of charge": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "spdx-license-identifier:": "spdx",
    "all rights reserved": "reserved",
}

#: Characters of a notice for each error that it may have.
PER_ERROR = 12

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_RUN = re.compile(r"(?:[ \t]*[\n\x0b\f\r][ \t]*(?:(?:/{2,}|-{2,}|[*#;%>]+)(?=[ \t\n\r])[ \t]*)?)+|[ \t]{2,}|\t")


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """A-Z lower-cased and runs of white space and comment marks as one space; behind each run the place here, and how much longer the text is."""
    low, pieces, at, upto, behind, longer = text.encode().translate(_LOWER).decode(), [], 0, 0, [0], [0]
    for m in _RUN.finditer(low):
        pieces += [low[at : m.start()], " "]
        upto, at = upto + m.start() - at + 1, m.end()
        behind.append(upto)
        longer.append(at - upto)
    return "".join([*pieces, low[at:]]), behind, longer


@dataclass(frozen=True)
class Match:
    label: str
    start: int
    end: int
    errors: int
    chars: int


class FuzzyNotices:
    """Finds notices of up to ``len // per_error`` insertions, deletions and substitutions."""

    def __init__(self, notices: dict[str, str], per_error: int = PER_ERROR):
        self.automaton, self.notices = ahocorasick.Automaton(), []
        seeds: dict[str, list] = {}
        for text, label in notices.items():
            k = len(text) // per_error
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            first, best = (regex.compile(f"(?{flag})(?:{regex.escape(text)}){{e<={k}}}") for flag in "eb")
            self.notices.append((text, label, k, first, best))
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((len(self.notices) - 1, a))
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[Match]:
        """Matches in ``text``, by place; offsets are characters of the text."""
        low, behind, longer = folded(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (length, uses) in self.automaton.iter(low):
            for n, offset in uses:
                whole, _, k, *_ = self.notices[n]
                start = end + 1 - length - offset
                a, b = max(0, start - k), min(len(low), start + len(whole) + k)
                held = windows.setdefault(n, [])
                if held and a <= held[-1][1]:  # seeds come by their end, so starts may go back a little
                    held[-1] = [min(a, held[-1][0]), max(b, held[-1][1])]
                else:
                    held.append([a, b])
        found = []
        for n, spans in windows.items():
            whole, label, k, first, best = self.notices[n]
            for at, end in spans:
                while m := first.search(low, at, end):
                    # What is found first may start or end a little off.
                    m = best.search(low, max(at, m.start() - k), min(end, m.end() + k)) or m
                    a = m.start() + longer[bisect_right(behind, m.start()) - 1]
                    b = m.end() - 1 + longer[bisect_right(behind, m.end() - 1) - 1] + 1
                    found.append(Match(label, a, b, sum(m.fuzzy_counts), len(whole)))
                    at = m.end()
        return sorted(found, key=lambda m: (m.start, m.end, m.label))


def places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Start word and label of each place where a phrase's words stand consecutively."""
    joined, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        sought = b" " + phrase.encode() + b" "
        word, last, at = 0, 0, joined.find(sought)
        while at >= 0:
            word, last = word + joined.count(b" ", last, at), at
            found.append((word, label))
            at = joined.find(sought, at + 1)
    return sorted(found)


def license_scan(docs: DataFrame, phrases: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, per_error: int = PER_ERROR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, places array<struct<word, label>>, matches array<struct<label, start, end, errors, similarity>>``."""

    def work(slices):
        fuzzy = FuzzyNotices(notices, per_error)
        for ids, texts in slices:
            counts, exact, near = [], [], []
            for text in texts:
                words = alnum_words(text)
                counts.append(len(words))
                exact.append([{"word": w, "label": label} for w, label in places(words, phrases)])
                near.append([{"label": m.label, "start": m.start, "end": m.end, "errors": m.errors, "similarity": 1 - m.errors / m.chars} for m in fuzzy.find(text)] if text else [])
            yield [ids, counts, exact, near]

    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), work, f"{id_col} long, n_words long, places array<struct<word: long, label: string>>, matches array<struct<label: string, start: int, end: int, errors: int, similarity: double>>")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan(table(spark, sf_dir, "documents"))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        listed(F.col("places.label")).alias("base_labels"),
        listed(F.concat(F.col("places.label"), F.col("matches.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.similarity"), F.lit(0.0))).alias("score"),
    )
