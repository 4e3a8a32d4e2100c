"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from datebook.functions.arrow_signals import SPACE_CHARS
from datebook.functions.patterns import PROVIDERS, SPACES, S


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    Expressions have no local names: written out, a value used five times inside one used five times is
    computed twenty-five times.  A lambda's variable holds it.
    """
    return F.get(F.transform(F.array(value), body), 0)


def trim(x: Column) -> Column:
    """Without white space at both ends, non-breaking spaces included."""
    return F.btrim(x, F.lit(SPACE_CHARS))


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def normalize_model_text(x: Column) -> Column:
    """Line ends as LF, runs of spaces as one, none beside a line end, at most two blank lines; tabs stay."""
    x = F.coalesce(x, F.lit(""))
    # Only what changes is replaced, and by plain search where one form of it is left.
    for a, b in (("\r\n", "\n"), ("\r", "\n"), ("\f", " "), ("\x0b", " ")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, " {2,}", " ")
    x = F.replace(F.replace(x, F.lit("\n "), F.lit("\n")), F.lit(" \n"), F.lit("\n"))
    return trim(F.regexp_replace(x, r"\n{4,}", "\n\n\n"))


def strip_markdown_links(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"\[([^\]]+)\]\([^)]+\)", "$1")


def line_fingerprint(x: Column) -> Column:
    """Letters and digits of a line, for finding it in another text."""
    x = F.regexp_replace(F.lower(strip_markdown_links(x)), rf"^(?:[#>*-]|{S})+", "")
    return F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " "))


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not 0x300 <= ord(c) <= 0x36F)


@F.pandas_udf(StringType())
def _decomposed(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else _plain(s))


@F.arrow_udf(ArrayType(StringType()))
def _decomposed_each(x: pa.Array) -> pa.Array:
    return pa.array([own and [s and _plain(s) for s in own] for own in x.to_pylist()], pa.list_(pa.string()))


def _not_ascii(x: Column) -> Column:
    return F.octet_length(x) > F.char_length(x)


def _curled(x: Column) -> Column:
    """Straight quotes and plain dashes; texts of ASCII have no others."""
    x = F.regexp_replace(F.regexp_replace(x, r"[\u2018\u2019\u201B]", "'"), r"[\u201C\u201D]", '"')
    return F.regexp_replace(x, r"[\u2010-\u2015]", "-")


def _spaced(x: Column, spaces: str = SPACES) -> Column:
    """Single spaces; a single space is left as it is."""
    return F.regexp_replace(x, rf"[{spaces.replace(' ', '')}][{spaces}]*| [{spaces}]+", " ")


def _straight(x: Column) -> Column:
    """Compatibility decomposition without combining accents, straight quotes, plain dashes, single spaces; texts of ASCII don't leave the JVM's row."""
    return F.when(_not_ascii(x), _spaced(_curled(_decomposed(F.when(_not_ascii(x), x))))).otherwise(_spaced(x, r"\t-\r "))


def _tight(x: Column) -> Column:
    x = F.regexp_replace(x, r" +([,.;:!?])", "$1")
    x = F.regexp_replace(F.regexp_replace(x, r"([(/]) +", "$1"), r" +([)/])", "$1")
    return F.lower(trim(F.regexp_replace(x, r" *- *", "-")))


def normalize_search_text(x: Column) -> Column:
    """For containment: plain letters, straight quotes and dashes, tight punctuation, brackets and hyphens."""
    return _tight(_straight(F.coalesce(x, F.lit(""))))


def normalize_search_texts(x: Column) -> Column:
    """:func:`normalize_search_text` of each text of an array; arrays of ASCII don't leave the JVM's row."""
    x = F.transform(x, lambda s: F.coalesce(s, F.lit("")))
    other = F.exists(x, _not_ascii)
    return F.transform(F.when(other, _decomposed_each(F.when(other, x))).otherwise(x), lambda s: _tight(_spaced(_curled(s))))


def normalize_judge_text(x: Column) -> Column:
    """As :func:`normalize_search_text` with punctuation left where it is."""
    return F.lower(trim(_straight(F.coalesce(x, F.lit("")))))


def normalize_judge_title(x: Column) -> Column:
    return F.lower(F.regexp_replace(trim(F.coalesce(x, F.lit(""))), rf"{S}+", " "))


def marker_text(x: Column) -> Column:
    x = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), rf"{S}+", " ")
    return trim(F.regexp_replace(x, r"[\u2013\u2014]", "-"))


def fixture_file_name(name: Column) -> Column:
    """A slug with ``.json``; null where nothing is left of the name."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.when(slug != "", F.concat(slug, F.lit(".json")))


def pad_zero(x: Column, width: int = 2) -> Column:
    """Zeros before a number, which is never cut."""
    x = x.cast("string")
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, "0"))


def provider_name(x: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in PROVIDERS.items() for v in pair])
    return F.coalesce(F.try_element_at(known, x), F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30)))


def byte_length(x: Column) -> Column:
    return F.octet_length(F.coalesce(x, F.lit(""))).cast("long")


def round_number(x: Column, places: int = 4) -> Column:
    """Halves go up, also below zero."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.floor(x * 10**places + 0.5) / F.lit(float(10**places)))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def context_includes(context: Column, label: Column) -> Column:
    """Whether the context contains the label, both normalised; an empty label is in every context."""
    return F.contains(normalize_search_text(context), normalize_search_text(label))


def grouped_number(x: Column) -> Column:
    """With commas; a dash where there is none."""
    return F.coalesce(F.format_number(x, 0), F.lit("-"))


def reset_time(at: Column, clock: str = "12") -> Column:
    """Hour and minute of a timestamp; a dash where there is none."""
    return F.coalesce(F.date_format(at, "HH:mm" if clock == "24" else "h:mm a"), F.lit("-"))
