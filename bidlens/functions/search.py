"""Full-text conditions as columns, to be combined with ``&``, ``|`` and ``~``. They hold on a text made by :func:`searchable`."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens.functions.scalars import text_norm


def searchable(text: Column) -> Column:
    """The words of a text, without marks and in lower case, each between single spaces; null for null."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(text_norm(text), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))


def folded(words: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", words.lower()) if not unicodedata.combining(c))
    out = re.findall(r"\w+", plain)
    if not out:
        raise ValueError(f"no word in {words!r}")
    return out


def phrase(text: Column, words: str) -> Column:
    """Whether the text has these words, one after the other; a single word is a phrase, too."""
    return text.contains(f" {' '.join(folded(words))} ")


def prefix(text: Column, words: str) -> Column:
    """As :func:`phrase`; the last word may go on."""
    return text.contains(f" {' '.join(folded(words))}")


def near(text: Column, one: str, other: str, most: int = 10) -> Column:
    """Whether both words are there, in either order, with ``most`` words between them at most."""
    (a,), (b,) = folded(one), folded(other)
    between = rf" (?:[^ ]+ ){{0,{most}}}"
    return text.rlike(f" {a}{between}{b} ") | text.rlike(f" {b}{between}{a} ")
