"""Stemmers: a column expression for tables and the same rule for a single word of a query."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Endings that the light stemmer cuts from words of more than four characters.
ENDINGS = "(ings|ing|edly|ed|es|ly|s)$"


@dataclass(frozen=True)
class Stemmer:
    """Called with a column it gives the column of stems; word() stems one word, each() the words of an array column.

    arrow stems an Arrow array of words at once; prefix: every word begins with its stem.
    """

    name: str
    column: Callable[[Column], Column]
    word: Callable[[str], str]
    array: Callable[[Column], Column] | None = None
    arrow: Callable[[pa.Array], pa.Array] | None = None
    prefix: bool = False

    def __call__(self, word: Column) -> Column:
        return self.column(word)

    def each(self, words: Column) -> Column:
        return self.array(words) if self.array else F.transform(words, self.column)


def as_stemmer(stem: Stemmer | Callable[[Column], Column]) -> Stemmer:
    """Any column function as a stemmer; it stems the words of a query by a one-row job each."""
    if isinstance(stem, Stemmer):
        return stem
    return Stemmer("custom", stem, lru_cache(4096)(lambda w: SparkSession.active().range(1).select(stem(F.lit(w)).alias("s")).first().s))


light_stem = Stemmer(
    "light",
    lambda word: F.when(F.length(word) > 4, F.regexp_replace(word, ENDINGS, "")).otherwise(word),
    lambda word: re.sub(ENDINGS, "", word) if len(word) > 4 else word,
    arrow=lambda words: pc.if_else(pc.greater(pc.utf8_length(words), 4), pc.replace_substring_regex(words, ENDINGS, ""), words),
    prefix=True,
)
identity_stem = Stemmer("identity", lambda word: word, lambda word: word, arrow=lambda words: words, prefix=True)

#: The suffix tables of Porter's algorithm (1980), steps 2, 3 and 4, longest match first.
PORTER_2 = (
    "ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, "
    "alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble"
)
PORTER_3 = "icate ic, ative , alize al, iciti ic, ical ic, ful , ness "
PORTER_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _table(text: str) -> list[tuple[str, str]]:
    pairs = [tuple(pair.strip(" ").partition(" ")[::2]) for pair in text.split(",")]
    return sorted(pairs, key=lambda x: -len(x[0]))


_STEP_2, _STEP_3 = _table(PORTER_2), _table(PORTER_3)
_STEP_4 = sorted(PORTER_4.split(), key=len, reverse=True)


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, table: list[tuple[str, str]]) -> str:
    for suffix, other in table:
        if word.endswith(suffix):
            body = word[: len(word) - len(suffix)]
            return body + other if _measure(body) > 0 else word
    return word


@lru_cache(1 << 18)
def porter(word: str) -> str:
    """Porter's stem of a lower-case word; words of one or two letters, and what is not a-z, stay as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        body = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else None
        if body is not None and "v" in _shape(body):
            word = body
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP_2), _STEP_3)
    for suffix in _STEP_4:
        if word.endswith(suffix):
            body = word[: len(word) - len(suffix)]
            if _measure(body) > 1 and (suffix != "ion" or body.endswith(("s", "t"))):
                word = body
            break
    if word.endswith("e"):
        body = word[:-1]
        if _measure(body) > 1 or (_measure(body) == 1 and not _short(body)):
            word = body
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _porter_column(word: Column) -> Column:
    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        codes, names = pd.factorize(words)
        stems = pd.Series([porter(w) for w in names] + [None], dtype=object)
        return pd.Series(stems.to_numpy()[codes])

    return stem(word)


def _porter_array(words: Column) -> Column:
    @F.pandas_udf("array<string>")
    def stems(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: None if row is None else [porter(w) for w in row])

    return stems(words)


#: Porter's algorithm, in Python over Arrow batches: SQL expressions can't say its measure.
porter_stem = Stemmer("porter", _porter_column, porter, _porter_array)
STEMMERS = {s.name: s for s in (light_stem, identity_stem, porter_stem)}
