"""Tokens of queries and symbols, and the intent of a query, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions import constants as K
from lodestrand.functions.paths import basename


def stem(word: Column) -> Column:
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when((n > 5) & word.endswith("ing"), cut(3))
        .when((n > 4) & word.endswith("ed"), cut(2))
        .when((n > 4) & word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def terms(text: Column, most: int = K.MOST_TERMS) -> Column:
    """Distinct stemmed words in order of first use.  Words are ASCII; of each 64 characters the last is dropped."""
    words = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]{1,63})[A-Za-z0-9_]?"), F.lit(1))
    stems = F.transform(words, lambda w: stem(F.lower(w)))
    kept = F.filter(stems, lambda w: (F.length(w) >= 2) & ~w.isin(K.STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def symbol_tokens(name: Column, file: Column, scope: Column, signature: Column, most: int = 32) -> Column:
    """Parts of the name, the name, the file's stem, the scope and the first word of the signature: folded, distinct."""
    parts = F.split(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"), "_")
    stem_of = F.regexp_replace(basename(file), r"\.[^.]*$", "")
    first = F.regexp_extract(signature, r"^([^ (]{2,31})[ (]", 1)
    every = F.concat(parts, F.array(name, stem_of, scope, first))
    folded = F.transform(every, lambda t: F.substring(F.lower(t), 1, 63))
    return F.slice(F.array_distinct(F.filter(folded, lambda t: F.length(t) >= 2)), 1, most)


def contains_folded(text: Column, needle: Column, empty: bool) -> Column:
    """Case does not matter; ``empty``: what an empty needle gives."""
    return F.when(needle == "", F.lit(empty)).otherwise(F.lower(text).contains(F.lower(needle)))


def intent(text: Column) -> Column:
    low, out = F.lower(text), F
    for name, words in K.INTENT_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, name)
    return out.otherwise("unknown")


def estimated_tokens(text: Column) -> Column:
    return (F.floor(F.octet_length(text) / 4) + 1).cast("bigint")


def is_noise(name: Column) -> Column:
    return (F.length(name) < 5) | name.isin(K.NOISE_WORDS)


def rightmost_name(text: Column) -> Column:
    """Last part of a dotted, scoped or slashed name, without what follows its word characters."""
    return F.regexp_extract(text, r"([A-Za-z0-9_]*)[^A-Za-z0-9_]*$", 1)


def one_line(text: Column) -> Column:
    return F.translate(text, "\n\t", "  ")


def toml_escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')
