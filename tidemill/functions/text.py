"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def space_tokens(x: Column) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda t: t != ""))


def alnum_tokens(x: Column) -> Column:
    """Lower-case [a-z0-9]+ tokens with repeats."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), 0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 for two empty sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def containment(query: Column, other: Column) -> Column:
    """Share of the query's distinct tokens that the other has."""
    q = F.array_distinct(query)
    return F.size(F.array_intersect(q, other)) / F.greatest(F.size(q), F.lit(1))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda t: t != "")).cast("long")


def first_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(squeeze(x), " "), 1, n), " ")


def clean_identifiers(x: Column) -> Column:
    """[AB] becomes (AB); the class spans all code points from A to z, so it takes six marks too."""
    return F.regexp_replace(x, r"\[([A-z]+)\]", "($1)")


def identifiers(x: Column) -> Column:
    """Single letters in brackets, in order."""
    return F.regexp_extract_all(x, F.lit(r"\[([A-Z])\]"), 1)


def is_permutation(found: Column, n: Column) -> Column:
    """Whether the letters are the first n of the alphabet, each once."""
    expected = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.char(i + 65))
    return F.array_sort(found) == expected


#: Common English function words.
#: Terms of the query rules.
RECOMMEND = ("best", "recommend", "推荐", "适合")
COMPARE = ("compare", "vs", "比较", "区别")
LIMITS = ("near", "cheap", "best", "budget", "附近", "便宜")
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def latin_ratio(x: Column) -> Column:
    """Share of basic Latin letters among the characters that aren't white space."""
    bare = F.regexp_replace(x, r"\s", "")
    return F.length(F.regexp_replace(bare, "[^A-Za-z]", "")) / F.greatest(F.length(bare), F.lit(1))


def stop_ratio(x: Column) -> Column:
    words = F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), 0)
    return F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))) / F.greatest(F.size(words), F.lit(1))


def intent(x: Column) -> Column:
    """Rule-based class of a query; the terms match inside words too."""
    low, has = F.lower(x), lambda terms: "|".join(terms)
    return F.when(low.rlike(has(RECOMMEND)), "recommendation").when(low.rlike(has(COMPARE)), "comparison").otherwise("informational-search")


def constraints(x: Column) -> Column:
    """Words of a query that limit it, as they are written."""
    return F.filter(F.split(squeeze(x), " "), lambda w: F.lower(w).isin(*LIMITS))


def choice(x: Column) -> Column:
    """first, second or tie from a model's answer."""
    t = F.upper(F.trim(x))
    return F.when(t.isin("A", "PASSAGE A"), "first").when(t.isin("B", "PASSAGE B"), "second").otherwise("tie")
