"""Name normalisation, trigrams, similarity score and similarity-join tokens.

Similarity (the source system used a fuzzy-matching library that is not available
here; this is our own score with the same cut-offs, it is *not* equal to that
library's ratios):

    char_score  = 100 * (1 - levenshtein(a, b) / greatest(length(a), length(b)))
    token_score = 100 if the words of one name are all among the words of the other,
                  else 100 * |A intersect B| / |A union B|
    score       = greatest(char_score, token_score)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def norm_name(col) -> Column:
    """Lower case, runs of white space collapsed to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), r"\s+", " "))


# Every overlapping 3-character slice: a zero-width lookahead match at each position
# captures the next three characters (one regex pass, no per-element lambda).
_TRIGRAM_RE = "(?s)(?=(.{3}))"


def trigrams(col) -> Column:
    """Distinct 3-letter slices of the lower-cased text with blanks removed."""
    s = F.replace(F.lower(_c(col)), F.lit(" "), F.lit(""))
    return F.array_distinct(F.regexp_extract_all(s, F.lit(_TRIGRAM_RE), 1))


def words(col) -> Column:
    """Distinct non-empty words of a name split on single blanks."""
    return F.array_distinct(F.filter(F.split(_c(col), " "), lambda w: w != F.lit("")))


def char_score(a, b) -> Column:
    a, b = _c(a), _c(b)
    longest = F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0))
    return F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / longest)


def token_score(a_words, b_words) -> Column:
    a, b = _c(a_words), _c(b_words)
    contained = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return F.when(contained, F.lit(100.0)).otherwise(
        F.lit(100.0) * F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def similarity(a_norm, b_norm, a_words=None, b_words=None) -> Column:
    """Score in [0, 100] of two normalised names.

    Pass ``a_words`` / ``b_words`` as columns already holding ``words(...)`` to avoid
    deriving the word arrays again at each of their uses."""
    aw = words(a_norm) if a_words is None else _c(a_words)
    bw = words(b_norm) if b_words is None else _c(b_words)
    return F.greatest(char_score(a_norm, b_norm), token_score(aw, bw))


def padded_grams(norm_col) -> Column:
    """Padded character trigrams ('##' + name + '##') in order, repeats kept."""
    s = F.concat(F.lit("##"), _c(norm_col), F.lit("##"))
    return F.regexp_extract_all(s, F.lit(_TRIGRAM_RE), 1)


def numbered_grams(grams_col) -> Column:
    """``g:abc#1``, ``g:abc#2`` ...: trigrams numbered by occurrence, so the multiset of
    trigrams becomes a set whose intersection size equals the multiset intersection (the
    count lemma is about multisets).  ``grams_col`` must be a column holding the output of
    ``padded_grams`` (not the expression itself, which lambdas would re-evaluate)."""
    g = _c(grams_col)
    return F.transform(g, lambda x, i: F.concat(
        F.lit("g:"), x, F.lit("#"),
        F.size(F.filter(F.slice(g, 1, i + 1), lambda y: y == x)).cast("string")))


def word_tokens(norm_col) -> Column:
    return F.transform(words(norm_col), lambda w: F.concat(F.lit("w:"), w))
