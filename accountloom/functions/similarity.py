"""Distinctive-token similarity between two names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.functions.names import norm_name, tokens


MISSPELT = 0.85  # what a misspelt hit counts of an exact one


def _words(values) -> Column:
    return F.array(*map(F.lit, values))


def distinctive(toks: Column) -> Column:
    """Tokens that carry identity: not an industry word, longer than two."""
    return F.filter(F.array_except(toks, _words(R.GENERIC_TOKENS)), lambda t: F.length(t) > 2)


def strong(toks: Column) -> Column:
    """Distinctive tokens of five letters or more that are not weak words."""
    return F.filter(F.array_except(distinctive(toks), _words(R.WEAK_TOKENS)),
                    lambda t: F.length(t) >= 5)


def token_similarity(a: Column, b: Column) -> Column:
    """One minus edit distance over the longer length; zero when both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when(longest == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / longest)


def whole_name_similarity(a: Column, b: Column) -> Column:
    return string_similarity(norm_name(a), norm_name(b))


def string_similarity(na: Column, nb: Column) -> Column:
    """As ``whole_name_similarity``, of names that are normalised already."""
    return F.when((na == "") | (nb == ""), F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(na, nb) / F.greatest(F.length(na), F.length(nb)))


def jaccard(ta: Column, tb: Column) -> Column:
    union = F.size(F.array_union(ta, tb))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(ta, tb)) / union)


def loose_similarity(a: Column, b: Column) -> Column:
    return F.greatest(jaccard(tokens(a), tokens(b)), whole_name_similarity(a, b))


def _close(x: Column, y: Column) -> Column:
    """Similar enough; edits are only counted where the lengths leave room for one."""
    a, b = F.length(x), F.length(y)
    fewest = F.greatest(F.lit(1), F.abs(a - b))
    return (x == y) | ((F.lit(1.0) - fewest / F.greatest(a, b) >= R.TYPO_SIMILARITY)
                       & (token_similarity(x, y) >= R.TYPO_SIMILARITY))


def _near(x: Column, others: Column) -> Column:
    return F.exists(others, lambda y: _close(x, y))


def distinctive_match(da: Column, db: Column, sa: Column, sb: Column) -> Column:
    """``struct(ratio, strong_shared, shared)`` from distinctive and strong token lists.

    An exact hit counts one.  A misspelt hit counts ``MISSPELT``, and only between
    tokens of at least five letters.
    """
    exact = F.size(F.array_intersect(da, db))
    typo = F.size(F.filter(F.array_except(da, db), lambda x: (F.length(x) >= 5) & F.exists(
        db, lambda y: (F.length(y) >= 5) & _close(x, y))))
    strong_shared = F.size(F.filter(sa, lambda x: F.array_contains(sb, x) | _near(x, sb)))
    shorter = F.least(F.size(da), F.size(db))
    empty = shorter == 0
    return F.struct(
        F.when(empty, F.lit(0.0)).otherwise((exact + typo * MISSPELT) / shorter).alias("ratio"),
        F.when(empty, F.lit(0)).otherwise(strong_shared).alias("strong_shared"),
        F.when(empty, F.lit(0)).otherwise(exact + typo).alias("shared"),
    )


def candidate_score(match: Column, loose: Column) -> Column:
    """Distinctive evidence dominates; loose similarity only orders the leftovers."""
    return (
        F.when(match["strong_shared"] > 0,
               F.least(F.lit(0.99), R.MATCH_SCORE + match["ratio"] * 0.37))
        .when(match["shared"] > 0, match["ratio"] * 0.5)
        .otherwise(loose * 0.4))


def is_acceptable(match: Column, score: Column) -> Column:
    return ((match["strong_shared"] > 0) & (match["ratio"] >= R.MATCH_RATIO)
            & (score >= R.MATCH_SCORE))
