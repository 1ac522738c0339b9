"""Name expressions: keys, display names, rules, person test, site numbers.

All are plain Columns on JVM-side functions, so they run inside code generation
and need no Python worker.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom import refdata as R


@dataclass(frozen=True)
class Rule:
    """One canonical rule: alternatives in a raw pattern, and the name they mean."""

    pattern: str
    canonical: str


def rules_of(pairs: Sequence[tuple[str, str]]) -> tuple[Rule, ...]:
    return tuple(Rule(pattern, canonical) for pattern, canonical in pairs)


def non_blank(c: Column) -> Column:
    """The untrimmed value, or null when nothing but space is there."""
    return F.when(F.trim(c) != "", c)


def squeeze(c: Column) -> Column:
    """Collapse runs of white space and trim."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def match_key(c: Column) -> Column:
    """Bucket key: lower case, legal suffix words out, only letters, digits and &."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(c), R.LEGAL_SUFFIXES, " "), r"[^a-z0-9&]", "")


def display_name(c: Column) -> Column:
    """Readable account name: separators become spaces, joiners disappear."""
    bare = F.regexp_replace(c, R.LEGAL_SUFFIXES, " ")
    spaced = F.regexp_replace(bare, r"[-/_,]", " ")
    joined = F.regexp_replace(spaced, "['’.]", "")
    return squeeze(F.regexp_replace(joined, r"[^A-Za-z0-9& ]", " "))


def norm_name(c: Column) -> Column:
    """Comparable name that keeps word boundaries (punctuation goes first)."""
    words = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9& ]", " ")
    return squeeze(F.regexp_replace(words, R.LEGAL_SUFFIXES, " "))


def tokens(c: Column) -> Column:
    """Distinct words of the normalised name longer than one character."""
    return F.array_distinct(F.filter(F.split(norm_name(c), " "), lambda t: F.length(t) > 1))


def is_usable(c: Column) -> Column:
    """False for blanks and for strings that only look like names."""
    n = norm_name(c)
    return (n != "") & ~n.isin(*R.JUNK_NAMES)


def guard(pattern: str, word_final: Sequence[str] = R.WORD_FINAL) -> str:
    """Keep every alternative from matching in the middle of a word.

    Anchored alternatives already start at a boundary; complete words must end
    at one as well.
    """
    pieces = pattern.split("|")
    before = ["" if p.startswith("^") else "(?<![a-z0-9])" for p in pieces]
    behind = ["(?![a-z0-9])" if p.lstrip("^") in word_final else "" for p in pieces]
    return "|".join(map("".join, zip(before, pieces, behind)))


def first_rule(low: Column, rules: Sequence[Rule], *, guarded: bool = True,
               word_final: Sequence[str] = R.WORD_FINAL) -> Column:
    """Canonical name of the first rule that matches a lower-cased name, else null.

    Most names match no rule, so one combined pattern is tried first and the
    ordered chain only runs for names that match something.
    """
    if not rules:
        return F.lit(None).cast("string")
    patterns = [guard(r.pattern, word_final) if guarded else r.pattern for r in rules]
    chain = F.coalesce(*[
        F.when(low.rlike(p), F.lit(r.canonical)) for p, r in zip(patterns, rules)])
    return F.when(low.rlike("|".join(f"(?:{p})" for p in patterns)), chain)


def with_resolution(names: DataFrame, name: str, rules: Sequence[Rule],
                    word_final: Sequence[str] = R.WORD_FINAL) -> DataFrame:
    """Add ``key``, ``shown`` and ``resolved_by`` to a table of reported names.

    A rule wins; otherwise the cleaned name itself is the company.  The key is
    null when the name is unusable.  Junk is tested on the spaced form as well
    as on the key, so that "Not applicable" is refused like "N/A".  Meant for
    the distinct spellings, where each pattern runs once per spelling; the steps
    are separate columns so that no pattern is evaluated twice.
    """
    raw = F.col(name)
    ruled = F.col("_ruled")
    ok = (F.trim(raw) != "") & (F.col("_key") != "") & (F.col("_shown") != "") \
        & ~F.col("_key").isin(*R.JUNK_NAMES) & (F.col("_norm") != "") \
        & ~F.col("_norm").isin(*R.JUNK_NAMES)
    return (
        names.withColumn("_ruled", first_rule(F.lower(raw), rules, word_final=word_final))
        .withColumns({"_key": match_key(F.coalesce(ruled, raw)), "_shown": display_name(raw),
                      "_norm": norm_name(raw)})
        .withColumns({
            "key": F.when(ruled.isNotNull() | ok, F.col("_key")),
            "shown": F.when(ruled.isNotNull(), ruled).when(ok, F.col("_shown")),
            "resolved_by": F.when(ruled.isNotNull(), "rule").when(ok, "fallback")})
        .drop("_ruled", "_key", "_shown", "_norm"))


def looks_like_person(name: Column) -> Column:
    """First and last name in title case, and no business word anywhere."""
    trimmed = F.trim(name)
    return F.coalesce(trimmed.rlike(R.PERSON_NAME) & ~trimmed.rlike(R.BUSINESS_WORD), F.lit(False))


def strip_site_qualifier(name: Column) -> Column:
    """Drop one trailing parenthetical, never down to nothing."""
    bare = F.trim(F.regexp_replace(name, R.SITE_QUALIFIER, ""))
    return F.when(bare != "", bare).otherwise(F.trim(name))


def site_number_stem(name: Column) -> Column:
    """The name in front of a trailing site number, or null."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(name), R.SITE_NUMBER, 1)), F.lit(""))


def merge_rescue(name: Column, key: Column, rules: Sequence[Rule]) -> Column:
    """Account this name would have fallen into without the word guards, or null."""
    loose = first_rule(F.lower(name), rules, guarded=False)
    return F.when(loose.isNotNull() & ~match_key(loose).eqNullSafe(key), loose)


def pick_reported(parent: Column, operator: Column, facility: Column,
                  operator_is_person: Column) -> Column:
    """First non-blank of parent, operator, facility.

    A person in the operator field ranks below the facility name.
    """
    p, o, f = non_blank(parent), non_blank(operator), non_blank(facility)
    return F.when(operator_is_person, F.coalesce(p, f, o)).otherwise(F.coalesce(p, o, f))


def initials(name: Column) -> Column:
    """First letters of the first and last word, upper case; null for no name."""
    parts = F.split(squeeze(name), " ")
    first = F.substring(F.element_at(parts, 1), 1, 1)
    last = F.when(F.size(parts) > 1, F.substring(F.element_at(parts, -1), 1, 1)).otherwise("")
    return F.when(F.trim(name) != "", F.upper(F.concat(first, last)))


def read_groups(claim: Column) -> Column:
    """Comma-separated group claim to a list of non-blank names."""
    parts = F.transform(F.split(F.coalesce(claim, F.lit("")), ","), lambda g: F.trim(g))
    return F.filter(parts, lambda g: g != "")
