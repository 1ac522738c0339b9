"""Resolution against a rule table that is too large to fold into one expression.

A pattern can only match a name that holds one of its literals: the longest stretch of
plain characters of each alternative.  A literal is filed under the one of its
three-letter pieces that the fewest names hold, and names meet rules there.  So a word
that all names share files no rule as long as the literal has a rarer piece, and no
name is tried against the whole table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.functions.names import guard
from accountloom.session import pin

GRAM = 3


def alternatives(pattern: str) -> list[str]:
    """The pattern cut at its outermost ``|``."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _class_end(pattern, i)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def _class_end(pattern: str, at: int) -> int:
    """Place of the ``]`` that ends the class opened at ``at``."""
    at += 2 if pattern[at + 1:at + 2] == "^" else 1
    if pattern[at:at + 1] == "]":
        at += 1
    while at < len(pattern) and pattern[at] != "]":
        at += 2 if pattern[at] == "\\" else 1
    return at


def required_literal(alternative: str) -> str:
    """The longest stretch of plain characters that every match holds; empty if none is certain.

    Groups and classes end a stretch.  A pattern that changes flags, quotes with ``\\Q`` or
    nests classes has no certain literal.
    """
    if re.search(r"\(\?[a-zA-Z-]|\\Q|\[[^\]]*(\[|&&)", alternative):
        return ""
    runs, run, i = [], "", 0
    while i < len(alternative):
        c = alternative[i]
        if c == "\\":
            i += 1
            c = alternative[i:i + 1]
            plain = not c.isalnum()
        elif c == "[":
            i, plain = _class_end(alternative, i), False
        elif c == "(":
            depth = 1
            while depth and i + 1 < len(alternative):
                i += 1
                if alternative[i] == "\\":
                    i += 1
                elif alternative[i] == "[":
                    i = _class_end(alternative, i)
                else:
                    depth += {"(": 1, ")": -1}.get(alternative[i], 0)
            plain = False
        else:
            plain = c not in "^$.)|"
        behind = alternative[i + 1:i + 2]
        if behind and behind in "?*{":  # the character before may be missing
            plain = False
            if behind == "{":
                i = alternative.find("}", i)
                if i < 0:
                    return ""
            else:
                i += 1
            while alternative[i + 1:i + 2] in ("?", "+"):
                i += 1
        elif behind == "+":
            run, plain = run + (c if plain else ""), False
            i += 1
            while alternative[i + 1:i + 2] in ("?", "+"):
                i += 1
        if plain:
            run += c
        else:
            runs.append(run)
            run = ""
        i += 1
    return max([*runs, run], key=len)


def _prepared(word_final: tuple[str, ...]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rules in frames:
            out = rules.copy()
            out["guarded"] = [guard(p, word_final) for p in rules["pattern"]]
            out["literal"] = [sorted({required_literal(a).lower() for a in alternatives(p)}) for p in rules["pattern"]]
            yield out

    return run


def _grams(text: Column, size: Column) -> Column:
    """Distinct pieces of ``size`` characters; of the empty size, one empty piece."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.when(size == 0, F.lit(1)).otherwise(last)), lambda i: F.substr(text, i, size))))


def resolve_by_rule_table(names: DataFrame, name: str, rules: DataFrame,
                          word_final: Sequence[str] = R.WORD_FINAL) -> DataFrame:
    """``name, canonical``: the first rule that matches, for every distinct name that any matches.

    ``rules`` holds ``pattern``, ``canonical`` and ``rule_ord``; patterns are guarded
    against matches inside words as in ``first_rule``, which gives the same answers.
    Rules without a certain literal are tried on every name, as they have to be.
    """
    kept = rules.select("rule_ord", "pattern", "canonical").dropna(subset=["rule_ord", "pattern"])
    kinds = dict(kept.dtypes)
    prepared = pin(kept.mapInPandas(
        _prepared(tuple(word_final)), f"rule_ord {kinds['rule_ord']}, pattern string, canonical string, "
                                      "guarded string, literal array<string>"), "rules")
    # of an alternative's literal only the first characters decide how long its pieces are
    literals = prepared.select("rule_ord", "canonical", "guarded", F.explode("literal").alias("literal"))
    sizes = [r[0] for r in literals.select(F.least(F.length("literal"), F.lit(GRAM)).alias("n")).distinct().collect()]
    low = pin(names.select(name, F.lower(name).alias("_low")).filter("_low is not null").distinct(), "rule-names")
    size = F.explode(F.array(*map(F.lit, sorted(sizes)))) if sizes else F.explode(F.array().cast("array<int>"))
    spread = low.withColumn("_size", size).select(name, "_low", F.explode(_grams(F.col("_low"), F.col("_size"))).alias("gram"))
    often = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    pieces = literals.withColumn("gram", F.explode(_grams(F.col("literal"), F.least(F.length("literal"), F.lit(GRAM)))))
    rarest = Window.partitionBy("rule_ord", "guarded", "literal").orderBy("n", "gram")
    # a literal with a piece that no name holds matches nothing
    filed = (pieces.join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
             .withColumn("_at", F.row_number().over(rarest)).filter("_at = 1 and n > 0")
             .select("gram", "literal", "rule_ord", "canonical", "guarded"))
    met = spread.join(filed, "gram").filter(F.contains("_low", "literal"))
    hits = met.filter(F.regexp_like("_low", F.col("guarded")))
    return hits.groupBy(name).agg(F.min_by("canonical", "rule_ord").alias("canonical"))
