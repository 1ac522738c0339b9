"""The rule table against the folded chain of rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.functions.names import first_rule, rules_of
from accountloom.operators.resolve import alternatives, required_literal, resolve_by_rule_table


@pytest.mark.parametrize("pattern,literal", [
    ("americold", "americold"), (r"u\.?s\.? foods", " foods"), ("nestl[eé]", "nestl"), ("^sysco", "sysco"),
    ("wal-?mart", "mart"), ("metropolitan water district of (southern|so\\.?) california", "metropolitan water district of "),
    ("a+bcd", "bcd"), ("ab{0,2}cde", "cde"), ("[0-9]+", ""), ("", ""), (".*", ""), ("(?i)ABC", ""), (r"\d\w", ""),
    (r"c\+\+ shop", "c++ shop"), ("x(yy)?zz", "zz"), ("ab*?cd", "cd"), ("q[]x]r", "q"), (r"\Qa?\E", "")])
def test_required_literals(pattern, literal):
    assert required_literal(pattern) == literal


def test_every_match_holds_its_literal():
    rng = random.Random(3)
    for _ in range(3000):
        pattern = "".join(rng.choice(["a", "b", "c", "d", "\\.", "[ab]", "(ab|c)", "?", "*", "+", ".", "{0,1}", "^", "$"])
                          for _ in range(rng.randrange(1, 8)))
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        for _ in range(10):
            text = "".join(rng.choice("abcd.") for _ in range(rng.randrange(0, 9)))
            if compiled.search(text):
                assert any(required_literal(a) in text for a in alternatives(pattern)), (pattern, text)


def test_alternatives_are_cut_outside_groups():
    assert alternatives(r"a(b|c)d|[x|y]|e\|f|^g") == ["a(b|c)d", "[x|y]", r"e\|f", "^g"]


def test_same_answers_as_the_folded_rules(spark):
    pairs = [*R.COLD_RULES, *R.WATER_RULES, ("[0-9]{4}", "Numbered"), ("ab", "Short"), ("cold", "Any Cold"), ("", "Rest")]
    rng = random.Random(5)
    stock = ["cold", "storage", "americold", "us", "u.s.", "foods", "sysco", "the", "kroger", "water", "dallas", "utilities",
             "wal-mart", "walmart", "koch", "st.", "louis", "board", "of", "1234", "ab", "jbs", "wjbs", "aldi", "aldine",
             "Nestlé", "nestle", "dollar", "general", "metropolitan", "district", "southern", "california", "city"]
    names = sorted({" ".join(rng.choice(stock) for _ in range(rng.randrange(1, 7))).title() + " Cold" for _ in range(400)})
    df = spark.createDataFrame([(n,) for n in [*names, "", None]], "n string")
    for chosen in (pairs[:-1], pairs, pairs[:-4]):
        table = spark.createDataFrame([(p, c, i) for i, (p, c) in enumerate(chosen)], "pattern string, canonical string, rule_ord int")
        got = {r["n"]: r["canonical"] for r in resolve_by_rule_table(df, "n", table).collect()}
        want = df.withColumn("c", first_rule(F.lower("n"), rules_of(chosen))).filter("c is not null").collect()
        assert got == {r["n"]: r["c"] for r in want} and got


def test_no_rules_and_unmatched_literals(spark):
    df = spark.createDataFrame([("Acme",)], "n string")
    schema = "pattern string, canonical string, rule_ord int"
    assert resolve_by_rule_table(df, "n", spark.createDataFrame([], schema)).collect() == []
    assert resolve_by_rule_table(df, "n", spark.createDataFrame([("zebra", "Z", 1), (None, "N", 2)], schema)).collect() == []


def test_a_shared_word_files_no_rule(spark):
    """All names and all rules hold the same word: names still meet only rules with a rarer piece of theirs."""
    n = 3_000
    names = spark.range(n).select(F.concat(F.lit("cold storage "), F.lpad((F.col("id") * 7919 % 100_000).cast("string"), 5, "0")).alias("n"))
    rules = names.select(F.col("n").alias("pattern"), F.upper("n").alias("canonical"), F.col("n").alias("rule_ord"))
    got = resolve_by_rule_table(names, "n", rules)
    assert got.filter(F.upper("n") == F.col("canonical")).count() == n
