"""Fuzzy name matching on distinctive tokens, without comparing all names.

A candidate is acceptable when it shares a strong token and at least half of the
shorter name's distinctive tokens, exactly or nearly.  Only the best few candidates of a
name are wanted, so frequent tokens need no pair lists.

Candidates are filed in posting lists under their tokens, rarest first.  A list that
holds more than ``PAGE`` candidates is overfull: of every size it keeps only its first k
candidates, and all of its candidates are filed again under that token and each more
frequent one of theirs, and so on.  A name looks up its own tokens, and what they may be
misspellings of, by the same rule: it goes on to longer token sets only where a list is
overfull.  Nothing is lost.  Let M be the tokens of a candidate that a name can use.  If
any of the lists along M, from the rarest token on, is whole, the candidate is in it.
If all are overfull, so is the list of M itself, and k candidates of the same size that
hold all of M, and so score at least as much, stand before it there.

A token that is more frequent than an overfull one is overfull, too.  So only overfull
tokens are ever ordered and joined to longer sets; under all others, which are nearly
all, names and candidates meet by one join.  There a pair is two numbers, and the hits it
meets under are added up, an upper limit of its ratio: most pairs share one misspelt
token and go no further.

Lists multiply only where more than ``PAGE`` names share whole sets of tokens; names with
the same tokens count as one there.  What is left is scored by the full expression.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.functions import similarity as S
from accountloom.functions.names import match_key, norm_name, tokens
from accountloom.operators.similar_sets import similar_pairs
from accountloom.session import compute_once, pin

PAGE = 32  # candidates that a posting list holds before it is split by further tokens


def token_sets(names: DataFrame, name: str, prefix: str) -> DataFrame:
    """Distinct names with their sorted distinctive tokens and strong tokens."""
    t = F.col("_tokens")
    # names are small and what is done with each is not, so they are dealt to all cores
    dealt = names.select(F.col(name).alias(prefix)).distinct().repartition(names.sparkSession.sparkContext.defaultParallelism)
    worded = compute_once(dealt, _tokens=tokens(F.col(prefix)))
    return compute_once(worded, **{f"{prefix}_d": F.array_sort(S.distinctive(t)), f"{prefix}_s": S.strong(t)}).filter(
        F.size(f"{prefix}_d") > 0).drop("_tokens")


# --- misspelt tokens ---------------------------------------------------------

def edits_allowed(length: int) -> int:
    """Edits that keep two tokens, the longer of this length, similar enough."""
    return int((1 - R.TYPO_SIMILARITY) * length + 1e-9)


_SHORTEST = next(n for n in range(5, 100) if edits_allowed(n))  # below it no different token is close enough
_TWO_EDITS = next(n for n in range(5, 100) if edits_allowed(n) > 1)


def _edits(length: Column) -> Column:
    return F.floor((1 - R.TYPO_SIMILARITY) * length + 1e-9).cast("int")


def _piece(number: Column, length: Column, edits: Column) -> tuple[Column, Column]:
    """Start (from 0) and end of a piece of a token cut into ``edits + 1`` pieces."""
    return (F.floor(number * length / (edits + 1)).cast("int"),
            F.floor((number + 1) * length / (edits + 1)).cast("int"))


def _pieces_of_longer(vocabulary: DataFrame, name: str) -> DataFrame:
    """Tokens cut into one more piece than edits are allowed: one piece must survive."""
    m = F.length(name)
    cut = vocabulary.filter(m >= _TWO_EDITS).select(
        name, m.alias("m"), _edits(m).alias("d"), F.explode(F.sequence(F.lit(0), _edits(m))).alias("i"))
    start, end = _piece(F.col("i"), F.col("m"), F.col("d"))
    return cut.select(name, "m", "i", F.substr(F.col(name), start + 1, end - start).alias("piece"))


def _pieces_of_shorter(vocabulary: DataFrame, name: str) -> DataFrame:
    """Substrings where a piece of a token of length m, at least as long, could have survived."""
    n = F.length(name)
    longest = (n / R.TYPO_SIMILARITY + 1).cast("int")
    lengths = vocabulary.filter(longest >= _TWO_EDITS).select(
        name, n.alias("n"), F.explode(F.sequence(F.greatest(n, F.lit(_TWO_EDITS)), longest)).alias("m"))
    cut = lengths.withColumn("d", _edits(F.col("m"))).filter(F.col("m") - F.col("n") <= F.col("d")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i")).select(
        "*", F.explode(F.sequence(-F.col("d"), F.col("d"))).alias("shift"))
    start, end = _piece(F.col("i"), F.col("m"), F.col("d"))
    at = start + 1 + F.col("shift")
    return cut.filter(at >= 1).select(
        name, "m", "i", F.substr(F.col(name), at, end - start).alias("piece")).distinct()


def _without_one(vocabulary: DataFrame, name: str) -> DataFrame:
    """Tokens of which one edit is allowed without each of their characters in turn."""
    m = F.length(name)
    cut = vocabulary.filter(m.between(_SHORTEST, _TWO_EDITS - 1)).select(
        name, m.alias("m"), F.explode(F.sequence(F.lit(1), m)).alias("i"))
    return cut.select(name, "m", "i", F.concat(F.substr(F.col(name), F.lit(1), F.col("i") - 1),
                                               F.substr(F.col(name), F.col("i") + 1)).alias("rest"))


def _one_edit_apart(a: DataFrame, b: DataFrame) -> DataFrame:
    """``x, y``: a letter is replaced (equal without it), or the longer one is the shorter without a letter."""
    x, y = _without_one(a, "x"), _without_one(b, "y")
    return (x.join(y, ["m", "i", "rest"]).select("x", "y")
            .unionByName(x.join(b, F.col("rest") == F.col("y")).select("x", "y"))
            .unionByName(y.join(a, F.col("rest") == F.col("x")).select("x", "y")))


def similar_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(token, near)``: different tokens of five letters or more that are close
    enough.  Both inputs are vocabularies with one column ``token``.

    Tokens of which one edit is allowed meet only if they are that edit apart, so dense
    numbers meet their few neighbours; longer tokens meet under a piece of four letters
    or more.
    """
    a = left.filter(F.length("token") >= 5).select(F.col("token").alias("x"))
    b = right.filter(F.length("token") >= 5).select(F.col("token").alias("y"))
    on = ["m", "i", "piece"]
    met = (_pieces_of_shorter(a, "x").join(_pieces_of_longer(b, "y"), on).select("x", "y")
           .unionByName(_pieces_of_longer(a, "x").join(_pieces_of_shorter(b, "y"), on).select("x", "y"))
           .unionByName(_one_edit_apart(a, b)))
    close = S.token_similarity(F.col("x"), F.col("y")) >= R.TYPO_SIMILARITY
    return (met.filter(F.col("x") != F.col("y")).distinct().filter(close)
            .select(F.col("x").alias("token"), F.col("y").alias("near")))


# --- candidates --------------------------------------------------------------

def _vocabulary(sets: DataFrame, column: str) -> DataFrame:
    return sets.select(F.explode(column).alias("token")).distinct()


def _first_of_each_set(candidates: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` candidates of every set of tokens; the rest can never be among the best."""
    order = Window.partitionBy("_set").orderBy("candidate")
    return (candidates.withColumn("_set", F.array_sort("candidate_d")).withColumn("_n", F.row_number().over(order))
            .filter(F.col("_n") <= keep).drop("_set", "_n"))


def _filed(rows: DataFrame) -> DataFrame:
    """Rows under each of their tokens: ``list`` is the token, ``rest`` the more frequent ones."""
    return rows.select("*", F.posexplode("toks").alias("_at", "list")).withColumn(
        "rest", F.expr("slice(toks, _at + 2, size(toks))")).drop("_at", "toks")


def _refiled(rows: DataFrame) -> DataFrame:
    """Rows under one more of their tokens each."""
    return rows.select("*", F.posexplode("rest").alias("_at", "_next")).withColumns({
        "list": F.concat_ws(" ", "list", "_next"), "rest": F.expr("slice(rest, _at + 2, size(rest))")}).drop("_at", "_next")


def _under_whole_lists(inputs: DataFrame, candidates: DataFrame, near: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs that meet under tokens that are not ``hot`` and whose hits may reach the least ratio.

    Names are hashed here.  Names of one hash count as one: that adds pairs and loses none.
    ``_hot`` are the tokens of an input that may hit hot ones, which are taken for exact hits.
    """
    a = inputs.withColumn("_a", F.xxhash64("input"))
    b = candidates.withColumn("_b", F.xxhash64("candidate"))
    own = a.select("_a", F.size("input_d").alias("_la"), "_hot", F.explode("input_d").alias("token"))
    held = b.select("_b", F.size("candidate_d").alias("_lb"), F.explode("candidate_d").alias("list")).join(hot, "list", "left_anti")
    same = own.withColumnRenamed("token", "list").join(hot, "list", "left_anti").withColumn("_hit", F.lit(1.0))
    misspelt = own.join(near.join(hot, "list", "left_anti"), "token").drop("token").withColumn("_hit", F.lit(S.MISSPELT))
    wanted = R.MATCH_RATIO * F.least("_la", "_lb") - F.col("_hot")
    met = same.unionByName(misspelt).join(held, "list").select("_a", "_b", "_hit", wanted.alias("_wanted"))
    # most pairs come once: they move first, as there is nothing to add up before
    enough = met.repartition("_a", "_b").groupBy("_a", "_b").agg(
        F.sum("_hit").alias("_hits"), F.min("_wanted").alias("_wanted")).filter(F.col("_hits") >= F.col("_wanted") - 1e-6)
    return enough.select("_a", "_b").join(a.drop("_hot"), "_a").join(b, "_b").drop("_a", "_b")


def _through_lists(inputs: DataFrame, candidates: DataFrame, near: DataFrame, keep: int, page: int) -> DataFrame:
    """Acceptable pairs that hold the ``keep`` best of every input, among others; a pair may come more than once."""
    held = candidates.select("candidate", F.explode("candidate_d").alias("list"))
    hot = pin(held.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > page), "overfull")
    near = near.withColumnRenamed("near", "list")
    rarest_first = F.transform(F.array_sort(F.collect_set(F.struct("n", "list"))), lambda r: r["list"]).alias("toks")
    # what an input finds under an overfull token: the token itself, or one it may be a misspelling of
    means = hot.withColumn("token", F.col("list")).unionByName(near.join(hot, "list"))
    reached = inputs.select("input", F.explode("input_d").alias("token")).join(means, "token").groupBy("input").agg(
        rarest_first, F.count_distinct("token").alias("_hot"))
    cores = inputs.sparkSession.sparkContext.defaultParallelism
    inputs = pin(inputs.join(reached, "input", "left").fillna(0, ["_hot"]).repartition(cores), "inputs")
    found = [_under_whole_lists(inputs.drop("toks"), candidates, near, hot)]
    if hot.isEmpty():
        return found[0]

    asking = pin(_filed(inputs.drop("_hot")), "asking")
    filed = _filed(held.join(hot, "list").groupBy("candidate").agg(rarest_first).join(candidates, "candidate"))
    while True:
        filed = pin(filed.join(asking.select("list").distinct(), "list", "left_semi"), "filed")
        long = pin(filed.groupBy("list").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > page).select("list"), "overfull")
        whole = filed.join(long, "list", "left_anti")
        overfull = filed.join(long, "list", "left_semi")
        order = Window.partitionBy("list", F.size("candidate_d")).orderBy("candidate")
        first = overfull.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")
        # all names may ask for one list: the lists are small, pinned they need not move the names
        lists = pin(whole.unionByName(first).drop("rest"), "lists")
        found.append(asking.drop("rest").join(lists, "list").drop("list"))
        if long.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        asking = pin(_refiled(asking.join(long, "list", "left_semi")), "asking")
        filed = _refiled(overfull)


def best_matches(inputs: DataFrame, name: str, candidates: DataFrame, candidate: str, *,
                 keep: int = 2, skip_same: bool = False, page: int = PAGE) -> DataFrame:
    """The ``keep`` best acceptable candidates per input name.

    Ties go to the candidate that sorts first.  ``skip_same`` leaves out the
    candidate that is the input itself.
    """
    want = keep + 1 if skip_same else keep
    a = pin(token_sets(inputs, name, "input"), "inputs")
    b = pin(_first_of_each_set(token_sets(candidates, candidate, "candidate"), want), "candidates")
    near = similar_tokens(_vocabulary(a, "input_d"), _vocabulary(b, "candidate_d"))
    pairs = _through_lists(a, b, pin(near, "near-tokens"), want, page)
    if skip_same:
        pairs = pairs.filter(F.col("input") != F.col("candidate"))
    scored = compute_once(pairs, m=S.distinctive_match(
        F.col("input_d"), F.col("candidate_d"), F.col("input_s"), F.col("candidate_s"))).withColumn(
        "score", S.candidate_score(F.col("m"), F.lit(0.0)))
    good = scored.filter(S.is_acceptable(F.col("m"), F.col("score")))
    # a pair that comes again has the same place
    w = Window.partitionBy("input").orderBy(F.desc("score"), "candidate")
    return (good.select("input", "candidate", "score", "m.ratio", "m.strong_shared", "m.shared")
            .withColumn("place", F.dense_rank().over(w)).filter(F.col("place") <= keep).dropDuplicates(["input", "place"]))


def resolve_fuzzy(inputs: DataFrame, name: str, candidates: DataFrame, candidate: str,
                  margin: float = R.AMBIGUITY_MARGIN) -> DataFrame:
    """Accept, ambiguous or none for every input; ambiguous rows show both candidates."""
    top = best_matches(inputs, name, candidates, candidate)
    both = top.groupBy(F.col("input").alias(name)).agg(*[
        F.max(F.when(F.col("place") == place, F.col(c))).alias(f"{label}{ending}")
        for place, label in ((1, "best"), (2, "runner_up")) for c, ending in (("candidate", ""), ("score", "_score"))])
    close = F.col("best_score") - F.col("runner_up_score") <= margin + 1e-9
    status = (F.when(F.col("best").isNull(), "none").when(close, "ambiguous").otherwise("accepted"))
    return inputs.select(name).distinct().join(both, name, "left").withColumn("status", status)


CLASS_BLOCK = 1024  # names of one class that meet those of another in one go


def similar_names(names: DataFrame, name: str, cut: float, every_pair: bool = False, block: int = CLASS_BLOCK) -> DataFrame:
    """The alias-similarity report: likely false splits, for a person to confirm.

    Every pair of names whose distinctive tokens have a Jaccard similarity of ``cut`` or
    more, a cut below that of a merge, with ``every_pair``.  Without it the report is short:
    names with the same tokens are one class, the first name of the class stands in the
    pairs, and every other one is linked to it (similarity 1).  ``score`` and ``acceptable``
    are those of the matcher.  Names without distinctive tokens are in no pair.
    """
    sets = token_sets(names, name, "input").select(F.col("input").alias("name"), F.col("input_d").alias("words"),
                                                   F.col("input_s").alias("strong"))
    heads_of = sets.groupBy("words").agg(F.min("name").alias("head"), F.count(F.lit(1)).alias("n"))
    classes = pin(sets.join(heads_of, "words"), "token-classes")
    heads = classes.filter("name = head").drop("head")
    pairs = similar_pairs(heads, "name", "words", cut).select(
        F.least("left", "right").alias("account"), F.greatest("left", "right").alias("other"), "similarity")
    if every_pair:
        return _pairs_of_members(classes, heads, pairs, block)
    members = classes.filter("name != head").select(F.col("head").alias("account"), F.col("name").alias("other"),
                                                    F.lit(1.0).alias("similarity"))
    scored = score_pairs(pairs.unionByName(members), "account", "other")
    return scored.select("account", "other", "similarity", "score", "acceptable")


def _pairs_of_members(classes: DataFrame, heads: DataFrame, pairs: DataFrame, block: int) -> DataFrame:
    """All names of paired classes, and all names of one class, against each other.

    All pairs between two classes have the score of these, which depends on the side that
    comes first and is taken for both.  Large classes meet in blocks, so no task holds one.
    """
    sides = [pairs.toDF("a", "b", "similarity"), pairs.toDF("b", "a", "similarity"),
             heads.filter("n > 1").select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("similarity"))]
    blocks = F.ceil(F.col("n") / block).cast("int")
    sized = heads.select("name", "words", "strong", blocks.alias("blocks"))
    both = functools.reduce(DataFrame.unionByName, sides).join(sized.toDF("a", "da", "sa", "na"), "a").join(
        sized.toDF("b", "db", "sb", "nb"), "b")
    scored = compute_once(both, m=S.distinctive_match(F.col("da"), F.col("db"), F.col("sa"), F.col("sb"))).withColumn(
        "score", S.candidate_score(F.col("m"), F.lit(0.0)))
    cells = scored.select("a", "b", "similarity", "score", S.is_acceptable(F.col("m"), F.col("score")).alias("acceptable"),
                          F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ia"), "nb").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("ib"))
    members = classes.select("head", "name", F.pmod(F.xxhash64("name"), blocks).cast("int").alias("block"))
    met = cells.join(members.toDF("a", "account", "ia"), ["a", "ia"]).join(members.toDF("b", "other", "ib"), ["b", "ib"])
    return met.filter("account < other").select("account", "other", "similarity", "score", "acceptable")


def resolve_three_pass(names: DataFrame, name: str, accounts: DataFrame, account: str) -> DataFrame:
    """Known key, then fuzzy match, then a person.

    ``pass`` is ``exact``, ``fuzzy`` or ``queue``; a queued name shows its
    candidates when there are any.  Nothing is assigned on a close call.
    """
    known = accounts.groupBy(match_key(F.col(account)).alias("_key")).agg(F.min(account).alias("_exact"))
    keyed = pin(names.select(name).distinct().withColumn("_key", match_key(F.col(name))).join(
        known, "_key", "left"), "known")
    exact = keyed.filter("_exact is not null").select(
        name, F.lit("exact").alias("pass"), F.col("_exact").alias("account"),
        F.lit(None).cast("string").alias("candidates"))
    fuzzy = resolve_fuzzy(keyed.filter("_exact is null").select(name), name, accounts, account)
    accepted = F.col("status") == "accepted"
    rest = fuzzy.select(
        name, F.when(accepted, "fuzzy").otherwise("queue").alias("pass"),
        F.when(accepted, F.col("best")).alias("account"),
        F.when(~accepted & F.col("best").isNotNull(), F.concat_ws(" | ", "best", "runner_up")).alias("candidates"))
    return exact.unionByName(rest)


def score_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Every similarity measure of given pairs."""
    ta, tb = tokens(F.col(a)), tokens(F.col(b))
    loose = S.loose_similarity(F.col(a), F.col(b))
    scored = pairs.withColumns({
        "_m": S.distinctive_match(S.distinctive(ta), S.distinctive(tb), S.strong(ta), S.strong(tb)),
        "jaccard": S.jaccard(ta, tb), "whole_name": S.whole_name_similarity(F.col(a), F.col(b)),
        "loose": loose})
    scored = scored.withColumn("score", S.candidate_score(F.col("_m"), F.col("loose")))
    return scored.withColumn("acceptable", S.is_acceptable(F.col("_m"), F.col("score"))).select(
        *pairs.columns, "_m.ratio", "_m.strong_shared", "_m.shared", "jaccard", "whole_name", "loose",
        "score", "acceptable")


def suppress_customers(rows: DataFrame, name: str, customers: DataFrame, customer: str, fuzzy_cut: float,
                       block: int = 256) -> DataFrame:
    """Suppression against a table of customers, with the evidence on each row.

    ``suppressed`` needs the same key or an acceptable distinctive match; mere similarity
    is ``queued`` for a person.  Keys meet by equality and matches through posting lists.
    Only names that neither settles are compared as whole strings, for which no list
    exists at such low cuts: blocks of about ``block`` customers go to every share of the
    names.  Rows without a name are kept.
    """
    spark = rows.sparkSession
    names = pin(rows.select(F.col(name).alias("_name")).filter("_name is not null").distinct()
                .withColumn("_key", match_key(F.col("_name"))), "names")
    listed = pin(customers.select(F.col(customer).alias("_customer")).filter("_customer is not null").distinct(), "customers")
    keys = listed.select(match_key(F.col("_customer")).alias("_key")).distinct()
    exact = names.join(keys, "_key", "left_semi").select("_name", F.lit("suppressed_exact").alias("decision"))
    other = pin(names.join(keys, "_key", "left_anti").select("_name"), "names")
    near = best_matches(other, "_name", listed, "_customer", keep=1)
    distinct = pin(near.select(F.col("input").alias("_name"), F.lit("suppressed_distinctive").alias("decision")), "matched")

    blocks = listed.count() // block + 1
    shares = max(1, spark.sparkContext.defaultParallelism)
    listed_blocks = listed.select(
        F.pmod(F.xxhash64("_customer"), F.lit(blocks)).alias("_block"),
        F.struct(norm_name(F.col("_customer")).alias("norm"), tokens(F.col("_customer")).alias("toks")).alias("_c")).groupBy(
        "_block").agg(F.collect_list("_c").alias("_listed")).withColumn(
        "_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    still = other.join(distinct, "_name", "left_anti").select(
        "_name", norm_name(F.col("_name")).alias("_norm"), tokens(F.col("_name")).alias("_toks"),
        F.pmod(F.xxhash64("_name"), F.lit(shares)).cast("int").alias("_share"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"))
    alike = F.exists("_listed", lambda c: (S.jaccard(F.col("_toks"), c["toks"]) >= fuzzy_cut)
                     | (S.string_similarity(F.col("_norm"), c["norm"]) >= fuzzy_cut))
    queued = still.join(listed_blocks, ["_block", "_share"]).filter(alike).select(
        "_name", F.lit("queued_fuzzy").alias("decision")).distinct()
    decided = exact.unionByName(distinct).unionByName(queued)
    return (rows.join(decided, rows[name] == decided["_name"], "left").drop("_name")
            .withColumn("decision", F.coalesce("decision", F.lit("kept"))))


# --- reconciliation ----------------------------------------------------------

def reconcile(crm: DataFrame, crm_name: str, registry: DataFrame, registry_name: str) -> DataFrame:
    """Matched, CRM-only and registry-only companies by canonical key."""
    a = crm.select(match_key(F.col(crm_name)).alias("key"), F.col(crm_name).alias("crm_name")).groupBy(
        "key").agg(F.min("crm_name").alias("crm_name"), F.count(F.lit(1)).alias("crm_rows"))
    b = registry.select(match_key(F.col(registry_name)).alias("key"),
                        F.col(registry_name).alias("registry_name")).groupBy("key").agg(
        F.min("registry_name").alias("registry_name"), F.count(F.lit(1)).alias("registry_rows"))
    status = (F.when(F.col("registry_name").isNull(), "crm_only")
              .when(F.col("crm_name").isNull(), "registry_only").otherwise("matched"))
    return a.join(b, "key", "full_outer").withColumn("status", status)


def reconcile_people(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two feeds of one person field: corroborated, conflict with both values, or one-sided."""
    a = left.select(*keys, F.col(value).alias("left_value"))
    b = right.select(*keys, F.col(value).alias("right_value"))
    l, r = F.col("left_value"), F.col("right_value")
    outcome = (F.when(l.isNull(), "right_only").when(r.isNull(), "left_only")
               .when(F.lower(F.trim(l)) == F.lower(F.trim(r)), "corroborated").otherwise("conflict"))
    return a.join(b, list(keys), "full_outer").withColumn("outcome", outcome)
