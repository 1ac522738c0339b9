"""Rules over research tables: signals, pains, people, deliverables, facts, costs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.functions.names import tokens
from accountloom.operators.gates import numbered_within
from accountloom.operators.similar_sets import connected_components, similar_pairs
from accountloom.session import pin


def _day(d: str) -> Column:
    return F.lit(d).cast("date")


# --- signals -----------------------------------------------------------------

def dedup_signals(signals: DataFrame, keys: Sequence[str], title: str, first: Sequence[str], cut: float) -> DataFrame:
    """One signal per event reported: equal keys and similar titles, over any number of steps.

    Titles are similar when their words, in any order, case and punctuation, have a
    Jaccard similarity of ``cut`` or more.  ``first`` names a signal and orders them: the
    first one survives with its title's words and counts the reports.  Equal titles meet
    by equality, so only different ones are compared.  Titles without words, and signals
    with a null key, are the same only as signals equal in all of these.
    """
    words = F.array_sort(tokens(F.col(title)))
    same = pin(signals.withColumn("_words", words).groupBy(*keys, "_words").agg(
        F.min(F.struct(*first)).alias("_f"), F.count(F.lit(1)).alias("reports")), "titles")
    links = similar_pairs(same, "_f", "_words", cut, keys)
    groups = connected_components(links, "left", "right")
    joined = same.join(groups, same["_f"] == groups["node"], "left")
    kept = F.coalesce("component", "_f")
    total = joined.groupBy(kept.alias("_kept")).agg(F.sum("reports").alias("_reports"), F.count(F.lit(1)).alias("titles"))
    return same.drop("reports").join(total, F.col("_f") == F.col("_kept")).select(
        *keys, F.array_join("_words", " ").alias("title_words"), "_f.*", F.col("_reports").alias("reports"), "titles")


def impact(signals: DataFrame, at: str, materiality: Column, proximity: Column, as_of: str, *,
           weights: tuple[float, float, float], window_days: int) -> DataFrame:
    """Recency, materiality and proximity, weighted; all three lie between 0 and 1."""
    age = F.date_diff(_day(as_of), F.col(at).cast("date"))
    recency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / window_days))
    score = F.round(weights[0] * recency + weights[1] * materiality + weights[2] * proximity, 6)
    level = (F.when(F.col("impact_score") >= 0.8, "critical").when(F.col("impact_score") >= 0.6, "high")
             .when(F.col("impact_score") >= 0.4, "medium").when(F.col("impact_score") >= 0.2, "low")
             .otherwise("context"))
    return signals.withColumn("impact_score", score).withColumn("impact", level)


def surfaced(signals: DataFrame) -> DataFrame:
    """A signal that does not say why it matters is kept but not shown."""
    return signals.filter(F.coalesce(F.trim("why_it_matters"), F.lit("")) != "")


def pain_severity(pains: DataFrame, links: DataFrame, key: str, account_token: str) -> DataFrame:
    """Severity follows evidence: uncited at most 2, five needs two facts, generic text is refused."""
    cited = links.groupBy(key).agg(F.count(F.lit(1)).alias("n_facts"))
    joined = pains.join(cited, key, "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    top = F.when(F.col("n_facts") == 0, 2).when(F.col("n_facts") < 2, 4).otherwise(5)
    return joined.withColumns({
        "final_severity": F.least(F.col("severity"), top).cast("int"),
        "rejected": ~F.coalesce(F.col("evidence").rlike(account_token), F.lit(False))})


def shared_patterns(events: DataFrame, group: Sequence[str], at: str, account: str, least: int) -> DataFrame:
    """Grid region, class and quarter that at least ``least`` accounts share."""
    quarter = F.date_trunc("quarter", F.col(at)).cast("date")
    return events.withColumn("quarter", quarter).groupBy(*group, "quarter").agg(
        F.count_distinct(account).alias("accounts"), F.count(F.lit(1)).alias("signals")
    ).filter(F.col("accounts") >= least)


# --- people ------------------------------------------------------------------

def title_decay(people: DataFrame, at: str, as_of: str, days: int = R.TITLE_EXPIRY_DAYS) -> DataFrame:
    """A title older than its window loses one confidence level."""
    old = F.coalesce(F.date_diff(_day(as_of), F.col(at).cast("date")) > days, F.lit(True))
    return people.withColumns({"title_stale": old, "confidence": F.when(
        old, F.greatest(F.col("confidence") - 1, F.lit(1))).otherwise(F.col("confidence"))})


def third_states(people: DataFrame) -> DataFrame:
    """People who are neither resolved nor an explained gap."""
    named = F.coalesce(F.trim("name"), F.lit("")) != ""
    gap = F.coalesce("is_gap", F.lit(False))
    explained = F.coalesce(F.trim("gap_reason"), F.lit("")) != ""
    return people.filter(~((named & ~gap) | (gap & explained)))


def gap_rate(people: DataFrame, role: str) -> DataFrame:
    return people.groupBy(role).agg(
        F.count(F.lit(1)).alias("people"), F.round(F.avg(F.col("is_gap").cast("int")), 6).alias("gap_rate"))


def person_evidence(people: DataFrame, sources: DataFrame) -> DataFrame:
    """Confidence 2 or more needs a source text that contains the name; else it falls to 1."""
    joined = people.join(sources.select("source_id", "raw"), "source_id", "left")
    seen = F.coalesce(F.contains(F.lower("raw"), F.lower("name")), F.lit(False))
    return joined.withColumn("evidenced", seen).withColumn("confidence", F.when(
        (F.col("confidence") >= 2) & ~seen, 1).otherwise(F.col("confidence"))).drop("raw")


# --- facts and deliverables --------------------------------------------------

def confidence_profile(facts: DataFrame, account: str, at: str, as_of: str, stale_days: int) -> DataFrame:
    old = F.date_diff(_day(as_of), F.col(at).cast("date")) > stale_days
    return facts.groupBy(account).agg(
        F.count_if(F.col("confidence") == 3).alias("high"), F.count_if(F.col("confidence") == 2).alias("medium"),
        F.count_if(F.col("confidence") == 1).alias("gap"), F.count_if(old).alias("stale"))


def apply_corrections(facts: DataFrame, corrections: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A ``wrong`` correction drops its fact to confidence 1 and queues it."""
    wrong = corrections.filter("kind = 'wrong'").select(key).distinct()
    hit = wrong.withColumn("_wrong", F.lit(True))
    joined = facts.join(hit, key, "left").withColumn("confidence", F.when(
        F.coalesce("_wrong", F.lit(False)), 1).otherwise(F.col("confidence")))
    queue = joined.filter("_wrong").select(
        key, F.lit("G9").alias("gate"), F.lit("marked wrong: re-verify").alias("reason"))
    return joined.drop("_wrong"), queue


def blocked_deliverables(facts: DataFrame, deliverable: str, field_class: str,
                         floors: Mapping[str, int]) -> DataFrame:
    """Deliverables whose weakest fact of some class is under that class's floor."""
    floor = F.coalesce(*[F.when(F.col(field_class) == c, F.lit(n)) for c, n in floors.items()])
    weakest = facts.groupBy(deliverable, field_class).agg(F.min("confidence").alias("weakest"))
    reason = F.concat(F.col(field_class), F.lit(" at "), F.col("weakest").cast("string"), F.lit(", needs "),
                      floor.cast("string"))
    return weakest.filter(F.col("weakest") < floor).groupBy(deliverable).agg(
        F.array_join(F.array_sort(F.collect_set(reason)), "; ").alias("blocked_reason"))


def publishable(accounts: DataFrame, gaps: DataFrame, account: str) -> DataFrame:
    """An open blocking gap blocks publication."""
    open_gaps = gaps.filter("is_blocking").select(account).distinct().withColumn("_b", F.lit(True))
    return accounts.join(open_gaps, account, "left").withColumn(
        "can_publish", F.col("_b").isNull()).drop("_b")


def stale_artefacts(changed: DataFrame, links: DataFrame, fact: str, deliverable: str) -> DataFrame:
    """Deliverables that use a changed fact, with how many."""
    return links.select(fact, deliverable).distinct().join(
        changed.select(fact), fact, "left_semi").groupBy(deliverable).agg(
        F.count(F.lit(1)).alias("changed_facts"))


STATED_NUMBER = r"(?:^|[^0-9A-Za-z_.+-])([+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?)"


def plain_number(text: Column) -> Column:
    """One spelling per value: no separators, no plus sign, no trailing zeros."""
    bare = F.regexp_replace(text, r"^\+|,", "")
    exact = bare.try_cast("decimal(38,8)").cast("string")
    return F.coalesce(F.regexp_replace(exact, r"\.?0+$", ""), bare)


def ground_claims(claims: DataFrame, sources: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """Claims with their outcome: kept, missing source, or a source of another tenant."""
    known = sources.select("source_id", F.col(tenant).alias("_t"))
    joined = claims.join(known, "source_id", "left")
    return joined.withColumn("outcome", F.when(F.col("_t").isNull(), "missing_source").when(
        F.col("_t") != F.col(tenant), "foreign_source").otherwise("kept")).drop("_t")


def unverified_numbers(texts: DataFrame, key: str, text: str, facts: DataFrame, value: str) -> DataFrame:
    """Numbers a text states that no fact holds, once per text and value.

    Thousands separators, decimals and signs belong to a number; ``2,724,270`` is one
    and equals ``2724270.0``.  Digits inside a word are no number.
    """
    said = texts.select(key, F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.col(text), F.lit(STATED_NUMBER), 1), plain_number))).alias("number"))
    held = facts.select(plain_number(F.col(value)).alias("number")).distinct()
    return said.join(held, "number", "left_anti")


def version_chain(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Each version beside the one before it.  The neighbour is found by an equi-join
    on (keys, version), so a long chain is spread over the cluster."""
    numbered = pin(numbered_within(rows, keys, order, "version"), "versions")
    before = numbered.select(*keys, (F.col("version") + 1).alias("version"),
                             *[F.col(f).alias(f"previous_{f}") for f in fields])
    return numbered.join(before, [*keys, "version"], "left").withColumn(
        "changed", F.array_join(F.array_compact(F.array(*[
            F.when((F.col("version") > 1) & ~F.col(f).eqNullSafe(F.col(f"previous_{f}")), F.lit(f))
            for f in fields])), ","))


# --- accounts ----------------------------------------------------------------

def staleness(accounts: DataFrame, at: str, as_of: str, days: int = 90) -> DataFrame:
    age = F.date_diff(_day(as_of), F.col(at).cast("date"))
    return accounts.withColumns({"age_days": age, "refresh_in": F.greatest(F.lit(0), days - age),
                                 "is_stale": F.coalesce(age > days, F.lit(True))})


def orphan_alerts(orphans: DataFrame, signals: DataFrame, account: str) -> DataFrame:
    """Owner-less accounts that have a critical signal."""
    critical = signals.filter("impact = 'critical'").select(account)
    return orphans.join(critical, account, "left_semi")


def facets(accounts: DataFrame, where: Column, score: str, bands: int = 5) -> DataFrame:
    """Matching accounts counted by grid region, vertical and score band."""
    band = F.width_bucket(F.col(score).cast("double"), F.lit(0.0), F.lit(100.0), F.lit(bands))
    return accounts.filter(where).withColumn("band", band.cast("int")).groupBy(
        "primary_rto", "vertical", "band").agg(F.count(F.lit(1)).alias("accounts"))


def whitespace(accounts: DataFrame, crm_keys: DataFrame, key: str, accessibility: Column,
               grid: Column) -> DataFrame:
    """Accounts absent from the sales list, by fit x accessibility x grid x accidents."""
    value = (F.col("icp_score") / 100) * accessibility * grid * (
        1 + F.col("sites_with_accidents") / F.col("sites"))
    return accounts.join(crm_keys, key, "left_anti").withColumn("whitespace_score", F.round(value, 6))


def portfolio(sites: DataFrame, cycles: int = 2) -> DataFrame:
    """Totals per account and grid region, per account, and overall, with signal and notes.

    ``cadence`` is the number of submissions per site that submits, and
    ``replacement_sites`` counts those with an accident on file and at least ``cycles``
    submissions: the proxy for aging equipment.  ``notes`` says what the figures rest on:
    sites held below validation, whose charge is not in the total, and sites without any
    submission; null where there is nothing to say.
    """
    held, filed = F.count_if(~F.col("validated")), F.count_if(F.col("submissions") > 0)
    silent = F.count_if(F.coalesce(F.col("submissions"), F.lit(0)) <= 0)
    totals = sites.rollup("account", "rto").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("sites"),
        F.sum(F.when(F.col("validated"), F.col("charge_lb")).otherwise(0)).alias("charge_lb"),
        F.sum("accidents").alias("accidents"), held.alias("held_sites"),
        F.coalesce(F.sum("submissions"), F.lit(0)).cast("long").alias("submissions"),
        filed.alias("_filed"), silent.alias("_silent"),
        F.count_if((F.col("accidents") > 0) & (F.col("submissions") >= cycles)).alias("replacement_sites"))

    def note(n: str, text: str) -> Column:
        return F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" sites {text}")))

    notes = F.concat_ws("; ", note("held_sites", "held below validation"), note("_silent", "without a submission"))
    return totals.withColumns({
        "cadence": F.when(F.col("_filed") > 0, F.round(F.col("submissions") / F.col("_filed"), 6)),
        "notes": F.nullif(notes, F.lit(""))}).drop("_filed", "_silent")


def cost_rollup(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact decimal cost and tokens per group."""
    return events.groupBy(*by).agg(
        F.sum(F.col("units") * F.col("unit_cost")).alias("cost"), F.sum("units").alias("units"),
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))


def connector_health(pulls: DataFrame, connector: str, at: str) -> DataFrame:
    return pulls.groupBy(connector).agg(
        F.max(F.when(~F.col("failed"), F.col(at))).alias("last_success"),
        F.count_if(~F.col("failed")).alias("rows"), F.count_if("failed").alias("failures"))
