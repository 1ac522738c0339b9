"""Ingestion gates: should this be believed, and what may be done with it?

A gate never drops a row.  It appends an entry to the row's ``gates`` array;
``queue_rows`` turns everything that did not pass into review-queue rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom import refdata as R
from accountloom.operators.ordering import running_total
from accountloom.session import compute_once

_ENTRY = "array<struct<gate:string,status:string,severity:string,reason:string>>"


def gate(df: DataFrame, name: str, *, refuse: Column | None = None, warn: Column | None = None,
         reason: Column | str = "", severity: str = "waiting") -> DataFrame:
    """Append one verdict: refused, warned or passed."""
    refused = F.coalesce(refuse, F.lit(False)) if refuse is not None else F.lit(False)
    warned = F.coalesce(warn, F.lit(False)) if warn is not None else F.lit(False)
    status = F.when(refused, "refuse").when(warned, "warn").otherwise("pass")
    why = F.lit(reason) if isinstance(reason, str) else reason
    entry = F.struct(F.lit(name).alias("gate"), status.alias("status"), F.lit(severity).alias("severity"),
                     F.when(refused | warned, why).alias("reason"))
    before = F.col("gates") if "gates" in df.columns else F.array().cast(_ENTRY)
    return df.withColumn("gates", F.concat(before, F.array(entry)))


def queue_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row per verdict that is not a pass."""
    verdicts = compute_once(df.select(*keep, "gates"), gates=F.col("gates"))
    return verdicts.select(*keep, F.inline(F.filter("gates", lambda g: g["status"] != "pass")))


def passed(df: DataFrame) -> DataFrame:
    """Rows that no gate refused."""
    return compute_once(df, gates=F.col("gates")).filter(
        ~F.exists("gates", lambda g: g["status"] == "refuse"))


def provenance(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """A record without provenance is refused."""
    missing = F.array_compact(F.array(*[
        F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in required]))
    return gate(df, "G0", refuse=F.size(missing) > 0, severity="blocking",
                reason=F.concat(F.lit("no provenance: "), F.array_join(missing, ", ")))


def licence(df: DataFrame, source: str, licences: DataFrame) -> DataFrame:
    """The licence table ``(source, permitted)`` must allow the source."""
    known = df.join(licences.withColumnRenamed("source", source), source, "left")
    return gate(known, "G1", refuse=~F.coalesce("permitted", F.lit(False)), severity="blocking",
                reason=F.concat(F.lit("not permitted: "), F.coalesce(source, F.lit("?")))).drop("permitted")


def quarantine(df: DataFrame, field: str, patterns: Mapping[str, str], name: str = "G2") -> DataFrame:
    """Null a field that holds sensitive data and keep the record.

    The queue row names the kind of data and never repeats the value.
    """
    kinds = F.array_compact(F.array(*[
        F.when(F.col(field).rlike(p), F.lit(k)) for k, p in patterns.items()]))
    tagged = compute_once(df, _kinds=F.coalesce(kinds, F.array().cast("array<string>")))
    held = F.size("_kinds") > 0
    out = gate(tagged, name, warn=held, severity="blocking", reason=F.concat(
        F.lit(f"{field} quarantined: "), F.array_join("_kinds", ", ")))
    return out.withColumn(field, F.when(~held, F.col(field))).drop("_kinds")


def reject_rows(df: DataFrame, order: Sequence[Column], checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``(valid rows, rejects with their row number and first reason)``."""
    numbered = running_total(df, order, F.lit(1), "row_number")
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in checks.items()])
    judged = numbered.withColumn("reason", reason)
    return (judged.filter("reason is null").drop("reason", "row_number"),
            judged.filter("reason is not null"))


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1..n per key in ``order`` and ``<name>s``, the n; the sort is spread over the
    whole table, so one key may hold most of the rows."""
    at = running_total(df, [F.col(c) for c in (*keys, *order)], F.lit(1), "_at")
    span = at.groupBy(*keys).agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias(f"{name}s"))
    return at.join(span, list(keys)).withColumn(name, F.col("_at") - F.col("_start") + 1).drop("_at", "_start")


def version_records(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Repeats of a key become versions; the newest is current."""
    return numbered_within(df, keys, order, "version").withColumn(
        "is_current", F.col("version") == F.col("versions"))


def conflicts(facts: DataFrame, subject: Sequence[str], value: str, at: str) -> DataFrame:
    """Subjects with more than one value, both ends shown, none chosen."""
    per_value = facts.groupBy(*subject, value).agg(F.max(at).alias("_at"), F.count(F.lit(1)).alias("_n"))
    return per_value.groupBy(*subject).agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("_n").alias("records"),
        F.min_by(value, F.struct("_at", value)).alias("oldest_value"),
        F.max_by(value, F.struct("_at", value)).alias("newest_value")).filter("distinct_values > 1")


def source_confidence(kind: Column) -> Column:
    """What a source kind can earn; the lowest level for anything unknown."""
    levels = F.create_map(*[F.lit(x) for item in R.SOURCE_CONFIDENCE.items() for x in item])
    return F.coalesce(F.try_element_at(levels, F.coalesce(kind, F.lit(""))), F.lit(1))


def promote(facts: DataFrame, claim: Sequence[str], source: str) -> DataFrame:
    """Level 2 becomes 3 when an independent level-3 source makes the same claim.

    Per claim it is enough to know whether level-3 sources exist, and which one
    if there is only one; the claim table is aggregated before it is joined.
    """
    strong = facts.filter("confidence = 3").groupBy(*claim).agg(
        F.min(source).alias("_first"), F.max(source).alias("_last"))
    joined = facts.join(strong, list(claim), "left")
    independent = (F.col("_first") != F.col(source)) | (F.col("_last") != F.col(source))
    lifted = (F.col("confidence") == 2) & F.coalesce(independent, F.lit(False))
    return joined.withColumn("corroborated", lifted).withColumn(
        "confidence", F.when(lifted, 3).otherwise(F.col("confidence"))).drop("_first", "_last")


def expire(df: DataFrame, at: str, days: int, as_of: str) -> DataFrame:
    """Past its window a record falls to confidence 1."""
    age = F.date_diff(F.lit(as_of).cast("date"), F.col(at).cast("date"))
    old = F.coalesce(age > days, F.lit(True))
    return df.withColumns({"age_days": age, "expired": old,
                           "confidence": F.when(old, 1).otherwise(F.col("confidence"))})


def cap(confidence: Column, ceiling: int) -> Column:
    """Nothing a person or an internal document says goes above the ceiling."""
    return F.least(confidence, F.lit(ceiling))


def cap_without_url(confidence: Column, url: Column, ceiling: int = 2) -> Column:
    """L4: accepted without a URL, but only at confidence 1."""
    missing = F.coalesce(F.trim(url), F.lit("")) == ""
    return F.when(missing, F.least(confidence, F.lit(1))).otherwise(cap(confidence, ceiling))


def pending_review(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(usable for generation, held for a person)``."""
    held = F.exists("gates", lambda g: g["status"] != "pass")
    tagged = compute_once(df, status=F.when(held, "pending_review").otherwise("accepted"))
    return tagged.filter("status = 'accepted'"), tagged.filter("status = 'pending_review'")


def stale_crm(df: DataFrame, last_activity: str, as_of: str, months: int = R.STALE_MONTHS) -> DataFrame:
    """Flag accounts untouched for a year."""
    return df.withColumn("stale", F.coalesce(
        F.col(last_activity).cast("date") <= F.add_months(F.lit(as_of).cast("date"), -months), F.lit(True)))


def export_split(df: DataFrame, bases: Sequence[str] = R.EXPORT_BASES) -> tuple[DataFrame, DataFrame]:
    """``(eligible, held)``; held rows keep a reason and none is dropped."""
    ok = F.coalesce(F.col("qualification_basis").isin(*bases), F.lit(False))
    tagged = df.withColumns({"eligible": ok, "held_reason": F.when(
        ~ok, F.lit("judged, pending confirmation"))})
    return tagged.filter("eligible"), tagged.filter("not eligible")


# --- documents ---------------------------------------------------------------

def _spaced(text: Column) -> Column:
    """Lower-cased ASCII words, each with a space of its own on both sides."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", "  "), F.lit(" "))


def marker_count(spaced: Column, markers: Sequence[str]) -> Column:
    """Whole-word occurrences of any marker in a text prepared by ``_spaced``."""
    total = F.lit(0)
    for m in markers:
        needle = " " + "  ".join(w for w in "".join(
            ch if ch.isalnum() else " " for ch in m.lower()).split()) + " "
        gone = F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(needle), F.lit("")))
        total = total + (gone / len(needle)).cast("long")
    return total


def classify_documents(df: DataFrame, text: str, research: Sequence[str], activity: Sequence[str],
                       margin: float) -> DataFrame:
    """R2: prior research, activity record, mixed inside the margin, or unclassifiable.

    ``margin`` is the share of all markers by which one side must lead; a tie
    goes to a person.
    """
    a, b = F.col("research_score"), F.col("activity_score")
    lead = F.abs(a - b) / F.nullif(a + b, F.lit(0))
    kind = (F.when(a + b == 0, "unclassifiable").when(lead <= margin, "mixed")
            .when(a > b, "prior_research").otherwise("activity_record"))
    prepared = compute_once(df, _spaced=_spaced(F.col(text)))
    scored = compute_once(prepared, research_score=marker_count(F.col("_spaced"), research),
                          activity_score=marker_count(F.col("_spaced"), activity)).drop("_spaced")
    return scored.withColumns({
        "document_class": kind, "class_confidence": F.round(F.coalesce(lead, F.lit(0.0)), 6)})


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Paragraphs of a document for section-level classification."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("section", text)).filter(
        F.col(text).rlike(r"\S"))


def document_currency(df: DataFrame, dated: str, as_of: str, months: int = R.STALE_MONTHS) -> DataFrame:
    """Undated supports no current claim; old research is cited "as of"."""
    day = F.col(dated).cast("date")
    old = day < F.add_months(F.lit(as_of).cast("date"), -months)
    return df.withColumns({
        "currency": F.when(day.isNull(), "date unknown").when(old, "historical").otherwise("current"),
        "supports_current_claim": F.coalesce(~old, F.lit(False)),
        "cite": F.when(old, F.concat(F.lit("as of "), F.date_format(day, "yyyy-MM-dd")))})


def attribute(df: DataFrame, author: str) -> DataFrame:
    """Activity without an author is kept under ``unknown author`` and flagged."""
    blank = F.coalesce(F.trim(author), F.lit("")) == ""
    return df.withColumns({author: F.when(blank, "unknown author").otherwise(F.col(author)),
                           "unattributed": blank})


def already_tried(plays: DataFrame, failures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Annotate a recommended play that was made and failed before."""
    tried = failures.groupBy(*keys).agg(F.count(F.lit(1)).alias("failed_attempts"))
    return plays.join(tried, list(keys), "left").withColumns({
        "failed_attempts": F.coalesce("failed_attempts", F.lit(0)),
        "suppress": F.col("failed_attempts").isNotNull()})


def link_outcomes(activity: DataFrame, outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the outcome an activity resolved to, if any."""
    return activity.join(outcomes, list(keys), "left")


# --- captures ----------------------------------------------------------------

def bulk_paste(df: DataFrame, text: str, most: int, block: str = "\n") -> DataFrame:
    """L1: a capture is one record; more blocks than ``most`` is refused."""
    blocks = F.size(F.filter(F.split(text, block), lambda b: b.rlike(r"\S")))
    return gate(df.withColumn("blocks", blocks), "L1", refuse=F.col("blocks") > most, severity="blocking",
                reason=F.concat(F.lit("manual capture only: "), F.col("blocks").cast("string"),
                                F.lit(" records pasted")))


def stamp_capture(df: DataFrame, captured_by: str, captured_at: str,
                  expiry_days: int = R.CAPTURE_EXPIRY_DAYS) -> DataFrame:
    """L2 / L3: attribution comes from the job; an input column of that name is ignored."""
    bare = df.drop("captured_by", "captured_at", "expires_at")
    at = F.lit(captured_at).cast("timestamp_ntz")
    return bare.withColumns({
        "captured_by": F.lit(captured_by), "captured_at": at,
        "expires_at": F.date_add(at.cast("date"), expiry_days)})


def extract_fields(text: Column, fields: Mapping[str, tuple[str, str, str]]) -> Column:
    """``map(field -> (value, quality, origin))`` from ``(pattern, quality, origin)``.

    A field the pattern does not find is absent.
    """
    found = [F.when(text.rlike(p), F.struct(
        F.lit(name).alias("key"),
        F.struct(F.regexp_extract(text, p, 1).alias("value"), F.lit(quality).alias("quality"),
                 F.lit(origin).alias("origin")).alias("value")))
        for name, (p, quality, origin) in fields.items()]
    return F.map_from_entries(F.array_compact(F.array(*found)))


def resolution_path(confidence: Column, kind: Column) -> Column:
    """The next step that would lift a level-2 record."""
    return F.when(confidence == 2, F.when(kind == "capture", "match against a verified feed record")
                  .otherwise("confirm against the company leadership page"))


# --- feeds -------------------------------------------------------------------

def plain(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


def map_fields(columns: Sequence[str], synonyms: Mapping[str, Sequence[str]],
               required: Sequence[str]) -> tuple[dict[str, str], list[str], list[str]]:
    """``(field -> column, unmapped columns, required fields still missing)``."""
    names = {plain(c): c for c in columns}
    mapped = {}
    for field, other in synonyms.items():
        hit = next((names[plain(n)] for n in (field, *other) if plain(n) in names), None)
        if hit:
            mapped[field] = hit
    offered = [c for c in columns if c not in mapped.values()]
    return mapped, offered, [f for f in required if f not in mapped]


def feed_specification(df: DataFrame, spec: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """SPEC: per field its class, the column that satisfies it, how full it is, and a verdict.

    ``spec`` maps a field to its class and accepted names.  A refused class
    stays refused whatever the feed supplies.
    """
    mapped, _, _ = map_fields(df.columns, {f: names for f, (_, names) in spec.items()}, [])
    filled = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count(F.col(c)).alias(f"_{f}") for f, c in mapped.items()])
    entries = []
    for f, (kind, _) in spec.items():
        have = F.col(f"_{f}") if f in mapped else F.lit(0).cast("long")
        verdict = (F.lit("refused") if kind == "refused" else
                   F.when(have > 0, "ok").otherwise(
                       {"critical": "blocked", "required": "rows rejected", "pii": "absent",
                        "request": "prompt", "optional": "absent"}[kind]))
        entries.append(F.struct(
            F.lit(f).alias("field"), F.lit(kind).alias("class"),
            F.lit(mapped.get(f)).cast("string").alias("column"), have.alias("filled"),
            F.col("_rows").alias("rows"), verdict.alias("verdict")))
    return filled.select(F.inline(F.array(*entries)))


def sample_audit(df: DataFrame, key: str, stratum: str, correct: Column, share: float) -> DataFrame:
    """S3: observed accuracy on a repeatable sample of exact size per stratum, with its margin.

    Of a stratum of N records the ``ceil(share * N)`` with the least hash of their key are
    audited, at any partitioning and in every rerun.  ``margin`` is half the width of the
    95 % interval of the accuracy, with the correction for a sample without replacement.
    """
    rows = df.select(F.col(stratum), F.md5(F.col(key).cast("string")).alias("_priority"), F.col(key).alias("_key"),
                     correct.cast("double").alias("_correct"))
    numbered = numbered_within(rows, [stratum], ["_priority", "_key"], "_nth")
    audited = numbered.filter(F.col("_nth") <= F.ceil(F.lit(share) * F.col("_nths") - 1e-9)).groupBy(stratum).agg(
        F.count(F.lit(1)).alias("audited"), F.max("_nths").alias("population"), F.avg("_correct").alias("_a"))
    left = (F.col("population") - F.col("audited")) / F.greatest(F.col("population") - 1, F.lit(1))
    return audited.select(stratum, "audited", "population", F.round("_a", 6).alias("accuracy"),
                          F.round(1.96 * F.sqrt(F.col("_a") * (1 - F.col("_a")) / F.col("audited") * left), 6).alias("margin"))


def delimiter(text: Column) -> Column:
    """The most frequent of , ; tab | on the first line that is not blank."""
    line = F.regexp_extract(text, r"(?:^|\n)([^\n]*\S[^\n]*)", 1)
    marks = [",", ";", "\t", "|"]
    counts = [F.length(line) - F.length(F.replace(line, F.lit(m), F.lit(""))) for m in marks]
    most = F.greatest(*counts)
    return F.coalesce(*[F.when((n == most) & (n > 0), F.lit(m)) for m, n in zip(marks, counts)], F.lit(","))
