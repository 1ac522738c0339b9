"""Benchmark decontamination through templates, in built-in expressions only.

A text becomes a list of lower-case words in which numbers, names (capitalised words
inside a sentence) and units behind a number are typed placeholders.  Windows of such
templates are hashed and joined with those of the benchmark.  A matched window counts
if its slots are consistent: equal benchmark values stand for equal document values
and different ones for different ones, so a re-parameterised question is caught and a
chance match of placeholders is not.

Defined results: null and empty texts match nothing; benchmark items with fewer than
``min_words`` words are never matched, an item of numbers or names only as it stands, items shorter than a window are matched as a
whole; rows that repeat an id are judged by their own text, and the removal works on
(id, text), so equal rows go or stay together; empty tables give empty results; extra
columns are kept by ``decontaminate`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom.llm.frames import fresh

NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"

# FIXED VALUES: units that follow a number
UNITS = ("mm", "cm", "m", "km", "g", "kg", "mg", "t", "lb", "lbs", "oz", "l", "ml", "s", "sec", "min",
         "h", "hr", "hrs", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days",
         "week", "weeks", "month", "months", "year", "years", "mph", "kmh", "km/h", "mile", "miles",
         "meter", "meters", "metre", "metres", "foot", "feet", "inch", "inches", "dollar", "dollars",
         "euro", "euros", "cent", "cents", "percent", "usd", "eur", "gbp", "w", "kw", "kwh", "v", "a")

BROADCAST_WINDOWS = 500_000  # hashes and slots of so many benchmark windows fit in every task


def words_of(text: Column) -> Column:
    """Lower-case words; names and numbers carry a mark in front."""
    kept = r"\p{L}\p{M}\p{N}" + NAME + NUMBER
    named = F.regexp_replace(text, r"([\p{Ll}\p{N},;:]\s)(?=\p{Lu}\p{Ll})", f"$1{NAME}")
    numbered = F.regexp_replace(named, r"[0-9]+(?:[.,:/][0-9]+)*", f" {NUMBER}$0 ")
    words = F.when(text.rlike("[0-9]"), F.split(F.lower(numbered), (
        f"(?:[^{kept}.,:/]" + r"|(?<![0-9])[.,:/]|[.,:/](?![0-9]))+"))).otherwise(
        F.split(F.lower(named), f"[^{kept}]+"))
    return F.filter(words, lambda w: w != "")


def _typed(words: str, before: str, plain: str) -> str:
    """What each word counts as, given the word before it."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    return (f"zip_with({words}, {before}, (w, b) -> case when w is null then null "
            f"when startswith(w, '{NAME}') then {plain.format(w=f"'{NAME}'")} "
            f"when startswith(w, '{NUMBER}') then {plain.format(w=f"'{NUMBER}'")} "
            f"when startswith(b, '{NUMBER}') and w in ({units}) then {plain.format(w=f"'{UNIT}'")} "
            f"else {plain.format(w='w')} end)")


def _hashed(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """The words of every text and the hashes of its template."""
    words = df.select(*key, words_of(F.col(text)).alias("words"))
    return words.select(*key, "words", F.expr(
        _typed("words", "concat(array(''), slice(words, 1, greatest(size(words) - 1, 0)))", "xxhash64({w})")
    ).alias("hashes"))


def _windows(size: int) -> str:
    """Hashes of all windows of ``size`` words: pairs of shorter windows, by doubling.

    A window of any size is two overlapping windows of the largest power of two in it.
    """
    def pairs(array: str, apart: int) -> str:
        left = f"greatest(size(h) - {apart}, 0)"
        return (f"transform(array({array}), h -> zip_with(slice(h, 1, {left}), "
                f"slice(h, {apart + 1}, {left}), (a, b) -> xxhash64(a, b)))[0]")

    out, width = "hashes", 1
    while 2 * width <= size:
        out, width = pairs(out, width), 2 * width
    return pairs(out, size - width) if width < size else out


def _slots(size: int, at: str) -> str:
    """Values of the placeholders of the window at a place, in order."""
    inside = f"slice(words, {at} + 1, {size})"
    before = (f"if({at} = 0, concat(array(''), slice(words, 1, {size - 1})), slice(words, {at}, {size}))")
    shape = _typed(inside, before, "{w}")
    return (f"filter(zip_with({inside}, {shape}, (w, s) -> case when w <> s then w end), v -> v is not null)")


def _seen(df: DataFrame, size: int, *columns: str) -> DataFrame:
    """Every window of every text.  An outer explode: an inner one would add a filter
    that computes all windows a second time; a text without any gives one null row."""
    return df.select(*columns, F.posexplode_outer(F.expr(_windows(size))).alias("pos", "window"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 8, min_words: int = 4,
                 min_plain: float = 0.6, min_share: float = 0.25, min_run: int = 13) -> DataFrame:
    """``doc_id, text_hash, item_id, matched, windows, verbatim, slots_changed``.

    A document holds an item if at least ``min_share`` of the item's windows, or of those
    with enough plain words, occur in it, or ``min_run`` windows of the item in a row.
    Slots must be consistent; in windows in which less than ``min_plain`` of the words are
    plain they must be equal, since their templates say too little.
    """
    items = _hashed(benchmark.select("item_id", "text"), ["item_id"], "text").filter(
        F.size("words") >= min_words)
    short = [r["n"] for r in items.filter(F.size("words") < window)
             .select(F.size("words").alias("n")).distinct().collect()]  # fewer than ``window`` values
    sizes = sorted({window, *short})
    wanted = None
    for size in sizes:
        fits = F.size("words") >= window if size == window else F.size("words") == size
        part = (_seen(items.filter(fits), size, "item_id", "words")
                .select(F.lit(size).alias("size"), "window", "item_id", F.col("pos").alias("item_pos"),
                        F.expr(_slots(size, "pos")).alias("item_slots"))
                .withColumn("low", F.size("item_slots") > size * (1 - min_plain)))
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = wanted.persist()
    try:
        few = wanted.count() <= BROADCAST_WINDOWS
        totals = wanted.groupBy("item_id").agg(F.countDistinct("item_pos").alias("windows"),
                                                 F.sum((~F.col("low")).cast("long")).alias("plain_windows"))
        key = ["doc_id", "text_hash"]
        texts = _hashed(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), key, "text")
        hits = None
        for size in sizes:
            seen = _seen(texts, size, *key, "words")
            mine = wanted.filter(F.col("size") == size)
            slots = F.expr(_slots(size, "pos"))
            right = mine.withColumnRenamed("window", "wanted")
            if few:  # the texts' words are read only where a window matched
                fits = (F.col("window") == F.col("wanted")) & (~F.col("low") | (F.col("item_slots") == slots))
                part = seen.join(F.broadcast(right), fits).select(
                    *key, "item_id", "item_pos", "item_slots", "low", slots.alias("slots"))
            else:
                fits = (F.col("window") == F.col("wanted")) & (~F.col("low") | (F.col("item_slots") == F.col("slots")))
                part = seen.select(*key, "window", slots.alias("slots")).join(right, fits).select(
                    *key, "item_id", "item_pos", "item_slots", "low", "slots")
            hits = part if hits is None else hits.unionByName(part)
        consistent = ("size(array_distinct(arrays_zip(item_slots, slots))) = size(array_distinct(item_slots)) and "
                      "size(array_distinct(arrays_zip(item_slots, slots))) = size(array_distinct(slots))")
        changed = F.expr("size(filter(zip_with(item_slots, slots, (a, b) -> a <> b), d -> d))")
        places = (hits.filter(consistent).select(*key, "item_id", "item_pos", "low", changed.alias("changed"))
                  .groupBy(*key, "item_id", "item_pos", "low").agg(F.min("changed").alias("changed")))
        found = places.groupBy(*key, "item_id").agg(
            F.count(F.lit(1)).alias("matched"), F.max("changed").alias("slots_changed"),
            F.sum((~F.col("low")).cast("long")).alias("plain"),
            F.sort_array(F.collect_list("item_pos")).alias("places"))  # at most the windows of one item
        run = "if(p = s.last + 1, s.run + 1, 1)"
        longest = F.expr("aggregate(places, named_struct('last', -2, 'run', 0, 'best', 0), (s, p) -> named_struct("
                         f"'last', p, 'run', {run}, 'best', greatest(s.best, {run})), s -> s.best)")
        return (found.join(totals, "item_id")
                .filter((F.col("matched") >= F.col("windows") * min_share) | (longest >= min_run)
                        | ((F.col("plain") > 0) & (F.col("plain") >= F.col("plain_windows") * min_share)))
                .select(*key, "item_id", "matched", "windows", (F.col("slots_changed") == 0).alias("verbatim"),
                        "slots_changed"))
    finally:
        wanted.unpersist()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    found = contaminated(docs, benchmark, **settings)
    key, text = fresh(docs, "_key"), fresh(docs, "_text")
    bad = found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[key]) & (F.xxhash64(docs["text"]) == bad[text]), "left_anti")
