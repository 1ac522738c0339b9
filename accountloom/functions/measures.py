"""Charges, scores and site measures, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from accountloom import refdata as R


def lookup(c: Column, table: Mapping[str, str], default: str) -> Column:
    """Constant lookup without a join; the tables are fixed and tiny."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(c, F.lit(""))),
                      F.lit(default))


def rto_of_state(state: Column) -> Column:
    return lookup(state, R.RTO_OF_STATE, "Other")


def max_charge(chemicals: Column, ids: Sequence[int], fragment: str) -> Column:
    """Largest quantity among entries with a listed id or a name fragment, else 0."""
    hits = F.filter(
        chemicals,
        lambda c: F.coalesce(c["id"].isin(*ids), F.lit(False))
        | F.coalesce(c["name"].contains(fragment), F.lit(False)))
    return F.coalesce(
        F.array_max(F.transform(hits, lambda c: F.coalesce(c["quantity"], F.lit(0)))),
        F.lit(0)).cast("long")


def half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("long")


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def _total(parts: Mapping[str, Column]) -> Column:
    total = sum(parts.values(), F.lit(0))
    return F.struct(
        F.least(F.lit(100), total).cast("long").alias("score"),
        F.struct(*[c.cast("long").alias(n) for n, c in parts.items()]).alias("components"))


def cold_icp(sites: Column, charge: Column, states: Column, rto: Column,
             sites_with_accidents: Column, naics: Column, *,
             strong_grid: Sequence[str] = ("PJM", "ERCOT", "ISO-NE"),
             medium_grid: Sequence[str] = ("MISO", "NYISO", "CAISO"),
             best_naics: str = "49312") -> Column:
    """Additive fit score out of 100, with every component visible."""
    return _total({
        "scale": F.least(F.lit(20), sites * 2),
        "refrig_intensity": F.least(F.lit(25), half_even(charge / 40_000)),
        "geographic_spread": F.least(F.lit(15), states * 2),
        "grid_exposure": F.when(rto.isin(*strong_grid), 14)
                          .when(rto.isin(*medium_grid), 10).otherwise(6),
        "replacement_signal": F.least(F.lit(12), sites_with_accidents * 3),
        "vertical_fit": F.when(naics == best_naics, 14).otherwise(9),
    })


def est_peak_kw(chlorine: Column, program_level: Column) -> Column:
    """Engineering estimate of site draw from chlorine tier, then program level."""
    level = F.when(F.coalesce(program_level, F.lit(0)) == 0, 3).otherwise(program_level)
    return (F.when(chlorine >= 300_000, 8_000).when(chlorine >= 100_000, 5_000)
            .when(chlorine >= 40_000, 3_000).when(chlorine >= 10_000, 1_500)
            .when(level == 1, 2_000).when(level == 2, 1_200).otherwise(500)).cast("long")


def buffer_class(name: Column, naics: Column, *, sewer: str = R.SEWER_NAME,
                 water: str = R.WATER_NAME, elevated_naics: str = "22131",
                 wet_well_naics: str = "22132") -> Column:
    """What a site can buffer with: its name decides, its code breaks ties."""
    n, code = F.coalesce(name, F.lit("")), F.coalesce(naics, F.lit(""))
    return (F.when(n.rlike(sewer), R.BUFFER_WET_WELL).when(n.rlike(water), R.BUFFER_ELEVATED)
            .when(code.startswith(elevated_naics), R.BUFFER_ELEVATED)
            .when(code.startswith(wet_well_naics), R.BUFFER_WET_WELL)
            .otherwise(R.BUFFER_UNKNOWN))


def sheddability(buffer: Column, confirmed: Column) -> Column:
    return (F.when(confirmed, 15).when(buffer.startswith("elevated"), 12)
            .when(buffer.startswith("wet-well"), 9).when(buffer.startswith("mixed"), 8)
            .otherwise(4))


def water_icp(kw: Column, rto: Column, dereg: Column, buffer: Column, confirmed: Column,
              sites_with_accidents: Column, recent_accident_sites: Column, multi_site: Column,
              states: Column, authority: Column, *,
              strong_grid: Sequence[str] = ("PJM", "ERCOT", "ISO-NE", "NYISO", "CAISO"),
              medium_grid: Sequence[str] = ("MISO", "SPP", "SERC", "Duke", "TVA")) -> Column:
    price = F.when(rto.isin(*strong_grid), 12).when(rto.isin(*medium_grid), 8).otherwise(5)
    return _total({
        "meter_size": F.least(F.lit(25), half_even(kw / 400)),
        "price_exposure": F.least(F.lit(25), price + F.when(dereg, 6).otherwise(0)),
        "sheddability": sheddability(buffer, confirmed),
        "operating_signal": F.least(
            F.lit(15), sites_with_accidents * 4 + F.when(recent_accident_sites > 0, 3).otherwise(0)),
        "channel_fit": F.least(
            F.lit(10), F.when(multi_site, 2).otherwise(0) + F.when(states > 1, 4).otherwise(0)
            + F.when(authority, 4).otherwise(0)),
    })


def excluded_reason(facility: Column, parent: Column, operator: Column,
                    exclusions: Sequence[tuple[str, str]] = R.EXCLUSIONS) -> Column:
    """Why a process is refused before resolution, or null."""
    hay = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (facility, parent, operator)])
    return F.coalesce(*[
        F.when(hay.rlike(p), F.lit(why + R.EXCLUSION_TAIL)) for p, why in exclusions])


def fingerprint(*parts: Column) -> Column:
    """First sixteen hex digits of SHA-256 over the parts, joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 16)


def pseudonym(c: Column) -> Column:
    return F.sha2(c, 256)
