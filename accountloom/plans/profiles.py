"""Vertical profiles: everything that differs between two runs of the one pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

from accountloom import refdata as R
from accountloom.functions.names import Rule, rules_of


@dataclass(frozen=True)
class Profile:
    """Rules and thresholds of one vertical.

    ``resolve_*`` switches turn the optional resolution passes on or off.
    """

    rules: tuple[Rule, ...]
    naics_labels: dict[str, str]
    customers: tuple[str, ...] = ()
    word_final: tuple[str, ...] = R.WORD_FINAL
    outlier_factor: int = R.OUTLIER_FACTOR
    single_site_floor: int = R.SINGLE_SITE_FLOOR
    queue_floor: int = R.QUEUE_FLOOR
    kw_floor: int = R.WATER_KW_FLOOR
    charge_field: str = "ammonia_lb"
    naics_prefix: int | None = None
    resolve_people: bool = True
    resolve_site_names: bool = True
    resolve_site_numbers: bool = True
    strong_grid: tuple[str, ...] = ("PJM", "ERCOT", "ISO-NE")
    medium_grid: tuple[str, ...] = ("MISO", "NYISO", "CAISO")
    best_naics: str = "49312"
    exclusions: tuple[tuple[str, str], ...] = ()
    sewer_name: str = R.SEWER_NAME
    water_name: str = R.WATER_NAME
    elevated_naics: str = "22131"
    wet_well_naics: str = "22132"
    authority_name: str = R.AUTHORITY_NAME
    dereg_states: tuple[str, ...] = R.DEREGULATED_RETAIL
    extra: dict = field(default_factory=dict)


COLD = Profile(rules=rules_of(R.COLD_RULES), naics_labels=R.COLD_NAICS, customers=R.COLD_CUSTOMERS)

WATER = Profile(
    rules=rules_of(R.WATER_RULES), naics_labels=R.WATER_NAICS, word_final=(),
    naics_prefix=5, exclusions=R.EXCLUSIONS, resolve_people=False, resolve_site_names=False,
    resolve_site_numbers=False,
    strong_grid=("PJM", "ERCOT", "ISO-NE", "NYISO", "CAISO"),
    medium_grid=("MISO", "SPP", "SERC", "Duke", "TVA"))
