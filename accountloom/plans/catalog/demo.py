"""Vertical profiles for the ``filings`` view over the star-schema tables."""

from accountloom.functions.names import Rule
from accountloom.plans.profiles import Profile

SEGMENTS = {f"Brand#{i}": f"Segment {i}" for i in range(1, 11)}

COLD_DEMO = Profile(
    rules=(Rule("old widget", "Old Widget Holdings"), Rule("red ring", "Red Ring Group"),
           Rule("blue gear|blue gizmo", "Blue Gear Corp.")),
    naics_labels=SEGMENTS, customers=("Old Widget Holdings", "hot rod"), word_final=(),
    charge_field="charge_lb", single_site_floor=40_000, queue_floor=20_000,
    strong_grid=("ASIA", "EUROPE"), medium_grid=("AMERICA",), best_naics="Brand#12")

WATER_DEMO = Profile(
    rules=(Rule("^red bolt|large bolt", "Bolt Utilities Holdings"),
           Rule("small (ring|plate)", "Small Works Authority")),
    naics_labels={"Brand#1": "Group 1", "Brand#2": "Group 2"}, word_final=(), naics_prefix=7,
    charge_field="chlorine_lb",
    resolve_people=False, resolve_site_names=False, resolve_site_numbers=False,
    strong_grid=("ASIA", "EUROPE"), medium_grid=("AMERICA", "AFRICA"),
    exclusions=((r"(?i)\bhot plate\b|\bcold rod", "continuous process — plates and rods"),
                (r"(?i)\bnew anvil(s)?\b", "anvil forging, not water service")),
    sewer_name=r"(?i)\b(gizmo|gear)\b", water_name=r"(?i)\b(widget|ring)\b",
    elevated_naics="Brand#1", wet_well_naics="Brand#2",
    authority_name=r"(?i)\b(bolt|rod|authority|region\w*)\b",
    dereg_states=("NATION_1", "NATION_4", "NATION_8", "NATION_9", "NATION_15"))
