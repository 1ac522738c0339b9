"""accountloom: account intelligence over messy self-reported filings, as Spark jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Thresholds, clocks and rule tables are arguments; no operator reads
the wall clock or depends on the order in which rows arrive.
"""

__version__ = "0.1.0"
