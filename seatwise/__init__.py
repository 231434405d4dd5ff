"""seatwise: intake cleaning, rule scoring, seat draws and applicant profiles on Spark.

Sub-packages
------------
sources    readers, writers and inspection (parquet, JDBC, ``;``-CSV, line lists, codebook)
functions  column-level helpers (null rules, text, conversions)
operators  DataFrame -> DataFrame building blocks (dedup, ordinal, sampling, counts, ...)
plans      the composite jobs (clean intake, scoring, seat draw, reports, chart tables)
streaming  incremental intake over a growing response folder
"""

__version__ = "0.1.0"
