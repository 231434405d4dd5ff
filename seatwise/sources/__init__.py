"""Sources, sinks and inspection."""

from seatwise.sources.codebook import QUESTIONS, REQUIRED, codebook_df, read_codebook, response_schema
from seatwise.sources.inspect import column_profile, glimpse
from seatwise.sources.readers import comma_decimal, read_csv2, read_jdbc, read_line_list, read_parquet
from seatwise.sources.writers import csv2_frame, write_csv2, write_snapshot, write_text_lines

__all__ = ["QUESTIONS", "REQUIRED", "codebook_df", "read_codebook", "response_schema", "column_profile", "glimpse",
           "comma_decimal", "read_csv2", "read_jdbc", "read_line_list", "read_parquet",
           "csv2_frame", "write_csv2", "write_snapshot", "write_text_lines"]
