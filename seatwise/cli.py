"""Command-line jobs: the selection run and the exploration run.

    python -m seatwise.cli select (--responses PATH | --jdbc-url URL --jdbc-table T
                                  --jdbc-partition-column C --jdbc-lower L --jdbc-upper U)
                                  --snapshot OUT --admitted OUT
                                  [--special FILE] [--seats 160] [--seed N] [--null-scores error|skip]
                                  [--exclude-name NAME ...] [--cutoff TS] [--identity name|linked]
                                  [--recipients OUT [--recipients-batch N]] [--report OUT] [--admitted-csv OUT]
    python -m seatwise.cli explore (--admitted-csv PATH | --admitted PATH) --snapshot PATH --out DIR [--csv]

``select``: clean intake -> anonymised snapshot -> exclusions -> score and rank ->
weighted draw + guaranteed + special list -> admitted table, recipient batches,
report tables.  ``explore``: admitted CSV + applicant snapshot -> harmonised table
-> the six chart tables.  Every output is written by Spark; nothing is collected.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from seatwise.plans.config import CUTOFF, SEATS, DrawConfig, IntakeConfig
from seatwise.plans.explore import chart_tables, harmonise
from seatwise.plans.intake import anonymised_snapshot, apply_exclusions, clean_intake
from seatwise.plans.report import profile_report, recipient_list
from seatwise.plans.selection import score_applicants, seat_draw
from seatwise.session import build_session
from seatwise.sources.codebook import codebook_df, response_schema
from seatwise.sources.readers import read_csv2, read_jdbc, read_line_list, read_parquet
from seatwise.sources.writers import write_csv2, write_text_lines


def read_responses(spark: SparkSession, a: argparse.Namespace):
    """The response table: a parquet folder, or a database table over JDBC read in
    ``--jdbc-partitions`` parallel ranges of ``--jdbc-partition-column``."""
    if a.jdbc_url:
        props = {"user": a.jdbc_user} if a.jdbc_user else {}
        return read_jdbc(spark, a.jdbc_url, a.jdbc_table, a.jdbc_partition_column,
                         a.jdbc_lower, a.jdbc_upper, a.jdbc_partitions, props)
    # the form's columns as declared, and any other column as the files have it
    found = read_parquet(spark, a.responses)
    declared = read_parquet(spark, a.responses, schema=response_schema())
    others = [f for f in found.schema.fields if f.name not in declared.columns]
    schema = T.StructType(declared.schema.fields + others)
    return read_parquet(spark, a.responses, schema=schema)


def run_select(spark: SparkSession, a: argparse.Namespace) -> dict[str, str]:
    raw = read_responses(spark, a)
    clean = clean_intake(raw, IntakeConfig(exclude_names=tuple(a.exclude_name or ()), cutoff=a.cutoff,
                                           identity=a.identity))
    # The cleaned table feeds the snapshot, the score and the draw: write it once.
    clean = clean.checkpoint(eager=True)
    out = {"snapshot": anonymised_snapshot(clean, a.snapshot)}
    scored = score_applicants(apply_exclusions(clean)).checkpoint(eager=True)
    special = read_line_list(spark, a.special) if a.special else None
    cfg = DrawConfig(seats=a.seats, seed=a.seed, null_weight=a.null_scores)
    admitted = seat_draw(scored, cfg, special_list=special)
    admitted.write.mode("overwrite").parquet(a.admitted)
    out["admitted"] = a.admitted
    admitted = spark.read.parquet(a.admitted)
    if a.admitted_csv:
        out["admitted_csv"] = write_csv2(admitted.drop("nombre", "correo", "puntaje"), a.admitted_csv)
    if a.recipients:
        out["recipients"] = write_text_lines(recipient_list(admitted, a.recipients_batch), "recipients", a.recipients)
    if a.report:
        for who, people in (("applicants", scored), ("admitted", admitted)):
            for name, df in profile_report(people).items():
                df.write.mode("overwrite").parquet(f"{a.report.rstrip('/')}/{who}/{name}")
        out["report"] = a.report
    return out


def run_explore(spark: SparkSession, a: argparse.Namespace) -> dict[str, str]:
    if a.admitted_csv:
        admitted = read_csv2(spark, a.admitted_csv)
    else:   # the select job's parquet output: drop the personal columns and the score
        admitted = read_parquet(spark, a.admitted).drop("nombre", "correo", "puntaje")
    applicants = read_parquet(spark, a.snapshot)
    codebook = codebook_df(spark) if a.codebook_labels else None
    datos = harmonise(admitted, applicants, codebook=codebook, balanced=a.balanced_wrap, collation=a.collation).checkpoint(eager=True)
    out = {}
    for name, df in chart_tables(datos).items():
        path = f"{a.out.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        out[name] = path
        if a.csv:
            out[f"{name}_csv"] = write_csv2(spark.read.parquet(path), f"{path}_csv")
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seatwise")
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("select", help="clean, score and draw seats")
    src = s.add_mutually_exclusive_group(required=True)
    src.add_argument("--responses", help="parquet folder of responses")
    src.add_argument("--jdbc-url", help="JDBC URL of the response database (password via the URL "
                                        "or the driver's own configuration)")
    s.add_argument("--jdbc-table")
    s.add_argument("--jdbc-user")
    s.add_argument("--jdbc-partition-column", help="numeric or timestamp column to split the read on")
    s.add_argument("--jdbc-lower", help="least value of that column, as a number or a timestamp")
    s.add_argument("--jdbc-upper", help="largest value of that column")
    s.add_argument("--jdbc-partitions", type=int, default=8)
    s.add_argument("--snapshot", required=True)
    s.add_argument("--admitted", required=True)
    s.add_argument("--admitted-csv")
    s.add_argument("--special")
    s.add_argument("--recipients")
    s.add_argument("--recipients-batch", type=int, help="addresses per line; without it all are one line")
    s.add_argument("--report")
    s.add_argument("--seats", type=int, default=SEATS)
    s.add_argument("--seed", type=int, default=1)
    s.add_argument("--exclude-name", action="append")
    s.add_argument("--cutoff", default=CUTOFF)
    s.add_argument("--identity", choices=["name", "linked"], default="name",
                   help="one person per name, or per group of names and e-mails that occur together")
    s.add_argument("--null-scores", choices=["error", "skip"], default="error",
                   help="a null score (an unanswered scored question) stops the draw, or "
                        "leaves that person out of the draw")
    e = sub.add_parser("explore", help="applicants vs admitted chart tables")
    adm = e.add_mutually_exclusive_group(required=True)
    adm.add_argument("--admitted-csv", help="admitted people as ;-CSV (comma decimals)")
    adm.add_argument("--admitted", help="admitted people as written by the select job (parquet)")
    e.add_argument("--snapshot", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--csv", action="store_true", help="also write each chart table as ;-CSV")
    e.add_argument("--codebook-labels", action="store_true",
                   help="exact option labels from the codebook instead of the charts' partial repairs")
    e.add_argument("--balanced-wrap", action="store_true", help="wrap discipline labels with least raggedness")
    e.add_argument("--collation", help="language whose order the levels follow, e.g. es (default: by bytes)")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    p = parser()
    a = p.parse_args(argv)
    if a.cmd == "select" and a.jdbc_url and not all((a.jdbc_table, a.jdbc_partition_column, a.jdbc_lower, a.jdbc_upper)):
        p.error("--jdbc-url needs --jdbc-table, --jdbc-partition-column, --jdbc-lower and --jdbc-upper")
    spark = spark or build_session()
    return run_select(spark, a) if a.cmd == "select" else run_explore(spark, a)


if __name__ == "__main__":
    print(main(sys.argv[1:]))
