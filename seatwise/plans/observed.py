"""The clean intake with its own account: rows after each step and conformance counts are
observed while the snapshot is written, without another scan.

The counts are Spark's observed metrics, one row per task.  They are those of the tasks
as they ran: a map task that is computed again after a lost executor may count twice, while
the written rows are right in any case.  ``account`` tells such a run by steps that grow.
Spark drops observations together with a plan whose result turns out empty; those steps are
counted on their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seatwise.operators.codebook import conformance_counts
from seatwise.plans.config import IntakeConfig
from seatwise.plans.intake import clean_intake

ACCOUNT = "step string, n long, n_lost long"
CONFORMANCE = "question_id string, n long, n_missing long, n_out_of_domain long"


def _metrics(seen: Observation, otherwise: DataFrame) -> dict:
    """What ``seen`` observed, or the same aggregates as the one row of ``otherwise``."""
    if seen._jo.getRow().length() == 0:
        return otherwise.first().asDict()
    return seen.get


class Steps:
    """Counts the rows of named steps; ``mark`` goes to ``clean_intake``."""

    def __init__(self) -> None:
        self._observed: list[tuple[str, Observation, DataFrame]] = []

    def mark(self, step: str, rows: DataFrame) -> DataFrame:
        seen, n = Observation(), F.count(F.lit(1)).alias("n")
        self._observed.append((step, seen, rows.agg(n)))
        return rows.observe(seen, n)

    def account(self, spark: SparkSession) -> DataFrame:
        """(step, n, n_lost) once the rows have been written: rows after a step, and how many it
        took out."""
        n = [(step, _metrics(seen, count)["n"]) for step, seen, count in self._observed]
        grown = [b[0] for a, b in zip(n, n[1:]) if b[1] > a[1]]
        if grown:
            raise RuntimeError(f"more rows after {grown} than before: tasks were computed again, count the steps on their own")
        lost = [0, *[a[1] - b[1] for a, b in zip(n, n[1:])]]
        return spark.createDataFrame([(s, c, x) for (s, c), x in zip(n, lost)], ACCOUNT)


def write_observed_intake(df: DataFrame, path: str, cfg: IntakeConfig | None = None, codebook: DataFrame | None = None,
                          required: Sequence[str] = (), drop: Sequence[str] = ("nombre", "correo")) -> tuple[DataFrame, DataFrame | None]:
    """Write the anonymised snapshot of the cleaned rows to ``path``; returns the account of the
    steps and, with a ``codebook``, the conformance report of the cleaned rows.  Without rows
    every count is 0."""
    spark, steps = df.sparkSession, Steps()
    clean = clean_intake(df, cfg, steps.mark)
    keep = [c for c in clean.columns if c not in drop]
    seen, qs, plain = Observation(), [], None
    if codebook is not None:
        clean, qs, counts = conformance_counts(clean, codebook, required)
        if qs:
            counts = [F.count(F.lit(1)).alias("n"), *counts]
            plain, clean = clean.agg(*counts), clean.observe(seen, *counts)
    clean.select(*keep).write.mode("overwrite").parquet(path)
    if codebook is None:
        return steps.account(spark), None
    found = _metrics(seen, plain) if qs else {}
    rows = [(q, found["n"], found[f"m__{q}"], found[f"o__{q}"]) for q in qs]
    return steps.account(spark), spark.createDataFrame(rows, CONFORMANCE)
