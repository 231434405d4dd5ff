"""Codebook-driven operators: decode codes to labels, conformance report.

A codebook is the definition of a form: usually tens to hundreds of options.  Up to
``MAX_LITERALS`` options it becomes plain expressions (a map literal per question for
decoding, an ``IN`` list for the domain test), so the response table is read in one
pass without a join.  A larger codebook is joined question by question; the join's
strategy is chosen on the size of its option table.  Both follow one rule: answers and codes
are compared as text, and of a repeated code the greatest label (in byte order) counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.operators.sizing import broadcast_checked

MAX_LITERALS = 500       # options that are made literals of the plan


def _options(codebook: DataFrame) -> dict[str, list[tuple[str, str]]] | None:
    """The distinct options by question in the codebook's order, None when there are more than
    ``MAX_LITERALS``; of a repeated code the greatest label, which may be null only alone."""
    rows = codebook.filter(F.col("option_code").isNotNull()).limit(MAX_LITERALS + 1).collect()
    if len(rows) > MAX_LITERALS:
        return None
    best: dict[tuple[str, str], str | None] = {}
    for r in rows:
        key, label = (r["question_id"], str(r["option_code"])), r["option_label"]
        held = best.get(key)
        best[key] = label if held is None or label is not None and label.encode() > held.encode() else held
    out: dict[str, list[tuple[str, str]]] = {}
    for (question, code), label in best.items():
        out.setdefault(question, []).append((code, label))
    return out


def _closed(codebook: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that the codebook has options for, in column order."""
    known = (codebook.filter(F.col("option_code").isNotNull() & F.col("question_id").isin(list(columns)))
             .select("question_id").distinct().collect())      # at most one row per column
    return [c for c in columns if c in {r["question_id"] for r in known}]


def _codes(codebook: DataFrame, q: str) -> DataFrame:
    """(code, label) of a question; of a repeated code one label is taken."""
    return (codebook.filter((F.col("question_id") == q) & F.col("option_code").isNotNull())
            .groupBy(F.col("option_code").cast("string").alias("__code")).agg(F.max("option_label").alias("__label")))


def decode(df: DataFrame, codebook: DataFrame, questions: Sequence[str] | None = None,
           suffix: str = "_label") -> DataFrame:
    """Add ``<q><suffix>`` = option label for each closed question column ``q``.

    Unknown codes and nulls give null.  A code is compared with the answer's text, so a column
    of numbers is decoded like one of texts.
    """
    opts = _options(codebook)
    if opts is None:
        out = df
        for q in _closed(codebook, [c for c in (questions or df.columns) if c in df.columns]):
            codes = broadcast_checked(_codes(codebook, q).withColumnRenamed("__label", f"{q}{suffix}"))[0]
            out = out.join(codes, F.col(q).cast("string") == F.col("__code"), "left").drop("__code")
        return out
    qs = [q for q in (questions or list(opts)) if q in df.columns and q in opts]
    adds = {}
    for q in qs:
        m = F.create_map(*[F.lit(x) for code, label in opts[q] for x in (code, label)])
        adds[f"{q}{suffix}"] = F.try_element_at(m, F.col(q).cast("string"))
    return df.withColumns(adds) if adds else df


def conformance_counts(df: DataFrame, codebook: DataFrame, required: Sequence[str]) -> tuple[DataFrame, list[str], list]:
    """``df`` with the columns that the counts read (``__ok_<q>``, for a large codebook only), the
    questions, and the aggregates ``m__<q>`` (missing) and ``o__<q>`` (out of domain) of each."""
    opts = _options(codebook)
    req = set(required)
    if opts is None:
        closed = _closed(codebook, df.columns)
        for q in closed:
            codes = _codes(codebook, q).select("__code", F.lit(True).alias(f"__ok_{q}"))
            df = df.join(broadcast_checked(codes)[0], F.col(q).cast("string") == F.col("__code"), "left").drop("__code")
    else:
        closed = [q for q in opts if q in df.columns]
    qs = [q for q in dict.fromkeys([*required, *closed]) if q in df.columns]
    aggs = []
    for q in qs:
        c = F.col(q)
        miss = F.sum(F.when(c.isNull(), 1).otherwise(0)) if q in req else F.sum(F.lit(0))
        if q in closed:
            known = F.col(f"__ok_{q}").isNotNull() if opts is None else c.cast("string").isin([code for code, _ in opts[q]])
            ood = F.sum(F.when(c.isNotNull() & ~known, 1).otherwise(0))
        else:
            ood = F.sum(F.lit(0))
        aggs += [F.coalesce(miss, F.lit(0)).cast("long").alias(f"m__{q}"), F.coalesce(ood, F.lit(0)).cast("long").alias(f"o__{q}")]
    return df, qs, aggs


def conformance(df: DataFrame, codebook: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per question: rows, missing answers to required questions, answers outside the
    closed domain.  Rows ``(question_id, n, n_missing, n_out_of_domain)``."""
    df, qs, aggs = conformance_counts(df, codebook, required)
    if not qs:
        return df.sparkSession.createDataFrame(
            [], "question_id string, n bigint, n_missing bigint, n_out_of_domain bigint")
    one = df.agg(F.count(F.lit(1)).alias("__n"), *aggs)
    stack = ", ".join(f"'{q}', `m__{q}`, `o__{q}`" for q in qs)
    return one.select(F.col("__n").alias("n"),
                      F.expr(f"stack({len(qs)}, {stack}) as (question_id, n_missing, n_out_of_domain)")) \
              .select("question_id", "n", "n_missing", "n_out_of_domain")
