"""Incremental intake: first submission per person over a growing response folder.

The form keeps appending answers; the batch job (``plans.intake.clean_intake``)
re-reads everything.  Here the same rule runs as a Structured Streaming
aggregation: the state store keeps one row per person (the earliest submission
so far, by time with nulls last, then session id), and each micro-batch emits the
people whose first submission changed (``update`` mode), or the whole table
(``complete`` mode).

The row-level steps (e-mail present, test names, name/e-mail normalisation) run
before the aggregate, exactly as in the batch job.  The checks that the batch job
applies AFTER the dedup (e-mail pattern, cut-off) cannot drop rows from an
updating aggregate - a later, earlier-timed answer may replace the first one - so
they become a ``valid`` flag; a keyed sink keeps the latest row per person and
reads ``valid`` rows.  State size = number of distinct people, not submissions.

``final_submissions`` is the form with a closing time: one event-time window that ends there.
A person's row is emitted once, when the watermark has passed the closing, and is final;
its state is dropped then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatwise.functions.convert import as_timestamp, timestamp_literal
from seatwise.functions.nulls import case_default
from seatwise.functions.text import remove_all, squish
from seatwise.operators.columns import drop_prefix_keep
from seatwise.plans.config import IntakeConfig


def _prepared(stream: DataFrame, cfg: IntakeConfig) -> DataFrame:
    """The row-level steps of the intake: e-mail present, test names out, times parsed, name
    and e-mail normalised."""
    name, mail, t, sid = cfg.name_col, cfg.email_col, cfg.time_col, cfg.session_col
    out = stream.filter(F.col(mail).isNotNull())
    for test in cfg.exclude_names:
        out = out.filter(F.col(name) != F.lit(test))
    has_sid = sid in out.columns
    out = drop_prefix_keep(out, cfg.time_prefix, keep=[t] + ([sid] if has_sid else []))
    out = out.withColumn(t, as_timestamp(out, t))
    out = out.withColumns({name: F.lower(squish(name)), mail: remove_all(F.lower(F.col(mail)), " ")})
    return out


def first_submissions(stream: DataFrame, cfg: IntakeConfig | None = None) -> DataFrame:
    """Streaming DataFrame: one row per person with the earliest submission and a
    ``valid`` flag (e-mail pattern and inclusive cut-off hold).  Honours the same
    switches as the batch job (``dedup_extra_keys``, ``validate_before_dedup``)."""
    cfg = cfg or IntakeConfig()
    if cfg.identity != "name":
        raise ValueError("a stream knows people by name: links between names and e-mails need all rows")
    name, mail, t, sid = cfg.name_col, cfg.email_col, cfg.time_col, cfg.session_col
    out = _prepared(stream, cfg)
    has_sid = sid in out.columns
    valid = F.coalesce(F.col(mail).rlike(cfg.email_pattern), F.lit(False))
    if cfg.cutoff is not None:
        valid = valid & F.coalesce(F.col(t) <= timestamp_literal(cfg.cutoff, out.schema[t].dataType),
                                   F.lit(False))
    if cfg.validate_before_dedup:
        out = out.filter(valid)
    keys = [name, *cfg.dedup_extra_keys]
    cols = [c for c in out.columns if c not in keys]
    ties = [F.col(sid).isNull(), F.col(sid)] if has_sid else []
    order = F.struct(F.col(t).isNull(), F.col(t), *ties)
    agg = out.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("__first"))
    first = agg.select(*keys, *[F.col("__first")[c].alias(c) for c in cols])
    first = first.withColumn("valid", valid)
    # the keys stay as they are until the sink has been de-duplicated on them
    strings = [f.name for f in first.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keys]
    first = _rewrite_yes(first, strings, cfg)
    if has_sid and not cfg.keep_session:
        first = first.drop(sid)
    return first


OPENS = "1900-01-01 00:00:00"      # no answer is older; one that claims to be has no time


def final_submissions(stream: DataFrame, cfg: IntakeConfig | None = None, late: str = "0 seconds",
                      opens: str = OPENS) -> DataFrame:
    """Streaming DataFrame for ``append`` mode: the rows of the batch intake, each emitted once,
    when ``cfg.cutoff`` has passed in the answers' own time (by ``late`` more).

    All answers up to the closing (inclusive) fall into one event-time window, which ends a
    microsecond after it.  Answers without a time, or later, cannot be an admissible first one
    and never enter the state.  The watermark closes the window: until an answer later than the
    closing plus ``late`` has come, none is too late in whatever order they arrive; after that
    the rows are written, the state is empty, and stragglers change nothing.  A form that takes
    no answers after its closing needs one row with a later time, a name and an e-mail; such
    rows move the watermark and are dropped.
    """
    cfg = cfg or IntakeConfig()
    if cfg.identity != "name":
        raise ValueError("a stream knows people by name: links between names and e-mails need all rows")
    if cfg.cutoff is None:
        raise ValueError("final rows need a closing time (cutoff)")
    name, mail, t, sid = cfg.name_col, cfg.email_col, cfg.time_col, cfg.session_col
    out = _prepared(stream, cfg)
    has_sid = sid in out.columns
    # conditions on the event time stay above the watermark, so later answers move it
    out = out.withColumn("__at", F.col(t).cast("timestamp")).withWatermark("__at", late)
    start, end = (_micros(out.sparkSession, x) for x in (opens, cfg.cutoff))
    end += 1
    if not start < end or end <= 0:
        raise ValueError(f"the closing time {cfg.cutoff!r} must lie after {opens!r} and after 1970")
    at = F.unix_micros("__at")
    out = out.filter((at >= F.lit(start)) & (at < F.lit(end)))
    valid = F.coalesce(F.col(mail).rlike(cfg.email_pattern), F.lit(False))
    if cfg.validate_before_dedup:
        out = out.filter(valid)
    keys = [name, *cfg.dedup_extra_keys]
    cols = [c for c in out.columns if c not in (*keys, "__at")]
    order = F.struct(F.col(t), *([F.col(sid).isNull(), F.col(sid)] if has_sid else []))
    # windows of this length end at the closing and at nothing else the answers can reach
    size = max(end - start, end + 1)
    term = F.window("__at", f"{size} microseconds", startTime=f"{end - size} microseconds")
    first = out.groupBy(term, *keys).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("__first"))
    first = first.select(*keys, *[F.col("__first")[c].alias(c) for c in cols]).filter(valid)
    if has_sid and not cfg.keep_session:
        first = first.drop(sid)
    strings = [f.name for f in first.schema.fields if isinstance(f.dataType, T.StringType)]
    return _rewrite_yes(first, strings, cfg)


def _micros(spark, text: str) -> int:
    """Microseconds since 1970 of a time written as text, in the session's zone."""
    return spark.range(1).select(F.unix_micros(F.lit(text).cast("timestamp"))).first()[0]


def _rewrite_yes(df: DataFrame, cols: list[str], cfg: IntakeConfig) -> DataFrame:
    return df.withColumns({c: case_default(F.col(c).rlike(cfg.yes_pattern), F.lit(cfg.yes_value), F.col(c))
                           for c in cols})


def finish(firsts: DataFrame, cfg: IntakeConfig | None = None, valid_only: bool = True) -> DataFrame:
    """The last step on a current table of ``first_submissions`` rows: valid rows only, and
    the yes-rewriting of the grouping keys."""
    cfg = cfg or IntakeConfig()
    out = _rewrite_yes(firsts, [cfg.name_col, *cfg.dedup_extra_keys], cfg)
    return out.filter("valid").drop("valid") if valid_only else out


def response_stream(spark, folder: str, schema: T.StructType | str, max_files_per_trigger: int = 1000):
    """Stream of response files (parquet) appearing in ``folder``."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(folder))


def changes_sink(path: str):
    """``foreachBatch`` sink for ``update`` mode: each micro-batch's changed rows go to
    ``<path>/epoch=<id>`` (overwritten on a retry of the same epoch, so replays are
    idempotent).  Only changed people are written, not the whole table."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch_id}")
    return write


def current_firsts(spark, path: str, cfg: IntakeConfig | None = None, valid_only: bool = True) -> DataFrame:
    """The current first submission per person from a ``changes_sink`` folder: the row of
    the latest epoch for each value of all the grouping keys, which are rewritten last."""
    from seatwise.operators.dedup import first_per_key

    cfg = cfg or IntakeConfig()
    keys = [cfg.name_col, *cfg.dedup_extra_keys]
    ch = spark.read.parquet(path)
    latest = first_per_key(ch.withColumn("__neg_epoch", -F.col("epoch")), keys, "__neg_epoch")
    return finish(latest.drop("__neg_epoch", "epoch"), cfg, valid_only)
