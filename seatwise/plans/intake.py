"""Clean intake (first submission wins), anonymised snapshot, eligibility exclusions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.functions.convert import as_timestamp, timestamp_literal
from seatwise.functions.nulls import case_default
from seatwise.functions.text import remove_all, squish
from seatwise.operators.columns import across_strings, drop_prefix_keep
from seatwise.operators.components import components
from seatwise.operators.dedup import first_per_key
from seatwise.operators.skew import lookup
from seatwise.plans.config import EXCLUSIONS, IntakeConfig
from seatwise.session import stored
from seatwise.sources.writers import write_snapshot


def clean_intake(df: DataFrame, cfg: IntakeConfig | None = None,
                 mark: Callable[[str, DataFrame], DataFrame] = lambda step, rows: rows) -> DataFrame:
    """Responses -> one cleaned row per person.

    In this order: e-mail present -> test names out -> drop ``time*`` columns but the
    closing time -> parse it -> squish and lower the name, lower and de-space the
    e-mail -> first submission per name (time ascending, nulls last, session id as
    tie-break) -> e-mail pattern -> inclusive cut-off -> ``s`` -> ``sí`` in every
    string column.

    The dedup runs BEFORE the e-mail and cut-off checks, so a person whose first
    answer has a bad e-mail is dropped even if a later one is good
    (``validate_before_dedup=True`` checks first instead).  The key is the name alone
    unless ``dedup_extra_keys`` adds columns.  With ``identity="linked"`` a person is
    everything that names and e-mails link (``first_per_person``).

    ``mark`` is given the rows after each step, with the step's name (``plans.observed``).
    """
    cfg = cfg or IntakeConfig()
    if cfg.identity not in ("name", "linked"):
        raise ValueError(f"unknown identity {cfg.identity!r}")
    if cfg.identity == "linked" and cfg.dedup_extra_keys:
        raise ValueError("identity='linked' takes no dedup_extra_keys: a key that splits a name contradicts the links")
    name, mail, t, sid = cfg.name_col, cfg.email_col, cfg.time_col, cfg.session_col
    out = mark("e-mail present", mark("read", df).filter(F.col(mail).isNotNull()))
    for test in cfg.exclude_names:
        out = out.filter(F.col(name) != F.lit(test))
    out = mark("test names out", out)
    has_sid = sid in out.columns
    out = drop_prefix_keep(out, cfg.time_prefix, keep=[t] + ([sid] if has_sid else []), drop=[])
    out = out.withColumn(t, as_timestamp(out, t))
    out = out.withColumns({
        name: F.lower(squish(name)),
        mail: remove_all(F.lower(F.col(mail)), " "),
    })
    checks = F.col(mail).rlike(cfg.email_pattern)
    if cfg.cutoff is not None:
        checks = checks & (F.col(t) <= timestamp_literal(cfg.cutoff, out.schema[t].dataType))
    if cfg.validate_before_dedup:
        out = mark("valid and in time", out.filter(checks))
    if cfg.identity == "linked":
        out = first_per_person(out, cfg, [sid] if has_sid else [])
    else:
        keys = [name, *cfg.dedup_extra_keys]
        out = first_per_key(out, keys, t, tiebreak=[sid] if has_sid else [], method=cfg.dedup_method)
    out = mark("first of a person", out)
    if not cfg.validate_before_dedup:
        out = mark("valid and in time", out.filter(checks))
    if has_sid and not cfg.keep_session:
        out = out.drop(sid)
    yes = cfg.yes_pattern
    return across_strings(out, lambda c: case_default(c.rlike(yes), F.lit(cfg.yes_value), c))


def first_per_person(rows: DataFrame, cfg: IntakeConfig, tiebreak: Sequence[str]) -> DataFrame:
    """The first submission of each person, where rows that share a name or a valid e-mail are
    one person, also by way of others: a second spelling of the name with the same e-mail, and
    a second e-mail of either spelling.

    An e-mail that fails the pattern links nothing ("no", "-" and the like are many people's
    answer), nor does a null or empty name.  A row with neither is its own person; the e-mail
    check removes it.  Ties in time and ``tiebreak`` are decided by name and e-mail.

    Only the first row of each (name, e-mail) can be a person's first, so the rows are cut
    down to those with the usual partial limit, and stored.  What is linked, joined and
    ranked after that is one row per pair, with hot names and e-mails taken out of the joins.
    """
    name, mail, t = cfg.name_col, cfg.email_col, cfg.time_col
    by_name = F.when(F.col(name) != "", F.concat(F.lit("n"), F.col(name)))
    by_mail = F.when(F.col(mail).rlike(cfg.email_pattern), F.concat(F.lit("m"), F.col(mail)))
    keyed = rows.withColumns({"__n": by_name, "__m": by_mail})
    neither = F.col("__n").isNull() & F.col("__m").isNull()
    ties = [*tiebreak, name, mail]
    firsts = stored(first_per_key(keyed.filter(~neither), ["__n", "__m"], t, tiebreak=ties, method=cfg.dedup_method))
    person = components(firsts.select("__n", "__m"), "__n", "__m")
    firsts = firsts.withColumn("__node", F.coalesce("__n", "__m"))
    of_node = person.select(F.col("node").alias("__node"), F.col("component").alias("__person"))
    out = first_per_key(lookup(firsts, "__node", of_node), "__person", t, tiebreak=ties, method=cfg.dedup_method)
    return out.select(*rows.columns).unionByName(keyed.filter(neither).select(*rows.columns))


def anonymised_snapshot(clean: DataFrame, path: str,
                        personal: Sequence[str] = ("nombre", "correo")) -> str:
    """Write the cleaned table without personal columns (before exclusions)."""
    return write_snapshot(clean, path, drop=personal)


def apply_exclusions(df: DataFrame, exclusions: Sequence[tuple[str, object]] = EXCLUSIONS) -> DataFrame:
    """Keep rows where every ``col != value`` holds; a null in a listed column drops
    the row (plain SQL comparison)."""
    cond = F.lit(True)
    for col, value in exclusions:
        cond = cond & (F.col(col) != F.lit(value))
    return df.filter(cond)
