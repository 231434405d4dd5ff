"""Score, rank and draw seats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.operators.columns import relocate_after
from seatwise.operators.membership import membership_flag
from seatwise.operators.ordinal import ordinal
from seatwise.operators.sampling import TOPK_MAX, weighted_sample
from seatwise.operators.scoring import score_expr
from seatwise.plans.config import DrawConfig, ScoreConfig


def score_applicants(df: DataFrame, cfg: ScoreConfig | None = None) -> DataFrame:
    """Add the score, then the rank ``id`` = 1..n by score descending (nulls last)
    with the configured tie-breaks; the score column moves after ``cfg.after``."""
    cfg = cfg or ScoreConfig()
    out = df.withColumn(cfg.name, score_expr(cfg.rules, cfg.base, cfg.floor_at, cfg.floor_to))
    if cfg.rank_name:
        out = ordinal(out, list(cfg.rank_order), name=cfg.rank_name, method=cfg.rank_method)
    if cfg.after and cfg.after in out.columns:
        out = relocate_after(out, cfg.name, cfg.after)
    return out


def seat_draw(scored: DataFrame, cfg: DrawConfig | None = None,
              special_list: DataFrame | None = None, list_key: str = "value",
              method: str = "filter") -> DataFrame:
    """Admitted rows: the weighted draw of ``cfg.seats``, plus everyone in the
    guaranteed group, plus everyone on the special list - each person once.

    The guaranteed people also take part in the draw, so the admitted count lies
    between ``seats`` and ``seats + guaranteed + listed``
    (``guaranteed_in_draw=False`` draws the seats among the others only).

    ``method="filter"`` (default) reads the scored table once and keeps a row when
    any of the three memberships holds.  ``method="union"`` is the literal form -
    three row sets appended and made distinct - which shuffles every admitted row
    on all its columns; same rows when ids are unique.
    """
    cfg = cfg or DrawConfig()
    pool = scored
    if cfg.guaranteed_col and not cfg.guaranteed_in_draw:
        pool = scored.filter(~F.coalesce(F.col(cfg.guaranteed_col) == F.lit(cfg.guaranteed_value), F.lit(False)))
    drawn = weighted_sample(pool, cfg.seats, cfg.id_col, cfg.weight, seed=cfg.seed,
                            on_short=cfg.on_short, null_weight=cfg.null_weight)
    if method == "union":
        parts = [drawn]
        if cfg.guaranteed_col:
            parts.append(scored.filter(F.col(cfg.guaranteed_col) == F.lit(cfg.guaranteed_value)))
        if special_list is not None and cfg.list_col:
            from seatwise.operators.membership import in_list
            parts.append(in_list(scored, cfg.list_col, special_list, key_col=list_key,
                                 max_broadcast_rows=cfg.max_broadcast_rows).select(*scored.columns))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()
    if method != "filter":
        raise ValueError(f"unknown method {method!r}")
    ids = drawn.select(cfg.id_col).withColumn("__drawn", F.lit(True))
    if cfg.seats <= TOPK_MAX:      # at most `seats` rows: a proven bound
        ids = F.broadcast(ids)
    out = scored.join(ids, on=cfg.id_col, how="left")
    keep = F.coalesce(F.col("__drawn"), F.lit(False))
    if cfg.guaranteed_col:
        keep = keep | F.coalesce(F.col(cfg.guaranteed_col) == F.lit(cfg.guaranteed_value), F.lit(False))
    if special_list is not None and cfg.list_col:
        out = membership_flag(out, cfg.list_col, special_list, "__listed", key_col=list_key,
                              max_broadcast_rows=cfg.max_broadcast_rows)
        keep = keep | F.col("__listed")
    cols = scored.columns
    return out.filter(keep).select(*cols)
