"""DataFrame -> DataFrame building blocks."""

from seatwise.operators.categories import relevel_ordinal, reorder_by
from seatwise.operators.chances import inclusion_chances
from seatwise.operators.columns import across_strings, add_constant, drop_prefix_keep, relocate_after, select_any_of
from seatwise.operators.counts import collapse, count_by, count_each, count_having, mean_strict
from seatwise.operators.dedup import first_per_key
from seatwise.operators.density import density
from seatwise.operators.lump import kept_levels, lump_top_n
from seatwise.operators.ordinal import head_rows, ordinal, tail_rows
from seatwise.operators.sampling import hash_uniform, sampling_key, weighted_sample
from seatwise.operators.scoring import Rule, score_expr
from seatwise.operators.shares import share_of_total, share_within
from seatwise.operators.sizing import broadcast_checked, input_partitions, spread
from seatwise.operators.sorting import sort_cols

__all__ = [
    "relevel_ordinal", "reorder_by", "across_strings", "add_constant", "drop_prefix_keep",
    "relocate_after", "select_any_of", "collapse", "count_by", "count_each", "count_having", "mean_strict",
    "first_per_key", "density", "kept_levels", "lump_top_n", "head_rows", "ordinal", "tail_rows",
    "hash_uniform", "inclusion_chances", "sampling_key", "weighted_sample", "Rule", "score_expr", "share_of_total",
    "share_within", "sort_cols", "broadcast_checked", "input_partitions", "spread",
]
