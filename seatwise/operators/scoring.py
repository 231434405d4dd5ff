"""Rule-based score as ONE expression folded from a rule list.

The scripts this replaces chain ``if_else(cond, score + d, score)`` once per rule.
Folded, that is:

    score = base + sum(d_i for true conditions)
    score = null if any non-null-safe condition is null      (three-valued if_else)
    score = floor_to where score <= floor_at, null stays null

A rule is ``Rule(col, "eq", value, delta)`` (null in -> null score), ``Rule(col,
"in", [values], delta)`` (membership, never null), or ``Rule.expr(column_expr,
delta, null_safe)`` for anything else.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from seatwise.functions.nulls import is_in


@dataclass(frozen=True)
class Rule:
    col: str | None
    op: str
    value: Any
    delta: float
    cond: Column | None = field(default=None, compare=False)
    null_safe_flag: bool = False

    @staticmethod
    def expr(cond: Column, delta: float, null_safe: bool = False) -> "Rule":
        return Rule(None, "expr", None, delta, cond, null_safe)

    def condition(self) -> Column:
        if self.op == "eq":
            return F.col(self.col) == F.lit(self.value)
        if self.op == "in":
            return is_in(self.col, self.value)
        if self.op == "expr":
            return self.cond
        raise ValueError(f"unknown rule op {self.op!r}")

    @property
    def null_safe(self) -> bool:
        return self.op == "in" or self.null_safe_flag


def score_expr(rules: list[Rule], base: float = 1.0, floor_at: float | None = 0.0,
               floor_to: float = 1.0) -> Column:
    total = F.lit(float(base))
    guard = None
    for r in rules:
        c = r.condition()
        total = total + F.when(c, F.lit(float(r.delta))).otherwise(F.lit(0.0))
        if not r.null_safe:
            guard = c.isNull() if guard is None else (guard | c.isNull())
    score = total if guard is None else F.when(~guard, total)
    if floor_at is not None:
        # Same as if_else(score <= a, b, score): a null score fails the test and stays null.
        score = F.when(score <= F.lit(float(floor_at)), F.lit(float(floor_to))).otherwise(score)
    return score
