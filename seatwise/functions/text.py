"""Text functions with the semantics of the intake scripts, as JVM expressions.

Differences between regex engines are handled here once:
* white space includes Unicode separators (the no-break space is one),
* "replace" means the FIRST match, "replace_all" every match,
* wrapping is greedy at a width or balanced (both agree on the codebook labels).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s alone misses U+00A0 and the other Unicode space separators.
WHITESPACE_RUN = r"[\s\p{Z}]+"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _literal_replacement(rep: str) -> str:
    """Escape a plain replacement text for Java's ``Matcher.replaceAll``."""
    return rep.replace("\\", "\\\\").replace("$", "\\$")


def squish(col) -> Column:
    """Trim both ends and collapse inner white-space runs to one space."""
    return F.trim(F.regexp_replace(_c(col), WHITESPACE_RUN, " "))


def remove_all(col, pattern: str) -> Column:
    """Remove every match of ``pattern``."""
    return F.regexp_replace(_c(col), pattern, "")


def replace_all(col, pattern: str, replacement: str) -> Column:
    """Replace every match of ``pattern`` with the plain text ``replacement``."""
    return F.regexp_replace(_c(col), pattern, _literal_replacement(replacement))


def replace_first(col, pattern: str, replacement: str) -> Column:
    """Replace only the first match of ``pattern`` (Spark's own replaces all).

    Anchored at the start with a lazy prefix, so the engine finds the leftmost match
    exactly once; ``(?s)`` lets the prefix cross line breaks.
    """
    return F.regexp_replace(_c(col), f"(?s)^(.*?)(?:{pattern})",
                            "$1" + _literal_replacement(replacement))


def replace_each_first(col, pairs: Iterable[tuple[str, str]]) -> Column:
    """Apply a list of first-match replacements in order."""
    out = _c(col)
    for pat, rep in pairs:
        out = replace_first(out, pat, rep)
    return out


def wrap(col, width: int) -> Column:
    """Greedy word wrap: lines of at most ``width`` characters joined by ``\\n``.

    White space is squished first.  A word longer than ``width`` stays whole.
    """
    if int(width) < 1:
        raise ValueError("width must be >= 1")
    s = squish(col)
    wrapped = F.regexp_replace(s, f"(.{{1,{int(width)}}})( +|$)", "$1\n")
    return F.regexp_replace(wrapped, "\n+$", "")


def wrap_balanced(col, width: int) -> Column:
    """Word wrap with the least raggedness: lines of at most ``width`` characters joined by
    ``\\n`` such that the squared free space, summed over all lines but the last, is least.

    White space is squished first.  A word longer than ``width`` is a line of its own and
    costs nothing.  Of equally good breaks the one with the longest last line is taken, then
    the longest last line before it, and so on.

    Dynamic programming in the JVM: word by word, the best layout that ends there is chosen
    among those that end up to one line earlier.  Only these are kept, so a long text costs
    time and memory in proportion to its words.
    """
    width = int(width)
    if width < 1:
        raise ValueError("width must be >= 1")
    s = squish(col)
    most = (width + 1) // 2       # words that fit on a line
    # layouts of all words but the last 0, 1, 2, ... ones
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("text"))).cast("array<struct<cost:bigint,text:string>>")

    def place(words, layouts, j):
        def with_line(k):
            line, before = F.array_join(F.slice(words, j - k + 1, k), " "), F.element_at(layouts, k)
            free = (F.lit(width) - F.length(line)).cast("bigint")
            cost = F.when((j == F.size(words)) | (free < 0), F.lit(0).cast("bigint")).otherwise(free * free)
            text = F.concat(before["text"], F.when(j > k, F.lit("\n")).otherwise(F.lit("")), line)
            return F.when((free >= 0) | (k == 1), F.struct((before["cost"] + cost).alias("cost"), (-k).alias("k"), text.alias("text")))
        best = F.array_min(F.array_compact(F.transform(F.sequence(F.lit(1), F.size(layouts)), with_line)))
        return F.slice(F.concat(F.array(F.struct(best["cost"].alias("cost"), best["text"].alias("text"))), layouts), 1, most)

    def lay_out(words):
        return F.aggregate(F.sequence(F.lit(1), F.size(words)), start, lambda layouts, j: place(words, layouts, j),
                           lambda layouts: F.element_at(layouts, 1)["text"])

    # the words are the variable of a one-element transform, so a text is split once and not per step
    return F.when(s.isNotNull(), F.element_at(F.transform(F.array(F.split(s, " ")), lay_out), 1))


def title_case(col) -> Column:
    """Upper-case the first letter of each space-separated word, lower the rest.

    ``_`` does not split words (``costa_rica`` -> ``Costa_rica``).
    """
    return F.initcap(_c(col))


def percent_label(col, digits: int = 1) -> Column:
    """Share in [0, 1] as a percent label, e.g. ``0.1234`` -> ``12.3%``.

    Rounded first with ties to even (as R's ``round`` does for the labeller), so
    every printf-style formatter then prints the same digits.  A null share stays null.
    """
    d = int(digits)
    c = _c(col)
    return F.when(c.isNotNull(), F.format_string(f"%.{d}f%%", F.bround(c * 100.0, d)))


def slug(col) -> Column:
    """Label -> stored code: lower case, runs of anything but ``[a-z0-9]`` to ``_``,
    trimmed of ``_`` (``México`` -> ``m_xico``, ``Sí`` -> ``s``)."""
    return F.btrim(F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]+", "_"), F.lit("_"))
