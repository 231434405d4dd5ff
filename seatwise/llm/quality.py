"""Quality rules: text statistics and cross-document line frequency.

Lines are normalised (lower case, blanks collapsed) and hashed; for every host the
number of distinct documents that hold a line is counted.  A line above the limits is
boilerplate of that host and is removed; a document left with too small a share of its
words is depleted and rejected.  Documents with equal texts count as one document, so
copies of a good document do not make its lines boilerplate (copies are the business of
de-duplication).

The limits do not depend on the size of the corpus: a line is removed when it occurs in
at least ``min_docs`` documents of the host and in at least ``max_share`` of them.  They do
depend on the size of the host: above ``min_docs / max_share`` distinct texts (5,000) the
share rules alone, so a large host keeps lines that a small one would lose.

Defined results: a null or empty text has no words and fails the base rule; a null host
is a host of its own; repeated rows are judged alike; an empty table gives no rows.
Other columns pass through; columns that have the names of results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .common import cut, free_name
from .textcore import BLANKS, Texts, distinct_per_text, shingle_hashes, slices

MIN_WORDS = 50            # fewer words fail the base rule
MAX_REPEAT_PERCENT = 50   # a larger share of words in repeated 3-word windows fails it
MIN_DOCS = 10             # a line in fewer documents of a host is never boilerplate
MAX_SHARE = 0.002         # share of the host's documents from which on it is
MIN_LEFT = 0.5            # share of words that must be left after removal

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_C = np.uint64(0x9E3779B97F4A7C15)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ARROW = pa.struct([(s, pa.int64()) for s in STATS]
                   + [("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())])))])


def _per_text(owner: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights=weight, minlength=n).astype(np.int64)


def _line_of(t: Texts, start: np.ndarray) -> np.ndarray:
    """Number of the line, over all texts, that each position lies in."""
    breaks = np.flatnonzero(t.bytes == 10)
    return np.searchsorted(breaks, start) + np.searchsorted(t.off[1:], start, side="right")


def _repeated_words(t: Texts, start, end, owner) -> np.ndarray:
    word = t.hashes(start, end)
    if len(word) < 3:
        return np.zeros(len(t), dtype=np.int64)
    h, of = shingle_hashes(word, owner, len(t), 3)
    full = np.flatnonzero(owner[2:] == owner[:-2])     # windows of three words of one text
    # texts of one or two words give one shingle, which is no window
    in_long = np.bincount(owner, minlength=len(t))[of] >= 3
    h, of = h[in_long], of[in_long]
    key = (of.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
    value, at, count = distinct_per_text(h, of)
    twice = count >= 2
    repeated = (at[twice].astype(np.uint64) << np.uint64(56)) | value[twice]
    hit = full[np.isin(key, repeated)] if len(repeated) else full[:0]
    covered = np.zeros(len(word), dtype=bool)
    for j in range(3):
        covered[hit + j] = True
    return _per_text(owner[covered], len(t))


def _statistics(column: pa.Array) -> pa.Array:
    t = Texts(column)
    n = len(t)
    start, end, owner = t.pieces(BLANKS)
    data, text_of = t.bytes, np.repeat(np.arange(n), np.diff(t.off))
    point = (data & 0xC0) != 0x80                      # first byte of a code point
    stats = [_per_text(owner, n), _per_text(text_of[point & ~BLANKS[data]], n),
             _per_text(text_of[_SYMBOLS[data]], n)]
    # exact lines that hold a word
    line = _line_of(t, start)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    breaks = np.union1d(np.flatnonzero(data == 10) + 1, t.off[:-1])
    a = breaks[np.searchsorted(breaks, start[first], side="right") - 1]
    stop = np.union1d(np.flatnonzero(data == 10), t.off[1:])
    b = stop[np.searchsorted(stop, start[first], side="right")]
    _, of, count = distinct_per_text(t.hashes(a, b), owner[first])
    stats += [_per_text(of, n, count - 1), _repeated_words(t, start, end, owner)]
    # normalised lines: hash over the lower-case words in order
    low = Texts(column, lower=True)
    start, end, owner = low.pieces(BLANKS)
    line = _line_of(low, start)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(np.concatenate([first, [len(line)]]))
    power = np.cumprod(np.full(int(size.max()) + 1 if len(size) else 1, _C, dtype=np.uint64))
    place = np.arange(len(line)) - np.repeat(first, size)
    h = np.add.reduceat(low.hashes(start, end) * power[place], first) if len(first) else np.zeros(0, dtype=np.uint64)
    per = np.bincount(owner[first], minlength=n)
    lines = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(size.astype(np.int32))], ["line", "words"]))
    return pa.StructArray.from_arrays([*map(pa.array, stats), lines], [*STATS, "lines"])


@F.arrow_udf(from_arrow_type(_ARROW))
def _text_stats(texts: pa.Array) -> pa.Array:
    parts = [_statistics(part) for _, part in slices(texts)]
    return pa.concat_arrays([p.cast(_ARROW) for p in parts]) if parts else pa.array([], type=_ARROW)


def quality_rules(df: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS,
                  max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, drop_text: bool = False) -> DataFrame:
    """``df`` with the five statistics, ``base_failed``, ``n_removed_words`` (words in
    boilerplate lines) and ``kept``; without the text if it is not needed further on."""
    s, h, c, r = free_name(df, "stats", "host_key", "text_key", "row_key")
    keyed = df.drop(*STATS, "base_failed", "n_removed_words", "kept")
    # the text's statistics and lines once; what follows reads them from there
    keyed = cut(keyed.withColumn(s, _text_stats(F.col(text).cast("string")))
                .withColumn(h, F.struct(F.col(host).cast("string").alias("v")))
                .withColumn(c, F.xxhash64(F.col(text).cast("string")))
                .withColumn(r, F.monotonically_increasing_id()).drop(*[text] * drop_text))
    some = keyed.filter(F.size(F.col(s)["lines"]) > 0)
    # copies with equal texts count once per host: distinct (host, text, line)
    per_line = (some.select(h, c, F.explode(F.array_distinct(F.transform(F.col(s)["lines"], lambda x: x["line"]))).alias("line"))
                .groupBy(h, "line", c).agg(F.lit(1).alias("one"))
                .groupBy(h, "line").agg(F.count("one").alias("docs")))
    hosts = some.select(h, c).distinct().groupBy(h).agg(F.count(c).alias("host_docs"))
    common = (per_line.filter(F.col("docs") >= min_docs)
              .join(hosts, h).filter(F.col("docs") >= max_share * F.col("host_docs"))
              .select(h, "line"))
    # a frequent line may be in a third of all rows: its partners are salted
    salts = 16
    lines = (some.select(r, h, F.explode(F.col(s)["lines"]).alias("l"))
             .select(r, h, F.col("l")["line"].alias("line"), F.col("l")["words"].alias("words"))
             .withColumn("salt", F.pmod(F.xxhash64(r), F.lit(salts)).cast("int")))
    common = common.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    removed = (lines.join(common, [h, "line", "salt"]).groupBy(r)
               .agg(F.sum("words").cast("long").alias("n_removed_words")))
    out = keyed.join(removed, r, "left")
    n = F.col(s)["n_words"]
    out = (out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
           .withColumns({x: F.col(s)[x] for x in STATS})
           .withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col(s)["n_repeat_words"] > MAX_REPEAT_PERCENT * n))
           .withColumn("kept", ~F.col("base_failed") & (n - F.col("n_removed_words") >= min_left * n)))
    return out.drop(s, h, c, r)
