"""Spelling variants: words that differ by one letter are grouped under the common form.

Words are counted over all texts.  Two words are near if one inserted, deleted or replaced
letter turns one into the other.  A word's form is its most frequent near word, if that is
``DOMINANCE`` times as frequent; its root is the end of the chain of forms.

Near words are found by pivotal grams.  All bigrams are ordered, rare ones first.  A word's
prefix is its three rarest bigrams (with all that are the same as the third); two of them
that do not overlap, of least total frequency, are its pivots, chosen by dynamic programming
over the prefix.  One edit destroys at most one of the two, and of two near words the one whose
prefix ends earlier in the order has its surviving pivot in the other's prefix.  So the
pivots of each word are looked up in the prefixes of the others, with position limits: equal
lengths leave a gram in its place, one letter more moves it by 0 or 1.  Candidates are
verified by their edit distance.

There are at most 8,100 bigrams (90 letters), so their frequencies are broadcast; postings and
candidates are joined by (gram, place, length).  A posting list of more than ``BLOCK`` words is
dealt over blocks and its pivots are sent to each block, so no task holds a hot list.  There
is no cap: every near pair is found.

Defined results: a null or empty text has no words; a null id counts as an empty one;
repeated rows count again.  Among equally frequent near words the first in code-point order
is the form.  An empty table has no words.  Only the id and the text are read, so other
columns do not matter, whatever their names.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_checked
from ..operators.skew import lookup
from .common import cut

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, DOMINANCE = 6, 5, 5
SLIPS = 199            # one run of so many, by hash, has lost a letter
BLOCK = 4096           # words of a posting list that meet the list's pivots in one place
PIVOTS = 2             # one more than the edits that a near word is away
PREFIX = 2 * (PIVOTS - 1) + 1     # bigrams of which PIVOTS do not overlap


def slipped(run: Column, row_id: Column) -> Column:
    """The run, without one letter where the hash of id and run says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(h, F.length(run)).cast("int")
    short = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % SLIPS == 0, short).otherwise(run)


def word_frequencies(docs: DataFrame, text: str = "text", row_id: str = "doc_id", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least ``least`` times in whole texts.  Shorter runs
    cannot become a word, so the pattern passes them over."""
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))
    runs = F.translate(F.array_join(runs, " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = (docs.select(F.col(row_id).alias("id"), F.explode(F.split(runs, " ")).alias("run")).filter("run <> ''")
             .select(slipped(F.col("run"), F.col("id")).alias("word")))
    return (words.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least))


def choose_pivots(prefix: list[tuple[int, int, int]], pivots: int = PIVOTS) -> list[tuple[int, int, int]]:
    """Of bigrams (place, rank, frequency) in order of place, ``pivots`` that do not overlap
    with the least total frequency.  best[i]: the cheapest choice among the first i."""
    best: list[tuple[int, list] | None] = [(0, [])] * (len(prefix) + 1)
    for _ in range(pivots):
        grown: list[tuple[int, list] | None] = [None]
        free = 0                       # how many grams end before the present one begins
        for i, gram in enumerate(prefix):
            while prefix[free][0] <= gram[0] - 2:
                free += 1
            take = best[free] and (best[free][0] + gram[2], best[free][1] + [gram])
            grown.append(min((x for x in (grown[-1], take) if x), key=lambda x: x[0], default=None))
        best = grown
    return best[-1][1] if best[-1] else []


def signature(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
    """(rank of the prefix's last gram, prefix, pivots) of a word; a posting is (rank, place).
    ``order``: rank and frequency by bigram."""
    grams = [(i, *order[word[i:i + 2]]) for i in range(len(word) - 1)]
    last = sorted(g[1] for g in grams)[PREFIX - 1]
    prefix = [g for g in grams if g[1] <= last]
    return last, [(r, i) for i, r, _ in prefix], [(r, i) for i, r, _ in choose_pivots(prefix)]


POSTING = "array<struct<gram:int,place:int>>"


def signatures(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with ``size``, ``last``, ``prefix`` and ``pivots``."""
    grams = F.array_distinct(F.regexp_extract_all("word", F.lit("(?s)(?=(..))"), F.lit(1)))
    counted = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    # at most 90 * 90 rows: pairs of the letters that a word can have
    order = {r["gram"]: (k, r["n"]) for k, r in enumerate(sorted(counted, key=lambda r: (r["n"], r["gram"])))}
    shared = words.sparkSession.sparkContext.broadcast(order)

    @F.arrow_udf(f"struct<last:int,prefix:{POSTING},pivots:{POSTING}>")
    def sign(column: pa.Array) -> pa.Array:
        posting = pa.list_(pa.struct([("gram", pa.int32()), ("place", pa.int32())]))
        out = [signature(w, shared.value) for w in column.to_pylist()]
        as_rows = [[[{"gram": g, "place": p} for g, p in x] for x in col] for col in ([o[1] for o in out], [o[2] for o in out])]
        return pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[pa.array(c, posting) for c in as_rows]],
                                          names=["last", "prefix", "pivots"])

    return words.withColumn("s", sign("word")).select("word", "n", F.length("word").alias("size"), "s.last", "s.prefix", "s.pivots")


# how a word's pivot can stand in a near word: letters more, and places further on
SHIFTS = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all near words of (word, n), each pair both ways."""
    signed = cut(signatures(words))
    key = ["gram", "place", "size"]
    prefix = signed.select("word", "n", "last", "size", F.explode("prefix").alias("g")).select("word", "n", "last", "size", "g.gram", "g.place")
    long = (prefix.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > BLOCK)
            .select(*key, F.ceil(F.col("__n") / BLOCK).cast("int").alias("blocks")))
    long = broadcast_checked(cut(long))[0]
    blocks = F.coalesce("blocks", F.lit(1))
    prefix = prefix.join(long, key, "left").withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int")).drop("blocks")
    shifts = F.array(*[F.struct(F.lit(more).alias("more"), F.lit(on).alias("on")) for more, on in SHIFTS])
    pivot = (signed.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("last").alias("other_last"), "size",
                           F.explode("pivots").alias("g"))
             .withColumn("s", F.explode(shifts))
             .select("other", "other_n", "other_last", "g.gram", (F.col("g.place") + F.col("s.on")).alias("place"),
                     (F.col("size") + F.col("s.more")).alias("size"))
             .filter("place >= 0").join(long, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks"))
    found = (prefix.join(pivot, [*key, "block"])
             .filter("other_last <= last and word <> other").filter(F.levenshtein("word", "other", 1) == 1)
             .select("word", "n", "other", "other_n"))
    turned = found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.unionByName(turned).distinct()


def chain_ends(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of (word, form): the end of each chain, by pointer doubling.  A form is
    ``DOMINANCE`` times as frequent as its word, so with a largest count of ``most`` a chain
    has at most log(most) steps."""
    steps = max(1, int(math.log(max(1, most / LEAST_COUNT), DOMINANCE)) + 1)
    ends = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps))):
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("far"))
        ends = cut(lookup(ends, "root", further).select("word", F.coalesce("far", "root").alias("root")))
    return ends


def spelling_variants(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of at least ``LEAST_LETTERS`` letters
    and ``LEAST_COUNT`` occurrences."""
    words = cut(word_frequencies(docs, text, row_id))
    near = near_pairs(words)
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    near = cut(near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), best)
               .select("word", "n_near", F.when(-F.col("best.n") >= DOMINANCE * F.col("n"), F.struct(
                   F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))).alias("f"))
               .select("word", "n_near", "f.form", "f.form_n"))
    most = words.agg(F.max("n")).first()[0] or 0
    ends = chain_ends(near.filter("form is not null").select("word", "form"), most)
    return (words.join(near, "word", "left").join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
