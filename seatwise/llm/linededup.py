"""Line de-duplication by an exact set-similarity join.

Lines of all documents are compared as sets of five-word shingles.  A line is removed
when an earlier line (by document id, then line number) is the same set, or has a Jaccard
similarity of at least ``THRESHOLD`` with it, whether that earlier line is removed itself
or not.

The join is exact.  A line's tokens are ordered by rarity (document frequency over all
documents, in a table of fixed size, then hash).  Two lines of n and m tokens that reach
the threshold share one of the first ``n - ceil(t n) + 1`` tokens of the one and of the
first ``m - ceil(t m) + 1`` of the other (prefix filter); their sizes differ by at most
the factor t (length filter); and the tokens after the shared one must still suffice for
the overlap (positional filter).  Pairs that pass are verified on the words themselves.
The prefix tokens are shuffled once, by token; posting lists of one set are dropped where
they arrive, and only lines in the others, and of those only the ones in a pair, move on.

Equal sets are one class, removed but for the first line.  A token that holds a large
share of all lines is handled in rounds (see ``links``): leaders of its posting list are
compared with the lines that have no earlier match yet.  Most lines of a large group are
settled by the first leaders; the last round compares all that is left.

Words are runs of letters and digits in lower case; lines end at a line feed.  Defined
results: lines without a word are neither compared nor removed; a line of one to four
words is one token, so only equal lines match it; null and empty texts have no lines and
stay.  Rows with equal id and text are the same document and get the same result.
Documents with a null id come last.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import BooleanType, DoubleType, StringType

from ..session import scratch_path
from .common import cut, free_name, release, remove
from .frequencies import BITS, bitmap, flagged, shingle_frequencies
from .links import FIRST, GROWTH, leads
from .textcore import NON_ALNUM, Texts, mix, shingle_hashes, slices

THRESHOLD = 0.8
K = 5
_U = np.uint64
_TOKEN_BITS, _LEVEL_BITS, _LINE_BITS = 46, 6, 12      # of a token's sort key

_LINES = pa.list_(pa.struct([("line_no", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()),
                             ("prefix", pa.list_(pa.int64()))]))

_NUMBERED = pa.list_(pa.struct([("line_no", pa.int32()), ("line", pa.string())]))


def rarity_levels(frequencies: np.ndarray) -> np.ndarray:
    """Rarity level (0: rarest) of each bucket: about four levels for each doubling."""
    return np.minimum(4 * np.log2(np.maximum(frequencies, 1)), 2 ** _LEVEL_BITS - 1).astype(np.uint64)


def prefix_length(n: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _line_table(part: pa.Array, level: np.ndarray, threshold: float):
    """Lines with a word of a slice of texts: text, line number, two set hashes, size and
    the prefix tokens (flat, with their count per line)."""
    t = Texts(part, lower=True)
    start, end, owner = t.pieces(NON_ALNUM)
    breaks = np.flatnonzero(t.bytes == 10)
    # over all texts: the line feeds and ends of texts up to each word
    passed = np.concatenate([np.searchsorted(start, breaks), np.searchsorted(start, t.off[1:])])
    line = np.cumsum(np.bincount(passed, minlength=len(start) + 1))[:len(start)]
    first = np.flatnonzero(np.diff(line, prepend=-1))
    number = np.searchsorted(breaks, start[first]) - np.searchsorted(breaks, t.off[:-1])[owner[first]]
    text = owner[first]
    index = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(line)]])))
    h, of = shingle_hashes(t.hashes(start, end), index, len(first), K)
    # one sort key: line, rarity, token; lines are taken in blocks that fit its line bits
    keys = []
    bounds = np.searchsorted(of, np.arange(0, len(first) + 2 ** _LINE_BITS, 2 ** _LINE_BITS))
    for a, b in zip(bounds[:-1], bounds[1:]):
        token = h[a:b] >> _U(64 - _TOKEN_BITS)
        rank = level[(h[a:b] >> _U(64 - BITS)).astype(np.int64)]
        key = (of[a:b].astype(np.uint64) << _U(64 - _LINE_BITS)) | (rank << _U(_TOKEN_BITS)) | token
        key.sort()                       # np.unique finds integers by a hash table, which takes longer
        keys.append(key[np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))] if len(key) else key)
    n, token = [], []
    for i, key in enumerate(keys):
        n.append(np.bincount((key >> _U(64 - _LINE_BITS)).astype(np.int64), minlength=min(2 ** _LINE_BITS, len(first) - i * 2 ** _LINE_BITS)))
        token.append(key & _U(2 ** (_LEVEL_BITS + _TOKEN_BITS) - 1))
    n = np.concatenate(n) if n else np.zeros(0, dtype=np.int64)
    token = np.concatenate(token) if token else np.zeros(0, dtype=np.uint64)
    if not len(n):
        return text, number, n.astype(np.uint64), n.astype(np.uint64), n, token, n
    at = np.concatenate([[0], np.cumsum(n)])[:-1]
    k1 = np.add.reduceat(mix(token + _U(1)), at)
    k2 = np.add.reduceat(mix(token ^ _U(0x9E3779B97F4A7C15)), at)
    p = prefix_length(n, threshold)
    place = np.arange(len(token)) - np.repeat(at, n)
    return text, number, k1, k2, n, token[place < np.repeat(p, n)], p


def first_of_equals(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Whether a pair of hashes is the first of its equals."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(order), dtype=bool)
    new[order[1:]] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return new


def _lines(level, threshold):
    """Lines of texts.  Of equal sets in a slice only the first has its prefix tokens: a line
    that very many texts hold has few rows in its posting lists."""
    @F.arrow_udf(from_arrow_type(_LINES))
    def lines(texts: pa.Array) -> pa.Array:
        out = []
        for _, part in slices(texts, 64):
            text, number, k1, k2, n, prefix, p = _line_table(part, level.value, threshold)
            new = first_of_equals(k1, k2)
            prefix, p = prefix[np.repeat(new, p)], np.where(new, p, 0)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p)]).astype(np.int32)),
                                              pa.array(prefix.view(np.int64)))
            row = pa.StructArray.from_arrays(
                [pa.array(number.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                 pa.array(n.astype(np.int32)), tokens], ["line_no", "k1", "k2", "n", "prefix"])
            per = np.bincount(text, minlength=len(part))
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), row).cast(_LINES))
        return pa.concat_arrays(out) if out else pa.array([], _LINES)
    return lines


_BLANK = {i: " " for i in np.flatnonzero(NON_ALNUM).tolist()}


def line_set(line: str) -> set[tuple[str, ...]]:
    w = [x for x in line.lower().translate(_BLANK).split(" ") if x]
    return set(zip(*(w[i:] for i in range(K)))) if len(w) >= K else {tuple(w)} if w else set()


def _numbered(values: pa.Array) -> np.ndarray:
    """A number for each value: equal values, and no others, have the same."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _line_sets(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sets of ``line_set`` for many lines: shingle numbers, line by line, and their count
    per line.  Equal shingles, and no others, have the same number, as their words are compared."""
    t = Texts(pa.array([x.lower() for x in lines.to_pylist()], pa.large_string()))
    start, end, owner = t.pieces(NON_ALNUM)
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    letters = t.bytes[~NON_ALNUM[t.bytes]]                # all words, one after the other
    number = _numbered(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)]))
    per = np.bincount(owner, minlength=len(t))
    size = np.where(per > 0, np.maximum(per, K), 0)       # shorter lines are filled up with what is no word
    first, place = np.cumsum(size) - size, np.arange(len(owner)) - (np.cumsum(per) - per)[owner]
    blank = len(number)
    word = np.full(int(size.sum()), blank, dtype=np.int64)
    word[first[owner] + place] = number
    n = np.maximum(size - K + 1, 0)
    of = np.repeat(np.arange(len(t)), n)
    at = first[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
    shingle = word[at]
    for j in range(1, K):
        shingle = _numbered(pa.array(shingle * (blank + 1) + word[at + j]))
    key = np.sort(of * (len(of) + 1) + shingle)
    key = key[np.flatnonzero(np.diff(key, prepend=-1))]
    of = key // (len(at) + 1)
    return key - of * (len(at) + 1), np.bincount(of, minlength=len(t))


def jaccards(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaccard similarity of the sets of two columns of lines.  A line of many pairs is read once."""
    both = pa.concat_arrays([a, b]).dictionary_encode()
    x, y = np.split(both.indices.to_numpy(zero_copy_only=False).astype(np.int64), 2)
    shingle, n = _line_sets(both.dictionary)
    first, found = np.cumsum(n) - n, []
    for side in (x, y):
        pair = np.repeat(np.arange(len(side)), n[side])
        at = first[side][pair] + np.arange(len(pair)) - (np.cumsum(n[side]) - n[side])[pair]
        found.append(pair * (len(shingle) + 1) + shingle[at])
    key = np.sort(np.concatenate(found))
    twice = key[1:][key[1:] == key[:-1]]
    shared = np.bincount(twice // (len(shingle) + 1), minlength=len(x))
    return shared / np.maximum(1, n[x] + n[y] - shared)


@F.arrow_udf(DoubleType())
def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    out = [jaccards(part, b.slice(at, len(part))) for at, part in slices(a, 4096, beside=b)]
    return pa.array(np.concatenate(out) if out else [], pa.float64())


def _lines_in(flags):
    @F.arrow_udf(from_arrow_type(_NUMBERED))
    def some(texts: pa.Array, docs: pa.Array) -> pa.Array:
        """Number and text of the lines that may be in a bitmap of ``document hash ^ number``."""
        breaks = pc.count_substring(texts, "\n")
        n = np.where(texts.is_null(), 0, pc.fill_null(breaks, 0).to_numpy(zero_copy_only=False) + 1)
        first = np.concatenate([[0], np.cumsum(n)])
        number = np.arange(first[-1]) - np.repeat(first[:-1], n)
        hit = np.flatnonzero(flagged(flags.value, np.repeat(docs.to_numpy(zero_copy_only=False), n) ^ number))
        to, number, lines = np.searchsorted(hit, first), number[hit], []
        for i in np.flatnonzero(np.diff(to)):
            text = texts[i].as_py().split("\n")
            lines += [text[k] for k in number[to[i]:to[i + 1]]]
        row = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), pa.array(lines, pa.string())], ["line_no", "line"])
        return pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), row)
    return some


def _in(flags):
    @F.arrow_udf(BooleanType())
    def test(numbers: pa.Array) -> pa.Array:
        return pa.array(flagged(flags.value, numbers.to_numpy(zero_copy_only=False)))
    return test


def in_several(batches):
    """Of rows (bucket, id, size, pos) sorted by bucket, those of buckets that have two or more ids;
    copies of a bucket's first row are left out.  Holds a batch and that row, whatever a bucket's size.
    ``postings_of`` finds the same by a window, as handing single tokens to Python takes longer."""
    held, given = None, False             # the first row of the last bucket, and whether it was given
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        bucket, id_ = cols[:2]
        if not len(bucket):
            continue
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        keep = id_ != np.repeat(id_[start], np.diff(np.append(start, len(bucket))))
        several = np.logical_or.reduceat(keep, start)
        keep[start] = several
        keep[0] &= not given
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=["bucket", "id", "size", "pos"])
        given = bool(several[-1]) or given and len(start) == 1
        held = [c[start[-1]:start[-1] + 1] for c in cols]


def postings_of(lines: DataFrame) -> DataFrame:
    """Posting lists (bucket: the token, id, n, size, pos) of two or more nodes.  ``lines``: id,
    n (tokens) and prefix.  The tokens move once; lists of one node, most of them, end there."""
    tokens = lines.select("id", F.col("n").alias("size"), F.posexplode("prefix").alias("pos", "bucket"))
    of_bucket = Window.partitionBy("bucket")
    several = tokens.withColumn("lo", F.min("id").over(of_bucket)).withColumn("hi", F.max("id").over(of_bucket)).filter("lo != hi")
    nodes = several.groupBy("bucket", "id").agg(F.first("size").alias("size"), F.min("pos").alias("pos"))
    return cut(nodes.withColumn("n", F.count("*").over(of_bucket)).select("bucket", "id", "n", "size", "pos"))


def duplicate_lines(docs: DataFrame, row_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per line with a word: doc (key: id and text hash), line_no, and reason: null
    for lines that stay, ``copy`` (of an equal set) or ``near`` for those removed."""
    spark = docs.sparkSession
    frequencies, _ = shingle_frequencies(docs, text, K)
    level = spark.sparkContext.broadcast(rarity_levels(frequencies))
    body = F.col(text).cast("string")
    doc = F.struct(F.col(row_id).alias("id"), F.xxhash64(body).alias("t"))
    # all lines, without their texts, as a table that is read several times
    path = scratch_path(spark, "lines")
    # equal sets are one node; its place is that of its first line
    (docs.select(doc.alias("doc"), _lines(level, threshold)(body).alias("l")).select("doc", F.explode("l").alias("l"))
     .select("doc", "l.line_no", F.xxhash64("l.k1", "l.k2").alias("id"), "l.n", "l.prefix").write.parquet(path))
    lines = spark.read.parquet(path)
    place = F.struct(F.col("doc.id").isNull().alias("o0"), F.col("doc.id").alias("o1"), F.col("doc.t").alias("o2"),
                     F.col("line_no").alias("o3"))
    release(spark)
    postings = postings_of(lines.select("id", "n", "prefix"))
    release(spark)
    # place and text of the nodes that have candidates
    ids = spark.sparkContext.broadcast(bitmap(postings.select("id")))
    wanted = cut(lines.select("id", place.alias("place")).filter(_in(ids)("id")).groupBy("id").agg(F.min("place").alias("place")))
    head = F.struct(F.col("place.o1").alias("id"), F.col("place.o2").alias("t"))
    spots = spark.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64(head).bitwiseXOR(F.col("place.o3").cast("long")))))
    texts = (docs.select(doc.alias("doc"), _lines_in(spots)(body, F.xxhash64(doc)).alias("l")).select("doc", F.explode("l").alias("l"))
             .select("doc", "l.*").select(place.alias("place"), "line"))
    texts = cut(texts.join(wanted, "place").dropDuplicates(["place"]))              # a repeated row has the same lines
    del wanted
    release(spark)

    t, round_, matched, open_ = threshold, 0, None, postings
    while True:
        # leaders may have been removed already: any earlier line counts
        lead = (postings if matched is None else postings.join(live, "bucket", "left_semi")).filter(leads(round_)) \
            .select("bucket", *[F.col(c).alias(f"l_{c}") for c in ("id", "size", "pos")])
        small, large = F.least("size", "l_size"), F.greatest("size", "l_size")
        rest = F.least(F.col("size") - F.col("pos"), F.col("l_size") - F.col("l_pos"))      # tokens from the shared one on
        need = F.ceil(F.lit(t / (1 + t)) * (F.col("size") + F.col("l_size")) - F.lit(1e-9))
        pairs = cut(open_.join(lead, "bucket")
                    .filter((F.col("id") != F.col("l_id")) & (small >= F.lit(t) * large - F.lit(1e-9)) & (rest >= need))
                    .select(F.least("id", "l_id").alias("a"), F.greatest("id", "l_id").alias("b")).distinct())
        # the texts of these pairs: fewer with each round
        paired = spark.sparkContext.broadcast(bitmap(pairs.select(F.explode(F.array("a", "b")))))
        those = texts.filter(_in(paired)("id"))
        side = lambda c: those.select(F.col("id").alias(c), F.col("line").alias(f"line_{c}"), F.col("place").alias(f"place_{c}"))
        found = (pairs.join(side("a"), "a").join(side("b"), "b").filter(_jaccard("line_a", "line_b") >= threshold)
                 .select(F.when(F.col("place_a") > F.col("place_b"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct())
        matched = cut(found if matched is None else matched.unionByName(found).distinct())
        # lines without an earlier match go on in buckets that have members left to lead
        open_ = cut(postings.filter(F.col("n") > FIRST * GROWTH ** round_).join(matched, "id", "left_anti"))
        live = open_.select("bucket").distinct()
        if open_.isEmpty():
            break
        round_ += 1
        del pairs, found, lead, those, side
        release(spark)
    del pairs, found, lead, those, side, postings, open_, live, texts
    release(spark)
    # by line: of a class all but the first line are copies; lines of other classes stay
    lines = lines.select("doc", "line_no", "id", place.alias("own"))
    classes = cut(lines.groupBy("id").agg(F.min("own").alias("place"), F.count("*").alias("n"))
                  .join(matched.withColumn("near", F.lit(True)), "id", "left").filter("n > 1 or near").drop("n"))
    some = spark.sparkContext.broadcast(bitmap(classes.select("id")))
    lines = lines.withColumn("maybe", _in(some)("id"))
    out = (lines.filter("maybe").join(classes, "id", "left")
           .select("doc", "line_no", F.when(F.col("own") != F.col("place"), "copy").when(F.col("near"), "near").alias("reason"))
           .unionByName(lines.filter("not maybe").select("doc", "line_no", F.lit(None).cast("string").alias("reason"))))
    out = cut(out)
    remove(spark, path)
    return out


@F.arrow_udf(StringType())
def _without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    out = []
    for t, r in zip(texts, removed):
        gone = set(r.as_py() or ())
        text = t.as_py()
        out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone and text else text)
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, row_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with the text of the lines that stay."""
    key, gone = free_name(docs, "doc_key", "removed")
    found = (duplicate_lines(docs, row_id, text, **kw).filter("reason is not null").distinct()
             .groupBy(F.col("doc").alias(key)).agg(F.collect_list("line_no").alias(gone)))
    keyed = docs.withColumn(key, F.struct(F.col(row_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("t")))
    return keyed.join(found, key, "left").withColumn(text, _without(F.col(text).cast("string"), gone)).drop(key, gone)


def line_report(docs: DataFrame, row_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row per document (equal id and text: one): doc, n_lines (with a word), n_copies
    and n_near (removed)."""
    doc = F.struct(F.col(row_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("t"))
    found = duplicate_lines(docs, row_id, text, **kw)
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    per_doc = found.groupBy("doc").agg(F.count("*").alias("n_lines"), count(F.col("reason") == "copy").alias("n_copies"),
                                       count(F.col("reason") == "near").alias("n_near"))
    # a repeated row has the same lines with the same reasons, so each count is a multiple of its rows
    return (docs.select(doc.alias("doc")).groupBy("doc").agg(F.count("*").alias("rows")).join(per_doc, "doc", "left")
            .select("doc", *[F.expr(f"coalesce({c} div rows, 0L)").alias(c) for c in ("n_lines", "n_copies", "n_near")]))
