"""Benchmark decontamination by MinHash containment search.

A document is contaminated by a test item when it holds at least ``THRESHOLD`` of the
item's five-word shingles.  Documents are far longer than items, so the Jaccard
similarity of the two says nothing and a MinHash sketch of the document would have to
grow with it.  Containment is searched instead with sketches of the items: the
``SKETCH`` smallest hash values of an item are a uniform sample of its shingles, and the
share of them that a document holds estimates the containment, whatever the document's
length.

Items are partitioned by size, as the same sketch means something else at each: a partition
has its least size, its sketch length and its least hits (``PARTITIONS``).  In the first the
sketch is the whole item and the threshold applies exactly.  In the others a document is a
candidate from so many hits on that an item at the threshold is missed with a probability
below ``MISS``; the larger items, which long documents share more chance shingles with,
have longer sketches.  A document searches only the partitions it can reach: one of m shingles
holds no item of more than m / threshold.  The partition is part of the join key.

Documents are read once.  A bitmap of fixed size (8 MiB, whatever the number of items)
tells which of their shingles may be in a sketch, and in which partition's; those that may
are joined with the sketches by Spark, with salted keys.  Candidates are verified by exact
containment of the shingles as words, not as hashes.

Words are runs of letters and digits in lower case.  Defined results: a text of one to
four words has one shingle, all its words, so so short an item is found only in a
document of the same words; items and documents without words, or null, match nothing.  Null ids are ids like any other.  Repeated
documents are each reported; repeated items (same id) are one item if the texts agree,
and are searched one by one if not.  Empty tables give no rows.  Other columns pass
through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, LongType

from .common import cut, free_name
from .frequencies import bitmap, flagged, text_shingles
from .textcore import slices

K = 5                 # words of a shingle
THRESHOLD = 0.8       # share of an item's shingles that makes a document contaminated
PARTITIONS = ((1, 24), (25, 24), (65, 32), (257, 48))      # least shingles of an item, hash values kept of it
SKETCH = PARTITIONS[0][1]
MISS = 1e-6           # accepted probability to miss an item at the threshold
SALTS = 16            # a popular item's rows are dealt over so many keys


def least_hits(n: int, threshold: float = THRESHOLD, miss: float = MISS, sketch: int = SKETCH) -> int:
    """Sketch hits from which on a document is a candidate for an item of n shingles."""
    if n <= sketch:
        return max(1, int(np.ceil(threshold * n - 1e-9)))
    p, below, hits = (1 - threshold) ** sketch, 0.0, 0
    while below + p <= miss:
        below += p
        p *= (sketch - hits) / (hits + 1) * threshold / (1 - threshold)
        hits += 1
    return max(1, hits)


def _lists(values: np.ndarray, per: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def keyed(h, part: int):
    """Hash values as they are marked for a partition in the bitmap."""
    return h ^ np.uint64(0x9E3779B97F4A7C15 * (part + 1) % 2 ** 64)


@F.arrow_udf(ArrayType(LongType()))
def _sketch_all(texts: pa.Array) -> pa.Array:
    out = []
    for _, part in slices(texts):
        h, of, _ = text_shingles(part, K)
        out.append(_lists(h, np.bincount(of, minlength=len(part))))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))


def item_sketches(items: DataFrame, item_id: str = "item_id", text: str = "text", threshold: float = THRESHOLD,
                  sketch: int = SKETCH) -> DataFrame:
    """One row per item and sketch value: item (its key), hash, n (its shingles) and least
    (hits that make a candidate)."""
    body = F.col(text).cast("string")
    i = items.select(F.struct(F.col(item_id).alias("id"), F.xxhash64(body).alias("t")).alias("item"),
                     _sketch_all(body).alias("all")).filter(F.size("all") > 0).dropDuplicates(["item"])
    n = F.size("all")
    needed = F.element_at(F.array(*[F.lit(least_hits(k, threshold, sketch=sketch)) for k in range(1, sketch + 2)]),
                          F.least(n, F.lit(sketch + 1)))
    return i.select("item", n.alias("n"), needed.alias("least"),
                    F.explode(F.slice(F.sort_array("all"), 1, sketch)).alias("hash"))


def partitioned_sketches(items: DataFrame, item_id: str = "item_id", text: str = "text",
                         threshold: float = THRESHOLD) -> DataFrame:
    """The sketches of every size partition, each with its own length, and ``part``."""
    out = None
    for p, (least, kept) in enumerate(PARTITIONS):
        below = PARTITIONS[p + 1][0] if p + 1 < len(PARTITIONS) else 2 ** 31
        one = (item_sketches(items, item_id, text, threshold, kept)
               .filter((F.col("n") >= least) & (F.col("n") < below)).withColumn("part", F.lit(p)))
        out = one if out is None else out.unionByName(one)
    return out


def _marks(sketches: DataFrame) -> DataFrame:
    """The bitmap's numbers: each sketch value as it is, and as its partition marks it."""
    mark = F.element_at(F.array(*[F.lit(int(keyed(np.uint64(0), p).astype(np.int64))) for p in range(len(PARTITIONS))]),
                        F.col("part") + 1)
    return sketches.select(F.explode(F.array(F.col("hash"), F.col("hash").bitwiseXOR(mark))))


_HITS = pa.list_(pa.struct([("part", pa.int32()), ("hash", pa.int64())]))


def _hits(bits, threshold):
    @F.arrow_udf(from_arrow_type(_HITS))
    def hits(texts: pa.Array) -> pa.Array:
        out = []
        for _, piece in slices(texts):
            h, of, _ = text_shingles(piece, K)
            reach = np.bincount(of, minlength=len(piece)) / threshold + 1e-9       # shingles of the largest item it can hold
            maybe = flagged(bits.value, h)
            h, of = h[maybe], of[maybe]
            found = []
            for p, (least, _) in enumerate(PARTITIONS):
                at = np.flatnonzero(flagged(bits.value, keyed(h, p)) & (reach[of] >= least))
                found.append((of[at], np.full(len(at), p, np.int32), h[at]))
            of, part, h = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(of, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(piece)))]).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(part[order]), pa.array(h[order].astype(np.int64))], names=["part", "hash"])
            out.append(pa.ListArray.from_arrays(pa.array(offsets), rows))
        return pa.concat_arrays(out).cast(_HITS) if out else pa.array([], _HITS)
    return hits


_TOKEN = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")   # as NON_ALNUM separates


def shingle_set(text: str) -> set[tuple[str, ...]]:
    """The distinct shingles of a text as words."""
    w = _TOKEN.findall(text.lower())
    return {tuple(w[i:i + K]) for i in range(max(1, len(w) - K + 1))} if w else set()


_SHARED = pa.struct([("n", pa.int64()), ("shared", pa.int64())])


@F.arrow_udf(from_arrow_type(_SHARED))
def _contained(texts: pa.Array, items: pa.Array) -> pa.Array:
    out, last, held = [], None, set()
    for text, item in zip(texts, items):
        if text != last:
            last, held = text, shingle_set(text.as_py())
        wanted = shingle_set(item.as_py())
        out.append({"n": len(wanted), "shared": len(wanted & held)})
    return pa.array(out, type=_SHARED)


def find_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Contaminated pairs: doc (a key: id and text hash), item_id, item_shingles, shared and
    containment, verified."""
    spark = docs.sparkSession
    sketches = cut(partitioned_sketches(items, item_id, item_text, threshold))
    bits = spark.sparkContext.broadcast(bitmap(_marks(sketches)))
    body = F.col(text).cast("string")
    # the only pass over the documents: what has no possible hit ends here
    touched = cut(docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(body).alias("t")).alias("doc"), body.alias("text"))
                  .withColumn("hits", _hits(bits, threshold)("text")).filter(F.size("hits") > 0))
    # a popular item's rows are dealt over SALTS keys, in the search and in the verification
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    hits = touched.select("doc", salt, F.inline("hits")).distinct()
    candidates = (hits.join(sketches.select("*", salts), ["part", "hash", "salt"])
                  .groupBy("doc", "salt", "item", "least").agg(F.count("*").alias("hits"))
                  .filter(F.col("hits") >= F.col("least")).select("doc", "salt", "item"))
    body = F.col(item_text).cast("string")
    wanted = items.select(F.struct(F.col(item_id).alias("id"), F.xxhash64(body).alias("t")).alias("item"),
                          body.alias("item_text")).dropDuplicates(["item"]).select("*", salts)
    pairs = (candidates.join(wanted, ["item", "salt"]).join(touched.select("doc", "text").dropDuplicates(["doc"]), "doc")
             .withColumn("c", _contained("text", "item_text")))
    return (pairs.select("doc", F.col("item")["id"].alias("item_id"), F.col("c")["n"].alias("item_shingles"),
                         F.col("c")["shared"].alias("shared"), (F.col("c")["shared"] / F.col("c")["n"]).alias("containment"))
            .filter(F.col("containment") >= threshold))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` without the contaminated ones."""
    key, = free_name(docs, "doc_key")
    found = find_contaminated(docs, items, doc_id, text, **kw).select(F.col("doc").alias(key)).distinct()
    keyed = docs.withColumn(key, F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("t")))
    return keyed.join(found, key, "left_anti").drop(key)
