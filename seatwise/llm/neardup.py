"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of its five-word shingles: weight ``(1 + ln tf) * idf``.
The weighted Jaccard similarity of two documents is the sum of the smaller weights over
the sum of the larger ones.  Improved consistent weighted sampling draws one shingle per
hash function so that two documents draw the same one with a probability equal to that
similarity.  The draws are banded; documents that share a band are candidates, and
candidates are verified by their exact weighted Jaccard similarity.

``idf`` is ``ln(N / df)`` scaled to 1 for shingles in up to ``RARE`` of all documents and
never below ``IDF_FLOOR``: it takes weight from boilerplate that many documents share,
but a large group of copies must not lose its similarity because its own text has become
frequent.  Document frequencies are those of hashed shingles over all documents (see
``frequencies``), so the table has the same size at every scale and shares, not counts,
decide.

Documents with equal texts are one node from the start.  The nodes of a band are first
compared with a few of them (the most central one and some by hash), which settles most
of a large group.  Nodes left in different classes are compared by longer sketches
(``SKETCH`` draws) inside tasks, in blocks of bounded size; pairs whose sketches agree in
at least ``SKETCH_AGREE`` of the draws are verified like the others.  So no pairs of a
group become rows unless they are likely links.  With ``ROWS`` draws a band and ``BANDS``
bands a pair at similarity 0.8 shares a band with a probability of 99.9 %, at 0.9 of all
but one in 10^6; a pair at 0.8 fails the sketch test once in 20,000.

Words are runs of letters and digits in lower case.  Defined results: documents without
a word (null, empty, symbols only) match only documents of exactly equal text, null being
equal to null and not to empty; a text of one to four words has one shingle.  A class is
named by the least id in it (null ids last: a class of null ids alone is named null).
Repeated rows are members of one class.  An empty table gives no rows.  Other columns
pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from . import links
from .common import cut, free_name, number_rows, release
from .frequencies import bucket, shingle_frequencies, text_shingles
from .textcore import mix, slices

THRESHOLD = 0.8
BANDS, ROWS = 10, 3
SKETCH, SKETCH_AGREE = 512, 0.73      # 0.8 less four standard deviations of the estimate
RARE = 0.01           # share of documents up to which a shingle has full weight
IDF_FLOOR = 0.5
_U = np.uint64
_LOW24 = _U(2 ** 24 - 1)


def idf_table(frequencies: np.ndarray, n: int) -> np.ndarray:
    """idf of each bucket, between IDF_FLOOR and 1."""
    share = np.maximum(frequencies, 1) / max(n, 1)
    return np.clip(np.log(1 / np.maximum(share, 1e-300)) / np.log(1 / RARE), IDF_FLOOR, 1.0).astype(np.float32)


def weights(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(count)).astype(np.float32) * idf[bucket(h)]


def _uniform(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -24)


def draws(h: np.ndarray, first: np.ndarray, weight: np.ndarray, n_draws: int) -> np.ndarray:
    """One draw per hash function (row) and document (column; its shingles start at
    ``first``): the least value of the sampling, whose bits identify shingle and level."""
    out = np.empty((n_draws, len(first)), dtype=np.float32)
    other = np.flatnonzero(weight != 1)             # most shingles have weight 1, logarithm 0
    log_w = np.log(weight[other])
    for k in range(n_draws):
        x = mix(h ^ mix(np.array([2 * k + 1], dtype=np.uint64)))
        y = mix(x + _U(0x9E3779B97F4A7C15))
        # r and c are Gamma(2, 1): the negative log of a product of two uniforms
        r = -np.log(_uniform(x >> _U(40)) * _uniform((x >> _U(16)) & _LOW24))
        log_c = np.log(-np.log(_uniform(y >> _U(40)) * _uniform((y >> _U(16)) & _LOW24)))
        beta = (((x & _U(0xFFFF)) << _U(8)) | (y & _U(0xFF))).astype(np.float32) * np.float32(2.0 ** -24)
        t = np.zeros(len(other), dtype=np.float32)
        np.floor(log_w / r[other] + beta[other], out=t)
        # ln a = ln c - ln y - r with ln y = r (t - beta)
        a = log_c + r * beta - r
        a[other] -= r[other] * t
        out[k] = np.minimum.reduceat(a, first)
    return out


def _bands(idf):
    @F.arrow_udf(ArrayType(LongType()))
    def bands(texts: pa.Array) -> pa.Array:
        out = []
        for _, part in slices(texts, 64):
            h, of, count = text_shingles(part)
            per = np.bincount(of, minlength=len(part))
            full = per > 0
            keys = np.zeros((int(full.sum()), BANDS), dtype=np.uint64)
            if len(keys):
                first = np.concatenate([[0], np.cumsum(per)])[:-1][full]
                d = draws(h, first, weights(h, count, idf.value), BANDS * ROWS).view(np.uint32).astype(np.uint64)
                for b in range(BANDS):
                    key = np.full(len(keys), b, dtype=np.uint64)
                    for r in range(ROWS):
                        key = mix(key * _U(0x9E3779B97F4A7C15) + d[b * ROWS + r])
                    keys[:, b] = key
            offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))
    return bands


def _sketches(idf):
    @F.arrow_udf(BinaryType())
    def sketch(texts: pa.Array, bands: pa.Array) -> pa.Array:
        """One byte for each of SKETCH draws, by seeds that the bands do not use, and the
        keys of the text's bands."""
        out = []
        for _, part in slices(texts, 64):
            h, of, count = text_shingles(part)
            first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(part)))])[:-1]
            d = draws(mix(h + _U(1)), first, weights(h, count, idf.value), SKETCH).view(np.uint32).astype(np.uint64)
            out += [row.tobytes() for row in (mix(d) >> _U(56)).astype(np.uint8).T]
        keys = bands.flatten().to_numpy().reshape(-1, BANDS)
        return pa.array([s + k.tobytes() for s, k in zip(out, keys)], type=pa.binary())
    return sketch


_PAIRS = ArrayType(StructType([StructField("a", LongType()), StructField("b", LongType())]))


@F.arrow_udf(_PAIRS)
def _alike(buckets: pa.Array, lo: pa.Array, hi: pa.Array, members: pa.Array) -> pa.Array:
    """Pairs of different components, of block lo and block hi, whose sketches agree, each
    in the first band that the two share."""
    least = int(np.ceil(SKETCH_AGREE * SKETCH))
    out = []
    for bucket_, l, h, rows in zip(buckets.to_pylist(), lo.to_pylist(), hi.to_pylist(), members):
        block, ids, comp, sketch = rows.values.flatten()
        k = block.to_numpy()
        ids, comp = ids.to_numpy(), comp.to_numpy()
        s = np.frombuffer(b"".join(sketch.to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        s, keys = s[:, :SKETCH], np.ascontiguousarray(s[:, SKETCH:]).view(np.int64)
        left, right = np.flatnonzero(k == l), np.flatnonzero(k == h)
        found = []
        for i in left:
            other = right[(comp[right] != comp[i]) & ((l != h) | (ids[right] > ids[i]))]
            near = other[(s[other] == s[i]).sum(axis=1) >= least]
            if len(near):
                shared = (keys[near] == keys[i]).argmax(axis=1)          # the first band they share
                near = near[keys[i][shared] == bucket_]
            found += [{"a": int(min(ids[i], ids[j])), "b": int(max(ids[i], ids[j]))} for j in near]
        out.append(found)
    return pa.array(out, type=pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def weighted_jaccard(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Exact similarity of each pair of texts (0 where neither has a word)."""
    out = [np.zeros(0)]
    for at, part in slices(a, beside=b):
        n = len(part)
        sides = []
        for side in (part, b.slice(at, n)):
            h, of, count = text_shingles(side)
            sides.append(((of.astype(np.uint64) << _U(56)) | h, weights(h, count, idf).astype(np.float64)))
        (ka, wa), (kb, wb) = sides
        total = np.bincount((ka >> _U(56)).astype(int), wa, n) + np.bincount((kb >> _U(56)).astype(int), wb, n)
        _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        shared = np.bincount((ka[ia] >> _U(56)).astype(int), np.minimum(wa[ia], wb[ib]), n)
        out.append(np.divide(shared, total - shared, out=np.zeros(n), where=total > 0))
    return np.concatenate(out)


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One narrow row per row of ``docs``: its key (see ``common.number_rows``; ``at``,
    ``nth``), ``row_id``, ``class_id`` (the least id of its class) and ``first`` (whether it
    is the one document of its class that a de-duplication keeps)."""
    spark = docs.sparkSession
    frequencies, n = shingle_frequencies(docs, text)
    idf = spark.sparkContext.broadcast(idf_table(frequencies, n))
    body = F.col(text).cast("string")
    rows = docs.select(F.col(row_id).alias("row_id"), F.struct(F.col(row_id).alias("c0"), F.xxhash64(body).alias("t")).alias("at"),
                       F.md5(body.cast("binary")).alias("md5"), body.alias("text"))
    rows = cut(rows.withColumn("bands", _bands(idf)("text")).drop("text").withColumn("row", F.monotonically_increasing_id()))
    # equal texts are one node, named by one of its rows (null md5: null texts)
    nodes = cut(rows.groupBy("md5").agg(F.min("row").alias("id"), F.first("bands").alias("bands")))
    near = links.in_buckets(nodes.select(F.explode("bands").alias("bucket"), "id"))
    release(spark)
    # the texts of nodes that have candidates at all
    wanted = near.select("id").distinct().join(nodes.select("id", "md5"), "id")
    texts = cut(docs.select(body.alias("text")).withColumn("md5", F.md5(F.col("text").cast("binary")))
                .join(wanted, "md5").groupBy("id").agg(F.first("text").alias("text")))

    @F.arrow_udf(DoubleType())
    def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(weighted_jaccard(a, b, idf.value))

    def verify(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
                .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
        return both.withColumn("similarity", similarity("text_a", "text_b")).filter(F.col("similarity") >= threshold) \
            .select("a", "b", "similarity")

    def sketch(ids: DataFrame) -> DataFrame:
        return (texts.join(ids, "id").join(nodes.select("id", "bands"), "id")
                .select("id", _sketches(idf)("text", "bands").alias("sketch")))

    label = links.group(near, verify, sketch, _alike)
    release(spark)
    named = nodes.select("id", "md5").join(label, "id", "left").select("md5", F.coalesce("component", "id").alias("component"))
    classed = rows.drop("bands").withColumn("m", F.struct("md5")).join(named.withColumn("m", F.struct("md5")).drop("md5"), "m").drop("m")
    # least id of a class, and its first row: aggregated, then joined back
    order = F.struct(F.col("row_id").isNull().alias("o0"), F.col("row_id").alias("o1"), F.col("row").alias("o2"))
    least = classed.groupBy("component").agg(F.min(order).alias("least"))
    return (classed.join(least, "component").withColumn("class_id", F.col("least")["o1"])
            .withColumn("first", F.col("row") == F.col("least")["o2"])
            .withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy(~F.col("first"))))
            .select("at", "nth", "row_id", "class_id", "first"))


def deduplicate(docs: DataFrame, row_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each class: the one with the least id."""
    key, nth = free_name(docs, "at", "nth")
    gone = (near_duplicates(docs, row_id, text, **kw).filter(~F.col("first"))
            .select(F.col("at").alias(key), F.col("nth").alias(nth)))
    return number_rows(docs, row_id, text=text, key=key, nth=nth).join(gone, [key, nth], "left_anti").drop(key, nth)
