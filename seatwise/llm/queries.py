"""One query per operator on the driver tables, and SQL for those that SQL can express.

Every query reads its whole table.  The operators have interfaces of their own; the
queries derive the digest columns from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytequality, decontamination, linededup, merkle, mixing, neardup, pii, quality, secrets, sharding, spelling, toxicity, warc
from .common import span_count, span_digest, span_list, table

SHARDS = 24


def _base(spans, kinds):
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    s = F.col("secrets")
    return found.select("doc_id", *[span_count(s, k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
                        span_digest(_base(s, secrets.BASE_KINDS)).alias("base_sha256"), span_list(s).alias("spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc")["id"].alias("doc_id"), "item_id", "item_shingles", "shared")


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = linededup.line_report(table(spark, sf_dir, "documents"))
    return report.select(F.col("doc")["id"].alias("doc_id"), "n_lines", "n_copies", "n_near")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select(F.col("row_id").alias("doc_id"), "class_id", F.col("first").alias("kept"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.shard_plan(table(spark, sf_dir, "documents"), SHARDS)
    return plan.select(F.col("row_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), drop_text=True)
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold("doc_id") == 0, F.lit(False)).alias("held_out")
    return toxicity.score_toxicity(docs.select("doc_id", "text"), net).select("doc_id", held_out, "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    s = F.col("pii")
    return found.select("doc_id", *[span_count(s, k).alias(f"n_{k}") for k in pii.BASE_KINDS],
                        span_digest(_base(s, pii.BASE_KINDS)).alias("base_sha256"), span_list(s).alias("spans"),
                        F.transform(s, lambda x: x["score"]).alias("scores"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("row_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = bytequality.fit_on(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(bytequality.fold("doc_id") == bytequality.HELD_OUT, F.lit(False)).alias("held_out")
    return bytequality.score_quality(docs.select("doc_id", "text"), net).select("doc_id", held_out, "score", "predicted")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and the check of every row against it after every third row was tampered with."""
    third = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.lit(False))
    tampered = F.when(third, merkle.tampered_leaf(list(merkle.FIELDS)))
    m = merkle.manifest(table(spark, sf_dir, "documents"), keep={"tampered": tampered})
    rows = merkle.verify(m.leaves.withColumn("seen", F.coalesce("tampered", "leaf")), m.root, leaf="seen")
    return rows.select(F.col("id").alias("doc_id"), merkle.as_text(F.col("leaf")).alias("leaf"), "subroot", F.lit(m.root).alias("root"),
                       merkle.proof_digest(F.col("way")).alias("proof_sha256"), "folded_root", "verified")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_decontamination, op3_linededup, op4_neardup, op5_sharding,
                                   op6_quality, op7_toxicity, op8_pii, op9_warc, op10_mixing, op11_quality_classifier,
                                   op12_merkle, op13_spelling)}

# CRC-32 bit by bit: ``code`` is a list of bytes
SQL_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {code}), lambda a, b: list_reduce(
  list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))))"""

ORACLE_SQL = {
    "op2_decontamination": r"""
with w as (
  select 'd' as kind, doc_id as id, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+') as w from documents
  union all
  select 'i', item_id, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+') from benchmark
), s as (
  select distinct kind, id, unnest(list_transform(range(1, greatest(2, len(w) - 3)),
         lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) as g
  from w where len(w) > 0
), n as (select id, count(*) as n from s where kind = 'i' group by id)
select d.id as doc_id, i.id as item_id, any_value(n.n) as item_shingles, count(*) as shared
from s i join s d on i.g = d.g and i.kind = 'i' and d.kind = 'd' join n on n.id = i.id
group by d.id, i.id having count(*) >= 0.8 * any_value(n.n)""",
    "op3_linededup": r"""
with line as (
  select doc_id, i, regexp_extract_all(lower(l[i]), '[^\x00-/:-@\[-`{-\x7f]+') as w
  from (select doc_id, l, unnest(range(1, len(l) + 1)) as i
        from (select doc_id, string_split(text, chr(10)) as l from documents))
), shingled as (
  select doc_id, i, list_sort(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)),
         lambda j: array_to_string(list_slice(w, j, j + 4), ' ')))) as s from line where len(w) > 0
), placed as (
  select *, row_number() over (order by doc_id, i) as place,
    row_number() over (partition by s order by doc_id, i) as nth from shingled
), token as (select place, len(s) as n, unnest(s) as g from placed where nth = 1),
near as (
  select distinct b.place from token a join token b on a.g = b.g and a.place < b.place
  group by a.place, b.place, a.n, b.n having count(*) >= 0.8 * (a.n + b.n - count(*))
), near_class as (select distinct s from placed p join near on near.place = p.place)
select d.doc_id, count(p.s) as n_lines, count(*) filter (p.nth > 1) as n_copies,
  count(*) filter (p.nth = 1 and c.s is not null) as n_near
from documents d left join placed p on p.doc_id = d.doc_id left join near_class c on c.s = p.s
group by d.doc_id""",
    "op6_quality": r"""
with t as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from t),
win as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1),
         lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) >= 3
), twice as (select doc_id, g from win group by 1, 2 having count(*) > 1),
rep as (
  select doc_id, count(distinct p) as n from (
    select doc_id, unnest([i, i + 1, i + 2]) as p from win join twice using (doc_id, g)) group by 1
), line as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as line from t
), worded as (
  select *, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: lower(x)) as lw from line
  where regexp_matches(line, '[^\x20\x09-\x0D]')
), dup as (select doc_id, count(*) - count(distinct line) as n from worded group by 1),
norm as (select doc_id, source, text, array_to_string(lw, ' ') as line, len(lw) as words from worded),
per_line as (select source, line, count(distinct text) as docs from norm group by 1, 2),
hosts as (select source, count(distinct text) as docs from norm group by 1),
removed as (
  select n.doc_id, sum(n.words) as words from norm n
  join per_line p on p.source is not distinct from n.source and p.line = n.line
  join hosts h on h.source is not distinct from n.source
  where p.docs >= 10 and p.docs >= 0.002 * h.docs group by 1
), base as (
  select w.doc_id, cast(len(w) as bigint) as n_words,
    cast(len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(removed.words, 0) as gone
  from w left join dup using (doc_id) left join rep using (doc_id) left join removed using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - gone >= 0.5 * n_words as kept
from base""",
    "op9_warc": """
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
  from pages
), m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < top then top end as refers_to
from m""",
    "op12_merkle": f"""
with recursive doc as (
  select *, row_number() over () as row, {SQL_CRC32.format(code="list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)")} % 3 = 0 as third
  from documents
), leaf as (
  select row, doc_id, lang, third, {"sha256(" + " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"} as leaf,
    {"sha256(" + " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || {v}, '-')" for c, v in (("doc_id", "cast(doc_id as varchar)"), ("source", "source"), ("lang", "lang"), ("n_chars", "cast(n_chars as varchar)"), ("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))) + ")"} as changed
  from doc
), placed as (
  select *, row_number() over (partition by lang order by doc_id, leaf) - 1 as pos from leaf
), low as (   -- levels of a language: lists of nodes
  select lang, 0 as lvl, list(leaf order by pos) as l from placed group by lang
  union all
  select lang, lvl + 1, list_transform(range(0, (len(l) + 7) // 8), lambda i: sha256(array_to_string(l[i * 8 + 1:i * 8 + 8], '')))
  from low where len(l) > 1
), subroot as (
  select lang, l[1] as h, row_number() over (order by lang is not null, lang) - 1 as pos from low where len(l) = 1
), high as (
  select 0 as lvl, list(h order by pos) as l from subroot
  union all
  select lvl + 1, list_transform(range(0, (len(l) + 7) // 8), lambda i: sha256(array_to_string(l[i * 8 + 1:i * 8 + 8], '')))
  from high where len(l) > 1
), top as (select l[1] as root from high where len(l) = 1),
low_way as (   -- from the leaf up: place, hash and siblings so far
  select row, lang, 0 as lvl, pos, case when third then changed else leaf end as h, '' as way from placed
  union all
  select w.row, w.lang, w.lvl + 1, w.pos // 8, sha256(array_to_string(low.l[w.pos // 8 * 8 + 1:w.pos], '') || w.h || array_to_string(low.l[w.pos + 2:w.pos // 8 * 8 + 8], '')),
    w.way || array_to_string(low.l[w.pos // 8 * 8 + 1:w.pos], '') || array_to_string(low.l[w.pos + 2:w.pos // 8 * 8 + 8], '')
  from low_way w join low on low.lang is not distinct from w.lang and low.lvl = w.lvl where len(low.l) > 1
), low_end as (select row, lang, h, way from (select *, max(lvl) over (partition by row) as last from low_way) where lvl = last),
high_way as (
  select e.row, 0 as lvl, s.pos, e.h, e.way from low_end e join subroot s on s.lang is not distinct from e.lang
  union all
  select w.row, w.lvl + 1, w.pos // 8, sha256(array_to_string(high.l[w.pos // 8 * 8 + 1:w.pos], '') || w.h || array_to_string(high.l[w.pos + 2:w.pos // 8 * 8 + 8], '')),
    w.way || array_to_string(high.l[w.pos // 8 * 8 + 1:w.pos], '') || array_to_string(high.l[w.pos + 2:w.pos // 8 * 8 + 8], '')
  from high_way w join high on high.lvl = w.lvl where len(high.l) > 1
), high_end as (select row, h, way from (select *, max(lvl) over (partition by row) as last from high_way) where lvl = last)
select p.doc_id, p.leaf, s.h as subroot, top.root, sha256(e.way) as proof_sha256, e.h as folded_root, e.h = top.root as verified
from placed p join high_end e on e.row = p.row join subroot s on s.lang is not distinct from p.lang cross join top""",
    "op13_spelling": f"""
with recursive run as (
  select cast(doc_id as varchar) as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r
  from documents
), counted as (select id, r, count(*) as n from run where len(r) >= 6 group by 1, 2),
hashed as (
  select *, {SQL_CRC32.format(code="flatten(list_transform(string_split(id || ':' || r, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]::bigint[] end))")} as h
  from counted
), slip as (
  select case when h % 199 = 0 then r[:h % len(r)] || r[h % len(r) + 2:] else r end as word, n from hashed
), word as (
  select word, cast(sum(n) as bigint) as n from slip where len(word) >= 6 group by word having sum(n) >= 5
), gone as (   -- every word without its i-th letter
  select word, n, len(word) as size, i, word[:i - 1] || word[i + 1:] as rest
  from (select word, n, unnest(range(1, len(word) + 1)) as i from word)
), pair as (
  select a.word, a.n, b.word as other, b.n as other_n from gone a join gone b on a.rest = b.rest and a.i = b.i and a.size = b.size and a.word <> b.word
  union
  select a.word, a.n, b.word, b.n from gone a join word b on a.rest = b.word
  union
  select b.word, b.n, a.word, a.n from gone a join word b on a.rest = b.word
), near as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as form, max(other_n) as form_n from pair group by word
), formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * w.n then form end as form, case when form_n >= 5 * w.n then form_n end as form_n
  from word w left join near using (word)
), chain as (
  select word, word as at, form as next from formed
  union all
  select c.word, c.next, f.form from chain c join formed f on f.word = c.next
)
select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n from formed f join chain c on c.word = f.word and c.next is null""",
}
