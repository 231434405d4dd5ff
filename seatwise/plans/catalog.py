"""The operator catalogue on the driver tables: one Spark query per operator, and
the SQL that computes the same rows in another engine (DuckDB) for checking.

Stand-ins (the response table is not among the driver tables):
* ``customer`` plays the applicants: ``c_mktsegment`` the answer group,
  ``c_nationkey`` the country, ``c_acctbal`` the number, ``c_name`` the e-mail key;
* ``orders`` / ``events`` play timed submissions (``o_orderdate`` ties, ``ts`` does not);
* ``part`` plays codes and labels; ``documents`` free text.
Nulls, which no driver table holds, are made with ``nullif`` on both sides.

Every query reads whole tables; a limit appears only where it is the operator
(head / tail / the draw).  Doubles are rounded to 9 places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.functions.convert import timestamp_literal, to_timestamp_utc
from seatwise.functions.nulls import case_default, filter_out, keep_in
from seatwise.functions.recode import recode
from seatwise.functions.text import (
    percent_label, replace_each_first, replace_first, slug, squish, title_case, wrap, wrap_balanced,
)
from seatwise.operators.categories import relevel_ordinal, reorder_by
from seatwise.operators.codebook import conformance, decode
from seatwise.operators.chances import inclusion_chances
from seatwise.operators.columns import across_strings
from seatwise.operators.counts import collapse, count_by, count_having, mean_strict
from seatwise.operators.dedup import first_per_key
from seatwise.operators.density import density
from seatwise.operators.lump import lump_top_n
from seatwise.operators.membership import in_list
from seatwise.operators.ordinal import head_rows, ordinal, tail_rows
from seatwise.operators.sampling import weighted_sample
from seatwise.operators.scoring import Rule
from seatwise.operators.shares import share_of_total, share_within
from seatwise.operators.sizing import spread
from seatwise.plans.config import DrawConfig, IntakeConfig, ScoreConfig
from seatwise.plans import explore
from seatwise.plans.explore import stack_populations
from seatwise.plans.report import profile_report, report_counts
from seatwise.plans.intake import apply_exclusions, clean_intake
from seatwise.plans.observed import write_observed_intake
from seatwise.plans.selection import score_applicants, seat_draw
from seatwise.session import scratch_path, stored
from seatwise.sources.buckets import write_bucketed
from seatwise.sources.codebook import codebook_df
from seatwise.sources.inspect import column_profile
from seatwise.sources.profile import FIELDS, build_profile, merge_profiles, read_profile
from seatwise.sources.readers import read_csv2
from seatwise.sources.writers import write_csv2, write_snapshot

Query = Callable[[SparkSession, str], DataFrame]

SEED = 42
SEATS = 160


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _r9(c) -> F.Column:
    return F.round(c if isinstance(c, F.Column) else F.col(c), 9)


# ---------------------------------------------------------------------------
# Shared stand-in definitions (Spark side and SQL side written together).
# ---------------------------------------------------------------------------

def customer_rules(seg: str = "seg") -> list[Rule]:
    return [
        Rule(seg, "in", ["AUTOMOBILE", "HOUSEHOLD"], 2),
        Rule(seg, "eq", "FURNITURE", 3),
        Rule("c_nationkey", "eq", 2, 3),
        Rule.expr(F.col("c_acctbal") < 0, 2),
        Rule.expr((F.col("c_acctbal") >= 0) & (F.col("c_acctbal") < 1000), 1),
        Rule(seg, "eq", "MACHINERY", -2),
        Rule("c_nationkey", "in", [20, 21], -2),
    ]


SQL_SCORE = """
  CAST(CASE WHEN s IS NULL THEN NULL WHEN s <= 0 THEN 1.0 ELSE s END AS DOUBLE) AS score
  FROM (SELECT *,
    CASE WHEN (seg = 'FURNITURE') IS NULL OR (c_nationkey = 2) IS NULL OR (c_acctbal < 0) IS NULL
           OR (c_acctbal >= 0 AND c_acctbal < 1000) IS NULL OR (seg = 'MACHINERY') IS NULL THEN NULL
         ELSE 1.0
           + CASE WHEN coalesce(seg IN ('AUTOMOBILE', 'HOUSEHOLD'), false) THEN 2.0 ELSE 0.0 END
           + CASE WHEN seg = 'FURNITURE' THEN 3.0 ELSE 0.0 END
           + CASE WHEN c_nationkey = 2 THEN 3.0 ELSE 0.0 END
           + CASE WHEN c_acctbal < 0 THEN 2.0 ELSE 0.0 END
           + CASE WHEN c_acctbal >= 0 AND c_acctbal < 1000 THEN 1.0 ELSE 0.0 END
           + CASE WHEN seg = 'MACHINERY' THEN -2.0 ELSE 0.0 END
           + CASE WHEN coalesce(c_nationkey IN (20, 21), false) THEN -2.0 ELSE 0.0 END
    END AS s
"""


def sql_key(id_col: str, weight: str, seed: int = SEED) -> str:
    """The draw key in SQL: -ln(u) / w with u from md5('<seed>:<id>')."""
    return (f"-ln((('0x' || substr(md5('{seed}:' || CAST({id_col} AS VARCHAR)), 1, 13))::BIGINT + 0.5)"
            f" / 4503599627370496.0) / {weight}")


def _customers(spark, sf, null_seg: str | None = None) -> DataFrame:
    c = _t(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    if null_seg:
        seg = F.when(seg != null_seg, seg)
    return c.withColumn("seg", seg)


def _score_cfg(rank: bool) -> ScoreConfig:
    return ScoreConfig(rules=customer_rules(), name="score", after=None,
                       rank_name="id" if rank else None, rank_order=("-score", "c_custkey"))


def _special_list(spark, sf) -> DataFrame:
    o = _t(spark, sf, "orders")
    return (o.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 450000))
             .select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
                     .alias("value")))


SQL_SPECIAL_LIST = ("SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS value FROM orders "
                    "WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000")


def _admitted(spark, sf, seats: int = SEATS, rank: bool = False) -> DataFrame:
    scored = score_applicants(_customers(spark, sf), _score_cfg(rank=rank))
    cfg = DrawConfig(seats=seats, seed=SEED, id_col="c_custkey", weight="score",
                     guaranteed_col="c_nationkey", guaranteed_value=7, list_col="c_name",
                     on_short="all")
    return seat_draw(scored, cfg, special_list=_special_list(spark, sf))


SQL_ADMITTED = f"""
  scored AS (SELECT *, {SQL_SCORE} FROM (SELECT *, c_mktsegment AS seg FROM customer) c) x),
  drawn AS (SELECT c_custkey FROM scored WHERE score > 0
            ORDER BY {sql_key('c_custkey', 'score')}, c_custkey LIMIT {SEATS}),
  admitted AS (SELECT * FROM scored
               WHERE c_custkey IN (SELECT c_custkey FROM drawn) OR c_nationkey = 7
                  OR c_name IN ({SQL_SPECIAL_LIST}))
"""


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------

def flagship_seat_draw(spark, sf, seats: int = SEATS) -> DataFrame:
    """Score -> weighted draw -> + guaranteed + listed -> share of admitted per segment."""
    adm = _admitted(spark, sf, seats)
    return share_of_total(count_by(adm, "c_mktsegment", ordered=False)).select("c_mktsegment", "n", _r9("p").alias("p"))


def weighted_sample_q(spark, sf):
    scored = score_applicants(_customers(spark, sf), _score_cfg(rank=False))
    return weighted_sample(scored, SEATS, "c_custkey", "score", seed=SEED, on_short="all").select("c_custkey")


def uniform_sample_q(spark, sf):
    return weighted_sample(_t(spark, sf, "customer"), SEATS, "c_custkey", None, seed=SEED,
                           on_short="all").select("c_custkey")


def weighted_sample_threshold_q(spark, sf):
    """Same draw through the large-k plan (histogram threshold + exact ordinal)."""
    scored = score_applicants(_customers(spark, sf), _score_cfg(rank=False))
    return weighted_sample(scored, SEATS, "c_custkey", "score", seed=SEED, on_short="all",
                           strategy="threshold").select("c_custkey")


def draw_chances(spark, sf):
    """Everyone's chance to get one of the drawn seats, known before the draw."""
    scored = score_applicants(_customers(spark, sf), _score_cfg(rank=False)).select("c_custkey", "score")
    return inclusion_chances(scored, SEATS, "score").select("c_custkey", "score", _r9("chance").alias("chance"))


def _orders_timed(spark, sf) -> DataFrame:
    o = _t(spark, sf, "orders")
    t = F.when(~((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)), F.col("o_orderdate"))
    return o.withColumn("t", t)


SQL_ORDERS_TIMED = ("SELECT *, CASE WHEN NOT (o_orderstatus = 'P' AND o_totalprice > 400000) "
                    "THEN o_orderdate END AS t FROM orders")


def first_submission(spark, sf):
    d = first_per_key(_orders_timed(spark, sf), "o_custkey", "t", "o_orderkey", method="aggregate")
    return d.select("o_custkey", "o_orderkey", "o_totalprice")


def first_submission_window(spark, sf):
    d = first_per_key(_orders_timed(spark, sf), "o_custkey", "t", "o_orderkey", method="window")
    return d.select("o_custkey", "o_orderkey", "o_totalprice")


def _event_responses(spark, sf, e: DataFrame | None = None) -> DataFrame:
    e = _t(spark, sf, "events") if e is None else e
    mail = F.when(~((F.col("event_type") == "view") & (F.col("value") > 40)),
                  F.concat(F.upper("event_type"), F.lit(" @Mail"),
                           F.when(F.col("value") > 10, F.lit(".CL")).otherwise(F.lit(""))))
    return e.select(
        F.concat(F.lit("  User "), F.col("user_id").cast("string"), F.lit(" ")).alias("nombre"),
        mail.alias("correo"),
        F.col("ts").alias("time_start"),
        F.col("ts").cast("string").alias("time_end"),
        F.col("event_id").alias("session_id"),
        F.col("event_type").alias("genero"),
        F.when(F.col("value") > 25, F.lit("s")).otherwise(F.lit("no")).alias("trans"),
    )


def clean_intake_q(spark, sf):
    cfg = IntakeConfig(exclude_names=("  User 3 ",), cutoff="2024-01-20 00:00:00")
    return clean_intake(_event_responses(spark, sf), cfg).select("nombre", "correo", "genero", "trans")


def _linked_responses(spark, sf) -> DataFrame:
    """Events as answers of people with several spellings and addresses: names and e-mails
    chain up to ten users, one user's name has many addresses, and bad addresses are shared."""
    e, u = _t(spark, sf, "events"), F.col("user_id")
    name = F.concat(F.when(F.col("event_type") == "error", F.lit("Usr ")).otherwise(F.lit(" user  ")), u.cast("string"))
    mail = (F.when(F.col("value") > 60, F.lit("None @ home"))
            .when(u % 97 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"), F.lit("@Many.cl")))
            .when(F.col("event_type") == "click", F.concat(F.lit("a"), F.floor(u / 2).cast("string"), F.lit("@Mail.cl")))
            .when((F.col("event_type") == "view") & (u % 10 != 0), F.concat(F.lit("b"), F.floor((u + 1) / 2).cast("string"), F.lit(" @mail.CL")))
            .otherwise(F.concat(F.lit("c"), u.cast("string"), F.lit("@mail.cl"))))
    return e.select(F.when(F.col("event_id") % 50 != 0, name).alias("nombre"), mail.alias("correo"),
                    F.date_trunc("hour", "ts").cast("string").alias("time_end"), F.col("event_id").alias("session_id"),
                    F.col("event_type").alias("genero"))


def clean_intake_linked(spark, sf):
    """The clean intake with people known by linked names and e-mails."""
    cfg = IntakeConfig(identity="linked", cutoff="2024-01-28 00:00:00", keep_session=True)
    return clean_intake(_linked_responses(spark, sf), cfg).select("nombre", "correo", "session_id", "genero")


SQL_CLEAN_INTAKE_LINKED = r"""
WITH RECURSIVE r AS (
  SELECT CASE WHEN event_id % 50 <> 0 THEN CASE WHEN event_type = 'error' THEN 'usr ' ELSE 'user ' END || user_id END AS nombre,
         CASE WHEN value > 60 THEN 'none@home' WHEN user_id % 97 = 0 THEN 'x' || event_id || '@many.cl'
              WHEN event_type = 'click' THEN 'a' || user_id // 2 || '@mail.cl'
              WHEN event_type = 'view' AND user_id % 10 <> 0 THEN 'b' || (user_id + 1) // 2 || '@mail.cl'
              ELSE 'c' || user_id || '@mail.cl' END AS correo,
         date_trunc('hour', ts) AS t, event_id AS session_id, event_type AS genero FROM events),
k AS (SELECT *, 'n' || nombre AS n, CASE WHEN regexp_matches(correo, '@.*\.') THEN 'm' || correo END AS m FROM r),
link AS (SELECT DISTINCT n AS x, m AS y FROM k WHERE n IS NOT NULL AND m IS NOT NULL),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
node AS (SELECT DISTINCT unnest([n, m]) AS v FROM k),
reach AS (SELECT v, v AS w FROM node WHERE v IS NOT NULL
          UNION SELECT r.v, b.y FROM reach r JOIN both_ways b ON b.x = r.w),
person AS (SELECT v, min(w) AS p FROM reach GROUP BY v),
d AS (SELECT k.* FROM k JOIN person ON person.v = coalesce(k.n, k.m)
      QUALIFY row_number() OVER (PARTITION BY p ORDER BY t ASC NULLS LAST, session_id ASC) = 1)
SELECT nombre, correo, session_id, genero FROM d
WHERE regexp_matches(correo, '@.*\.') AND t <= TIMESTAMP '2024-01-28 00:00:00'
"""

SQL_CLEAN_INTAKE = r"""
WITH r AS (
  SELECT '  User' || chr(160) || CAST(user_id AS VARCHAR) || ' ' AS nombre,
         CASE WHEN NOT (event_type = 'view' AND value > 40)
              THEN upper(event_type) || ' @Mail' || CASE WHEN value > 10 THEN '.CL' ELSE '' END END AS correo,
         ts AS time_end, event_id AS session_id, event_type AS genero,
         CASE WHEN value > 25 THEN 's' ELSE 'no' END AS trans
  FROM events),
f AS (SELECT * FROM r WHERE correo IS NOT NULL AND nombre <> '  User' || chr(160) || '3 '),
c AS (SELECT lower(trim(regexp_replace(nombre, '[\s\p{Z}]+', ' ', 'g'))) AS nombre,
             replace(lower(correo), ' ', '') AS correo, time_end, session_id, genero, trans FROM f),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY nombre
        ORDER BY time_end ASC NULLS LAST, session_id ASC NULLS LAST) = 1)
SELECT CASE WHEN regexp_matches(nombre, '^s$') THEN 'sí' ELSE nombre END AS nombre,
       CASE WHEN regexp_matches(correo, '^s$') THEN 'sí' ELSE correo END AS correo,
       CASE WHEN regexp_matches(genero, '^s$') THEN 'sí' ELSE genero END AS genero,
       CASE WHEN regexp_matches(trans, '^s$') THEN 'sí' ELSE trans END AS trans
FROM d WHERE regexp_matches(correo, '@.*\.') AND time_end <= TIMESTAMP '2024-01-20 00:00:00'
"""


SQL_INTAKE_ACCOUNT = SQL_CLEAN_INTAKE[:SQL_CLEAN_INTAKE.index("SELECT CASE WHEN regexp_matches(nombre")].rstrip() + """,
s AS (SELECT 0 AS k, 'read' AS step, count(*) AS n FROM r
      UNION ALL SELECT 1, 'e-mail present', count(*) FROM r WHERE correo IS NOT NULL
      UNION ALL SELECT 2, 'test names out', count(*) FROM f
      UNION ALL SELECT 3, 'first of a person', count(*) FROM d
      UNION ALL SELECT 4, 'valid and in time', count(*) FROM d
                WHERE regexp_matches(correo, '@.*\\.') AND time_end <= TIMESTAMP '2024-01-20 00:00:00')
SELECT step, n, coalesce(lag(n) OVER (ORDER BY k) - n, 0) AS n_lost FROM s"""


def stream_clean_intake(spark, sf):
    """The clean intake as a stream: events arrive as files, the first submission per
    person is kept in the state store, each trigger writes only the people whose
    first submission changed, and the current table is the latest row per person."""
    from seatwise.streaming import changes_sink, current_firsts, first_submissions

    schema = _t(spark, sf, "events").schema
    root = sf.rstrip("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("basePath", root).parquet(f"{root}/events*.parquet")
    cfg = IntakeConfig(exclude_names=("  User\u00a03 ",), cutoff="2024-01-20 00:00:00")
    out_path, ck = scratch_path(spark, "stream-intake"), scratch_path(spark, "stream-intake-ck")
    q = (first_submissions(_event_responses(spark, sf, stream), cfg).writeStream
         .outputMode("update").foreachBatch(changes_sink(out_path))
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return current_firsts(spark, out_path, cfg).select("nombre", "correo", "genero", "trans")


def stream_final_intake(spark, sf):
    """The clean intake as a stream that ends: one window up to the closing time, each person's
    row appended once when the watermark has passed it."""
    from seatwise.streaming import final_submissions

    schema = _t(spark, sf, "events").schema
    root = sf.rstrip("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("basePath", root).parquet(f"{root}/events*.parquet")
    cfg = IntakeConfig(exclude_names=("  User\u00a03 ",), cutoff="2024-01-20 00:00:00")
    out_path, ck = scratch_path(spark, "final-intake"), scratch_path(spark, "final-intake-ck")
    final = final_submissions(_event_responses(spark, sf, stream), cfg)
    q = (final.writeStream.outputMode("append").format("parquet").option("path", out_path)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(final.schema).parquet(out_path).select("nombre", "correo", "genero", "trans")


def exclusions_q(spark, sf):
    p = _t(spark, sf, "part").withColumn("brand", F.when(F.col("p_brand") != "Brand#7", F.col("p_brand")))
    ex = [("p_type", "ECONOMY"), ("brand", "Brand#1"), ("p_size", 50), ("p_size", 49)]
    return apply_exclusions(p, ex).select("p_partkey")


def score_rules_q(spark, sf):
    s = score_applicants(_customers(spark, sf, null_seg="BUILDING"), _score_cfg(rank=True))
    return s.select("c_custkey", "score", "id")


def ordinal_rank(spark, sf):
    # Project before ranking: the two-phase plan checkpoints its input, and columns
    # cannot be pruned through a checkpoint.
    o = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordinal(o, ["-o_totalprice", "o_orderkey"], method="range").select("o_orderkey", "id")


def ordinal_rank_window(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordinal(o, ["-o_totalprice", "o_orderkey"], method="window").select("o_orderkey", "id")


def head_ranked(spark, sf):
    return head_rows(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                     ["-o_totalprice", "o_orderkey"])


def tail_ranked(spark, sf):
    return tail_rows(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                     ["-o_totalprice", "o_orderkey"])


def semi_join_list(spark, sf):
    return in_list(_t(spark, sf, "customer"), "c_name", _special_list(spark, sf)).select("c_custkey", "c_name")


def line_list_semi_join(spark, sf):
    """The special list as a text file (one key per line), read back and matched."""
    from seatwise.sources.readers import read_line_list
    from seatwise.sources.writers import write_text_lines

    path = write_text_lines(_special_list(spark, sf), "value", scratch_path(spark, "special-list"))
    return in_list(_t(spark, sf, "customer"), "c_name", read_line_list(spark, path)) \
        .select("c_custkey", "c_name")


def flagship_union_form(spark, sf):
    """The admitted set built the literal way: draw, guaranteed and listed rows
    appended, then made distinct."""
    scored = score_applicants(_customers(spark, sf), _score_cfg(rank=False))
    cfg = DrawConfig(seats=SEATS, seed=SEED, id_col="c_custkey", weight="score",
                     guaranteed_col="c_nationkey", guaranteed_value=7, list_col="c_name",
                     on_short="all")
    adm = seat_draw(scored, cfg, special_list=_special_list(spark, sf), method="union")
    return adm.select("c_custkey", "c_mktsegment", "score")


def count_one(spark, sf):
    return count_by(_customers(spark, sf, null_seg="MACHINERY"), "seg")


def count_two(spark, sf):
    return count_by(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


def count_sorted(spark, sf):
    return count_by(_t(spark, sf, "customer"), "c_nationkey", sort=True)


def answer_counts(spark, sf):
    from seatwise.operators.counts import count_each
    return count_each(_customers(spark, sf, null_seg="MACHINERY"), ["seg", "c_nationkey", "c_mktsegment"])


def count_having_q(spark, sf):
    return count_having(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                        (F.col("l_linestatus") == "F") & (F.col("n") > 100))


def _cust_region(spark, sf) -> DataFrame:
    return _t(spark, sf, "customer").join(_t(spark, sf, "nation"),
                                          F.col("c_nationkey") == F.col("n_nationkey"))


def group_share(spark, sf):
    c = count_by(_cust_region(spark, sf), ["n_regionkey", "c_mktsegment"], ordered=False)
    c = keep_in(c, "c_mktsegment", ["BUILDING", "FURNITURE", "HOUSEHOLD"])
    return share_within(c, "n_regionkey").select("n_regionkey", "c_mktsegment", "n", _r9("p").alias("p"))


def total_share(spark, sf):
    return share_of_total(count_by(_t(spark, sf, "customer"), "c_nationkey", ordered=False)) \
        .select("c_nationkey", "n", _r9("p").alias("p"))


def filter_out_nulls_kept(spark, sf):
    c = _customers(spark, sf, null_seg="MACHINERY")
    return filter_out(c, F.col("seg") == "BUILDING").select("c_custkey", "seg")


def lump_top_n_q(spark, sf):
    p = lump_top_n(_t(spark, sf, "part"), "p_brand", 10, "Other brands")
    return count_by(p, "p_brand")


def category_order(spark, sf):
    c = share_of_total(count_by(_t(spark, sf, "orders"), "o_orderpriority", ordered=False))
    c = relevel_ordinal(c, "o_orderpriority", ["3-MEDIUM", "1-URGENT"], name="ord_fixed", per_level=True)
    c = reorder_by(c, "o_orderpriority", "p", name="ord_by_share", per_level=True)
    return c.select("o_orderpriority", "n", "ord_fixed", "ord_by_share")


BAD_NUMBERS = {3: "", 4: "30d", 5: "30f", 6: "NaN", 7: "inf", 8: "  ", 9: "1.2.3"}     # by c_nationkey


def _acct_text(spark, sf) -> DataFrame:
    c = _t(spark, sf, "customer")
    bad = F.create_map(*[F.lit(x) for kv in BAD_NUMBERS.items() for x in kv])
    return c.withColumn("bal_txt", F.coalesce(F.try_element_at(bad, F.col("c_nationkey")),
                                              F.col("c_acctbal").cast("string")))


def mean_strict_q(spark, sf):
    m = mean_strict(_acct_text(spark, sf), "bal_txt", by="c_nationkey")
    return m.select("c_nationkey", _r9("mean").alias("mean"))


def mean_na_rm(spark, sf):
    m = mean_strict(_acct_text(spark, sf), "bal_txt", by="c_nationkey", na_rm=True)
    return m.select("c_nationkey", _r9("mean").alias("mean"))


RECIPIENTS = 500       # addresses a line, as a mail server takes them


def _recipients(spark, sf) -> DataFrame:
    """Addresses of all customers in batches, the largest balance first; some have none."""
    c = _t(spark, sf, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("mail"))
    return collapse(c, "mail", ["-c_acctbal", "c_custkey"], batch_size=RECIPIENTS)


def recipient_list_q(spark, sf):
    return _recipients(spark, sf)


def recipient_file(spark, sf):
    """Recipient batches written as text lines and read back."""
    from seatwise.sources.writers import write_text_lines

    path = write_text_lines(_recipients(spark, sf), "recipients", scratch_path(spark, "recipients"))
    return spark.read.text(path)


def drop_prefix_relocate(spark, sf):
    from seatwise.operators.columns import add_constant, drop_prefix_keep, relocate_after, select_any_of

    o = drop_prefix_keep(_t(spark, sf, "orders"), "o_order", keep=["o_orderdate"])
    o = relocate_after(add_constant(o, "w", 1), "w", "o_custkey")
    o = o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return select_any_of(o, ["o_custkey", "w", "o_totalprice", "o_orderdate", "not_there"])


def sort_text_number(spark, sf):
    """A number held as text sorts as text unless converted first."""
    c = _t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("bal_txt"))
    c = ordinal(c, ["-bal_txt", "c_custkey"], name="id_text")
    c = c.withColumn("bal_num", F.col("bal_txt").try_cast("double"))
    c = ordinal(c, ["-bal_num", "c_custkey"], name="id_num")
    return c.select("c_custkey", "id_text", "id_num")


def text_squish_lower(spark, sf):
    d = spread(_t(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.md5(F.lower(squish("text"))).alias("h"))


def email_filter(spark, sf):
    return _t(spark, sf, "documents").filter(F.col("text").rlike(r"@.*\.")).select("doc_id")


def replace_first_q(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", replace_first(F.regexp_replace("p_name", " ", "_"), "_", " ").alias("v"))


REPAIRS = [("r", "R"), ("o", "0"), ("ge", "GE"), ("b", "")]


def repair_list(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", replace_each_first("p_name", REPAIRS).alias("v"))


def wrap_label(spark, sf):
    p = _t(spark, sf, "part")
    txt = F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name")
    return p.select("p_partkey", wrap(txt, 12).alias("v"))


def wrap_label_balanced(spark, sf):
    """Labels wrapped with the least squared raggedness."""
    p = _t(spark, sf, "part")
    txt = F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name")
    return p.select("p_partkey", wrap_balanced(txt, 18).alias("v"))


SPANISH = ["ñandú", "nácar", "nieve", "oro", "ópalo", "Ébano", "éter", "Zafiro", "zinc", "ágata", "azul", "ámbar", "nube", "Ñu", "oír"]


def _spanish(spark, sf) -> DataFrame:
    """Parts with an accented level; some have none."""
    level = F.element_at(F.array(*[F.lit(x) for x in SPANISH]), (F.col("p_partkey") % len(SPANISH) + 1).cast("int"))
    return _t(spark, sf, "part").withColumn("level", F.when(F.col("p_size") != 50, level))


def category_order_collated(spark, sf):
    """Level order of raw rows in Spanish: two listed levels, the others as a dictionary has them."""
    p = relevel_ordinal(_spanish(spark, sf), "level", ["oro", "azul"], name="ord", collation="es")
    return p.select("p_partkey", "level", F.col("ord").cast("long").alias("ord"))


def count_collated(spark, sf):
    """Counts in Spanish order, with each row's place in it and in the order by frequency."""
    c = count_by(_spanish(spark, sf), "level", ordered=False)
    c = relevel_ordinal(c, "level", [], name="place", per_level=True, collation="es")
    return reorder_by(c, "level", "n", name="by_count", per_level=True, collation="es")


def title_case_q(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", title_case(F.concat_ws(" ", "p_name", "p_type")).alias("v"))


def percent_label_q(spark, sf):
    c = share_of_total(count_by(_t(spark, sf, "lineitem"), "l_returnflag", ordered=False))
    return c.select("l_returnflag", "n", percent_label("p", 1).alias("label"))


def recode_q(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey", recode("o_orderstatus", {"F": "finished", "O": "open"}).alias("status"))


def across_strings_q(spark, sf):
    c = _t(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_mktsegment",
        F.when(F.col("c_acctbal") < 0, F.lit("s")).otherwise(F.lit("no")).alias("flag"))
    return across_strings(c, lambda x: case_default(x.rlike("^s$"), F.lit("sí"), x))


def harmonise_union(spark, sf):
    adm = _admitted(spark, sf).select("c_custkey", "c_mktsegment", "c_nationkey")
    app = _t(spark, sf, "customer")
    return stack_populations(adm, app, numeric=())


def cutoff_inclusive(spark, sf):
    e = _t(spark, sf, "events")
    return e.filter(F.col("ts") <= timestamp_literal("2024-01-15 00:00:00", e.schema["ts"].dataType)) \
        .select("event_id")


def cutoff_text_time(spark, sf):
    e = _t(spark, sf, "events").withColumn("t", to_timestamp_utc(F.col("ts").cast("string")))
    return e.filter(F.col("t") <= timestamp_literal("2024-01-15 00:00:00")).select("event_id")


def distinct_rows(spark, sf):
    return _t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").distinct()


def density_q(spark, sf):
    """The chart estimator: linear binning on 512 points, kernel convolution, 512-point grid."""
    d = density(_t(spark, sf, "part"), "p_size", points=512)
    return d.select("i", _r9("x").alias("x"), _r9("density").alias("density"))


def density_exact(spark, sf):
    d = density(_t(spark, sf, "part"), "p_size", points=64, method="exact")
    return d.select("i", _r9("x").alias("x"), _r9("density").alias("density"))


def display_labels_q(spark, sf):
    """Display labels (recode, first ``_``, repairs, wrap, title, fixed level order)
    on code-like columns made from ``part``."""
    from seatwise.plans.explore import display_labels

    p = _t(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lower("p_type"), F.lit("_"), F.col("p_size").cast("string")).alias("genero"),
        F.lower("p_type").alias("nivel_r"),
        F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_de_"), F.lower("p_type")).alias("areas"),
        F.lower(F.regexp_replace("p_brand", "#", "_")).alias("pais"))
    return display_labels(p).select("p_partkey", "genero", "nivel_r", "nivel_r_ord", "areas", "pais")


def csv2_roundtrip(spark, sf):
    """Written and read back: numbers, thousands marks, missing values, separators, quotes
    and line breaks inside fields."""
    s = _t(spark, sf, "supplier").withColumns({
        "thousands": F.concat(F.format_string("%d", F.col("s_suppkey") % 9 + 1), F.lit(".500")),
        "thousands_dec": F.concat(F.lit("1.234,"), (F.col("s_suppkey") % 10).cast("string")),
        "some": F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")),
        "odd": F.concat(F.lit('a;"b"\n'), F.col("s_name"), F.lit("; c"))})
    path = write_csv2(s, scratch_path(spark, "supplier-csv2"))
    back = read_csv2(spark, path)
    return back.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", "thousands", "thousands_dec", "some", "odd")


def snapshot_anonymised(spark, sf):
    c = _t(spark, sf, "customer")
    path = write_snapshot(c, scratch_path(spark, "customer-snapshot"), drop=("c_name",))
    return spark.read.parquet(path)


def glimpse_q(spark, sf):
    from seatwise.sources.inspect import glimpse
    return glimpse(_t(spark, sf, "customer"), 5, order=["c_custkey"])


def admitted_snapshot(spark, sf):
    """The admitted set written without personal columns and the score, read back."""
    adm = _admitted(spark, sf)
    path = write_snapshot(adm, scratch_path(spark, "admitted"), drop=("c_name", "score"))
    return spark.read.parquet(path)


def admitted_by_nation(spark, sf):
    return count_by(_admitted(spark, sf), "c_nationkey", sort=True)


def admitted_mean_balance(spark, sf):
    adm = _admitted(spark, sf).withColumn(
        "bal_txt", F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_acctbal").cast("string")))
    return mean_strict(adm, "bal_txt", by="c_mktsegment", na_rm=True).select(
        "c_mktsegment", _r9("mean").alias("mean"))


def column_profile_q(spark, sf):
    return column_profile(_t(spark, sf, "customer"))


PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]


def profile_merged(spark, sf):
    """Profiles of the months' snapshots, stored, read again and merged: exact columns as they
    are, the sketched ones held against exact counts (5 % of distinct values, 2 % of ranks)."""
    o = _t(spark, sf, "orders").withColumn("month", F.date_trunc("month", "o_orderdate")).select("month", *PROFILED)
    path = scratch_path(spark, "profiles")
    build_profile(o, by=["month"]).write.parquet(path)
    merged = stored(merge_profiles(spark.read.parquet(path)))
    report = read_profile(merged, [0.5])
    exact = column_profile(o.select(*PROFILED)).select("column", F.col("n_distinct").alias("exact"))
    medians = report.filter("quantiles is not null").select("column", F.col("quantiles")[0].alias("median"))
    cells = o.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                         for c in ("o_orderkey", "o_custkey", "o_totalprice")])).alias("x")).select("x.*")
    ranks = (cells.join(F.broadcast(medians), "column").groupBy("column")           # one row a column
             .agg(F.avg((F.col("value") < F.col("median")).cast("int")).alias("below"),
                  F.avg((F.col("value") <= F.col("median")).cast("int")).alias("upto")))
    return (report.join(exact, "column").join(ranks, "column", "left").select(
        *FIELDS[:3], *[F.when(F.col("least_number").isNull(), F.col(c)).alias(c) for c in ("least", "greatest")],
        *[F.round(c, 9).alias(c) for c in ("least_number", "greatest_number")],
        (F.abs(F.col("n_distinct") - F.col("exact")) <= F.col("exact") * 0.05).alias("distinct_close"),
        ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_close")))


def _sql_profile(column: str) -> str:
    text = column in ("o_orderstatus", "o_orderpriority")
    pick = lambda f, yes: f"{f}({column})" if yes else "NULL"
    return (f"SELECT '{column}' AS \"column\", count(*) AS n, count({column}) AS n_non_null, "
            f"CAST({pick('min', text)} AS VARCHAR) AS least, CAST({pick('max', text)} AS VARCHAR) AS greatest, "
            f"round(CAST({pick('min', not text)} AS DOUBLE), 9) AS least_number, "
            f"round(CAST({pick('max', not text)} AS DOUBLE), 9) AS greatest_number, true AS distinct_close, "
            f"{'CAST(NULL AS BOOLEAN)' if text else 'true'} AS median_close FROM orders")


ANSWER_CODEBOOK = [
    ("genero", "mc", "Event", [("Click", "click"), ("View", "view"), ("Purchase", "purchase")]),
    ("trans", "mc", "High", [("Yes", "sí")]),
    ("correo", "text", "Mail", []),
]


def _observed_intake(spark, sf):
    cfg = IntakeConfig(exclude_names=("  User\u00a03 ",), cutoff="2024-01-20 00:00:00")
    return write_observed_intake(_event_responses(spark, sf), scratch_path(spark, "observed"), cfg,
                                 codebook_df(spark, ANSWER_CODEBOOK), required=["correo", "trans"])


def intake_account(spark, sf):
    """Rows after each step of the clean intake, observed while its snapshot is written."""
    return _observed_intake(spark, sf)[0]


def conformance_observed(spark, sf):
    """Conformance of the cleaned rows, observed while their snapshot is written."""
    return _observed_intake(spark, sf)[1]


def bucketed_firsts(spark, sf):
    """First order of each listed customer, on snapshots in buckets: neither the semi-join nor
    the first per key shuffles."""
    one = lambda name: f"{name}_{uuid.uuid4().hex}"
    orders = write_bucketed(_t(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), one("orders"),
                            scratch_path(spark, "bucketed"), "o_custkey", 16, ["o_orderdate", "o_orderkey"])
    listed = write_bucketed(_t(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")),
                            one("listed"), scratch_path(spark, "bucketed"), "o_custkey", 16)
    found = orders.join(listed.hint("merge"), "o_custkey", "left_semi")
    return first_per_key(found, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


def semi_join_thinned(spark, sf):
    """A list too long to broadcast: lines of the dear orders, thinned by a bitmap before the join."""
    keys = _t(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("value"))
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return in_list(lines, "l_orderkey", keys, max_broadcast_rows=0)


def slugify(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", slug(F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias("code"))


ORDER_CODEBOOK = [
    ("o_orderstatus", "mc", "Order status", [("Finished", "F"), ("Open", "O")]),
    ("o_orderpriority", "mc", "Priority", [("Urgent", "1-URGENT"), ("High", "2-HIGH"),
                                           ("Medium", "3-MEDIUM"), ("Not specified", "4-NOT SPECIFIED"),
                                           ("Low", "5-LOW")]),
    ("o_custkey", "text", "Customer", []),
]


def decode_codes(spark, sf):
    o = _t(spark, sf, "orders")
    d = decode(o, codebook_df(spark, ORDER_CODEBOOK))
    return d.select("o_orderkey", "o_orderstatus_label", "o_orderpriority_label")


def conformance_q(spark, sf):
    o = _t(spark, sf, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return conformance(o, codebook_df(spark, ORDER_CODEBOOK),
                       required=["o_custkey", "o_orderstatus", "o_orderpriority"])


def category_order_median(spark, sf):
    """Levels of raw rows by the exact median of a measure."""
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return reorder_by(o, "o_orderpriority", "o_totalprice", name="ord").select("o_orderkey", "ord")


def draw_by_rank(spark, sf):
    """The selection as shipped: score, rank, and draw by the hash of the rank id."""
    scored = score_applicants(_customers(spark, sf), _score_cfg(rank=True))
    cfg = DrawConfig(seats=SEATS, seed=SEED, weight="score", guaranteed_col="c_nationkey", guaranteed_value=7,
                     list_col="c_name", on_short="all")
    return seat_draw(scored, cfg, special_list=_special_list(spark, sf)).select("id", "c_custkey", "score")


def density_continuous(spark, sf):
    """Density of a column with many distinct values (exact quartiles by refinement)."""
    d = density(_t(spark, sf, "lineitem"), "l_extendedprice", points=512)
    return d.select("i", _r9("x").alias("x"), F.round("density", 12).alias("density"))


def mean_strict_all(spark, sf):
    """The strict mean of a whole table: null as soon as one value is no number."""
    c = _acct_text(spark, sf)
    good = c.filter(~F.col("c_nationkey").between(3, 9))
    return (mean_strict(good, "bal_txt").select(F.lit("good").alias("rows"), _r9("mean").alias("mean"))
            .unionByName(mean_strict(c, "bal_txt").select(F.lit("all").alias("rows"), _r9("mean").alias("mean"))))


def _answers(people: DataFrame) -> DataFrame:
    """The form's answers, as codes, made from a customer's columns."""
    n = F.col("c_nationkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (n % len(v) + 1).cast("int"))
    return people.select(
        "c_custkey", F.col("c_name").alias("nombre"),
        pick("femenino", "masculino", "no_binario", "queer_ag_nero_otro").alias("genero"),
        F.when(F.col("c_acctbal") >= 0, pick("sí", "no", "prefiero_no_decirlo")).alias("lgbt"),
        pick("ninguno", "principiante", "lo_vi_en_la_universidad_pero_no_entend_nada", "intermedio").alias("nivel_r"),
        F.concat(F.lit("area_"), n.cast("string")).alias("areas"),
        F.concat(F.lit("pais_"), (n % 12).cast("string")).alias("pais"),
        F.when(n % 11 != 0, (n + 18).cast("string")).otherwise(F.lit("30d")).alias("edad"),
        pick("sí", "no").alias("trans"), pick("media", "superior").alias("educacion"),
        pick("no", "sí", "no").alias("nivel_programacion"))


SQL_ANSWERS = """
SELECT c_custkey, c_name AS nombre, ['femenino', 'masculino', 'no_binario', 'queer_ag_nero_otro'][c_nationkey % 4 + 1] AS genero,
  CASE WHEN c_acctbal >= 0 THEN ['sí', 'no', 'prefiero_no_decirlo'][c_nationkey % 3 + 1] END AS lgbt,
  ['ninguno', 'principiante', 'lo_vi_en_la_universidad_pero_no_entend_nada', 'intermedio'][c_nationkey % 4 + 1] AS nivel_r,
  'area_' || c_nationkey AS areas, 'pais_' || (c_nationkey % 12) AS pais,
  CASE WHEN c_nationkey % 11 <> 0 THEN CAST(c_nationkey + 18 AS VARCHAR) ELSE '30d' END AS edad,
  ['sí', 'no'][c_nationkey % 2 + 1] AS trans, ['media', 'superior'][c_nationkey % 2 + 1] AS educacion,
  ['no', 'sí', 'no'][c_nationkey % 3 + 1] AS nivel_programacion"""
SQL_DATOS = f"""{SQL_ADMITTED},
coded AS (SELECT *, 'inscritos/as' AS tipo FROM ({SQL_ANSWERS} FROM admitted)
          UNION ALL SELECT *, 'postulaciones' FROM ({SQL_ANSWERS} FROM customer)),
datos AS (
  SELECT c_custkey, tipo, regexp_replace(CASE genero WHEN 'queer_ag_nero_otro' THEN 'queer, agénero, otros' ELSE genero END,
         '_', ' ') AS genero, lgbt,
         CASE nivel_r WHEN 'lo_vi_en_la_universidad_pero_no_entend_nada'
              THEN 'lo vi en la universidad,' || chr(10) || 'pero no entendí nada' ELSE nivel_r END AS nivel_r,
         CASE nivel_r WHEN 'intermedio' THEN 1 WHEN 'principiante' THEN 2 WHEN 'ninguno' THEN 3 ELSE 4 END AS nivel_r_ord,
         replace(areas, '_', ' ') AS areas, upper(pais[1]) || pais[2:] AS pais,
         CASE WHEN edad <> '30d' THEN CAST(edad AS DOUBLE) END AS edad FROM coded)"""


def _datos(spark, sf) -> DataFrame:
    # the draw is stored, as the explore job reads it from the select job's output
    return explore.harmonise(_answers(stored(_admitted(spark, sf))), _answers(_t(spark, sf, "customer")))


def harmonise_q(spark, sf):
    """Both populations stacked and labelled by hand repairs."""
    return _datos(spark, sf).select("c_custkey", "tipo", "genero", "lgbt", "nivel_r",
                                    F.col("nivel_r_ord").cast("long").alias("nivel_r_ord"), "areas", "pais", "edad")


def harmonise_codebook(spark, sf):
    """The same with exact labels from a codebook."""
    book = codebook_df(spark, [("genero", "mc", "", [("Femenino", "femenino"), ("Masculino", "masculino"), ("No binario", "no_binario")]),
                               ("pais", "select", "", [(f"País {i}", f"pais_{i}") for i in range(6)])])
    d = explore.harmonise(_answers(_admitted(spark, sf)), _answers(_t(spark, sf, "customer")), codebook=book)
    return d.select("c_custkey", "tipo", "genero", "pais", "areas")


def _chart(name: str, *cols: str) -> Query:
    def query(spark, sf):
        t = getattr(explore, name)(_datos(spark, sf))
        return t.select(*[_r9(c).alias(c) if c == "p" else c for c in cols])
    query.__doc__ = f"The chart table ``{name}`` as shipped."
    return query


def chart_age_density(spark, sf):
    """The chart table ``age_density`` as shipped."""
    return explore.age_density(_datos(spark, sf)).select("i", _r9("x").alias("x"), _r9("density").alias("density"))


def _report(spark, sf, who: DataFrame) -> DataFrame:
    """The tables of ``profile_report`` as one: table name and a row as text."""
    out = None
    for name, t in sorted(profile_report(who, country="pais_3").items()):
        row = t.select(F.lit(name).alias("name"), F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(t.columns)]),
                                                            {"ignoreNullFields": "false"}).alias("row"))
        out = row if out is None else out.unionByName(row)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row").alias("n_distinct"),
                                   F.min("row").alias("least"), F.max("row").alias("largest"))


def report_applicants(spark, sf):
    return _report(spark, sf, _answers(_t(spark, sf, "customer")).drop("c_custkey"))


def report_one_scan(spark, sf):
    """All count tables of the report and its mean from one scan, in print order."""
    r = report_counts(_answers(_t(spark, sf, "customer")).withColumn("edad", F.regexp_replace("edad", "30d", "30")))
    return r.withColumn("mean", _r9("mean"))


def chart_tables_one_scan(spark, sf):
    """The five charts of counts, from one scan of both populations."""
    tables = explore.chart_tables(_datos(spark, sf))
    out = None
    for name, (level, ord_) in {"gender": ("genero", None), "lgbt": ("lgbt", None), "level": ("nivel_r", "nivel_r_ord"),
                                "areas": ("areas", "areas_ord"), "countries": ("pais", "pais_ord")}.items():
        t = tables[name]
        part = t.select(F.lit(name).alias("chart"), F.col(level).alias("level"),
                        (F.col("tipo") if "tipo" in t.columns else F.lit(None).cast("string")).alias("tipo"), "n", _r9("p").alias("p"),
                        (F.col(ord_) if ord_ else F.lit(None)).cast("long").alias("ord"))
        out = part if out is None else out.unionByName(part)
    return out


def report_admitted(spark, sf):
    return _report(spark, sf, _answers(_admitted(spark, sf)).drop("c_custkey"))


def _codebook_file(spark, sf) -> str:
    """A form definition made from the values of ``orders``, written as a text file."""
    from seatwise.sources.writers import write_text_lines

    o = _t(spark, sf, "orders")
    part = lambda q: (o.groupBy(F.col(q).alias("v")).agg(F.lit(1)).orderBy("v")
                      .agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('    "Label of '), F.col("v"), F.lit("\": '"), F.col("v"), F.lit("'")))), "\n").alias("x"))
                      .select(F.concat(F.lit(f"{q}:\n  type: mc\n  label: Question on\n    {q}\n  options:\n"), "x").alias("value")))
    text = part("o_orderstatus").unionByName(part("o_orderpriority"))
    whole = text.agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("value"))
    return write_text_lines(whole, "value", scratch_path(spark, "form"))


def codebook_file(spark, sf):
    """A codebook read from its definition file, used to decode and check."""
    from seatwise.sources.codebook import read_codebook

    book = read_codebook(spark, _codebook_file(spark, sf))
    d = decode(_t(spark, sf, "orders"), book).groupBy("o_orderstatus_label", "o_orderpriority_label").agg(F.count(F.lit(1)).alias("n"))
    return d


QUERIES: dict[str, Query] = {
    "flagship_seat_draw": flagship_seat_draw,
    "weighted_sample": weighted_sample_q,
    "weighted_sample_threshold": weighted_sample_threshold_q,
    "draw_chances": draw_chances,
    "uniform_sample": uniform_sample_q,
    "first_submission": first_submission,
    "first_submission_window": first_submission_window,
    "clean_intake": clean_intake_q,
    "clean_intake_linked": clean_intake_linked,
    "intake_account": intake_account,
    "conformance_observed": conformance_observed,
    "stream_clean_intake": stream_clean_intake,
    "stream_final_intake": stream_final_intake,
    "exclusions": exclusions_q,
    "score_rules": score_rules_q,
    "ordinal_rank": ordinal_rank,
    "ordinal_rank_window": ordinal_rank_window,
    "head_ranked": head_ranked,
    "tail_ranked": tail_ranked,
    "semi_join_list": semi_join_list,
    "line_list_semi_join": line_list_semi_join,
    "semi_join_thinned": semi_join_thinned,
    "bucketed_firsts": bucketed_firsts,
    "flagship_union_form": flagship_union_form,
    "count_one": count_one,
    "count_two": count_two,
    "count_sorted": count_sorted,
    "count_having": count_having_q,
    "answer_counts": answer_counts,
    "group_share": group_share,
    "total_share": total_share,
    "filter_out_nulls_kept": filter_out_nulls_kept,
    "lump_top_n": lump_top_n_q,
    "category_order": category_order,
    "mean_strict": mean_strict_q,
    "mean_na_rm": mean_na_rm,
    "recipient_list": recipient_list_q,
    "recipient_file": recipient_file,
    "drop_prefix_relocate": drop_prefix_relocate,
    "sort_text_number": sort_text_number,
    "text_squish_lower": text_squish_lower,
    "email_filter": email_filter,
    "replace_first": replace_first_q,
    "repair_list": repair_list,
    "wrap_label": wrap_label,
    "wrap_label_balanced": wrap_label_balanced,
    "category_order_collated": category_order_collated,
    "count_collated": count_collated,
    "title_case": title_case_q,
    "percent_label": percent_label_q,
    "recode": recode_q,
    "across_strings": across_strings_q,
    "harmonise_union": harmonise_union,
    "cutoff_inclusive": cutoff_inclusive,
    "cutoff_text_time": cutoff_text_time,
    "distinct_rows": distinct_rows,
    "density": density_q,
    "density_exact": density_exact,
    "display_labels": display_labels_q,
    "csv2_roundtrip": csv2_roundtrip,
    "snapshot_anonymised": snapshot_anonymised,
    "column_profile": column_profile_q,
    "profile_merged": profile_merged,
    "glimpse": glimpse_q,
    "admitted_snapshot": admitted_snapshot,
    "admitted_by_nation": admitted_by_nation,
    "admitted_mean_balance": admitted_mean_balance,
    "slugify": slugify,
    "decode_codes": decode_codes,
    "conformance": conformance_q,
    "category_order_median": category_order_median,
    "draw_by_rank": draw_by_rank,
    "density_continuous": density_continuous,
    "mean_strict_all": mean_strict_all,
    "harmonise": harmonise_q,
    "harmonise_codebook": harmonise_codebook,
    "chart_gender_share": _chart("gender_share", "genero", "tipo", "n", "p", "label"),
    "chart_lgbt_share": _chart("lgbt_share", "lgbt", "tipo", "n", "p", "label"),
    "chart_level_count": _chart("level_count", "nivel_r", "tipo", "nivel_r_ord", "n", "p"),
    "chart_top_areas": _chart("top_areas_share", "areas", "tipo", "n", "p", "areas_ord", "label"),
    "chart_top_countries": _chart("top_countries_share", "pais", "n", "p", "pais_ord", "label"),
    "chart_age_density": chart_age_density,
    "report_applicants": report_applicants,
    "report_one_scan": report_one_scan,
    "chart_tables_one_scan": chart_tables_one_scan,
    "report_admitted": report_admitted,
    "codebook_file": codebook_file,
}


# ---------------------------------------------------------------------------
# SQL forms (DuckDB dialect; the driver tables are views of the same names)
# ---------------------------------------------------------------------------

def _sql_sample(weight_sql: str, source: str) -> str:
    return (f"SELECT c_custkey FROM {source} WHERE {weight_sql} > 0 "
            f"ORDER BY {sql_key('c_custkey', weight_sql)}, c_custkey LIMIT {SEATS}")


SQL_SCORED = f"(SELECT *, {SQL_SCORE} FROM (SELECT *, c_mktsegment AS seg FROM customer) c) x)"

SQL_NRD0 = """
WITH v AS (SELECT CAST(p_size AS DOUBLE) AS x FROM part WHERE p_size IS NOT NULL),
s AS (SELECT count(*) AS n, stddev_samp(x) AS sd, quantile_cont(x, 0.25) AS q1,
             quantile_cont(x, 0.75) AS q3, min(x) AS mn, max(x) AS mx FROM v),
b AS (SELECT *, 0.9 * CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34)
                           WHEN sd > 0 THEN sd WHEN abs(mn) > 0 THEN abs(mn) ELSE 1.0 END
                  * pow(n, -0.2) AS h FROM s)"""

SQL_DENSITY_BINNED = SQL_NRD0 + """,
g AS (SELECT *, mn - 4 * h AS lo, mx + 4 * h AS up FROM b),
w AS (SELECT floor((v.x - g.lo) / ((g.up - g.lo) / 511.0)) AS ix,
             (v.x - g.lo) / ((g.up - g.lo) / 511.0) - floor((v.x - g.lo) / ((g.up - g.lo) / 511.0)) AS fx
      FROM v, g),
bins AS (SELECT idx, sum(wt) AS c
         FROM (SELECT ix AS idx, 1.0 - fx AS wt FROM w UNION ALL SELECT ix + 1, fx FROM w)
         WHERE idx >= 0 AND idx < 512 GROUP BY idx),
d AS (SELECT r.j, greatest(0.0, sum(bins.c / g.n * exp(-0.5 * pow(abs(bins.idx - r.j) * (2 * (g.up - g.lo) / 1023.0)
                                                                / g.h, 2)) / (g.h * sqrt(2 * pi())))) AS dens
      FROM range(512) r(j), bins, g GROUP BY r.j),
u AS (SELECT i, g.mn + i * (g.mx - g.mn) / 511.0 AS xu, g.lo, g.up FROM range(512) t(i), g),
uj AS (SELECT i, xu, least(floor((xu - lo) / ((up - lo) / 511.0)), 511) AS j0,
              (xu - lo) / ((up - lo) / 511.0) - least(floor((xu - lo) / ((up - lo) / 511.0)), 511) AS t FROM u)
SELECT CAST(uj.i AS INTEGER) AS i, round(uj.xu, 9) AS x,
       round(d0.dens + uj.t * (coalesce(d1.dens, d0.dens) - d0.dens), 9) AS density
FROM uj JOIN d d0 ON d0.j = uj.j0 LEFT JOIN d d1 ON d1.j = uj.j0 + 1"""

SQL_DENSITY = """
WITH v AS (SELECT CAST(p_size AS DOUBLE) AS x FROM part WHERE p_size IS NOT NULL),
s AS (SELECT count(*) AS n, stddev_samp(x) AS sd, quantile_cont(x, 0.25) AS q1,
             quantile_cont(x, 0.75) AS q3, min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT *, 0.9 * CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34)
                           WHEN sd > 0 THEN sd WHEN abs(lo) > 0 THEN abs(lo) ELSE 1.0 END
                  * pow(n, -0.2) AS h FROM s),
g AS (SELECT CAST(i AS INTEGER) AS i, lo + i * (hi - lo) / 63.0 AS gx, n, h FROM b, range(64) t(i)),
c AS (SELECT x, count(*) AS c FROM v GROUP BY x)
SELECT g.i, round(g.gx, 9) AS x,
       round(sum(c.c * exp(-0.5 * pow((g.gx - c.x) / g.h, 2))) / (g.n * g.h * sqrt(2 * pi())), 9) AS density
FROM g, c GROUP BY g.i, g.gx, g.n, g.h
"""

ORACLE_SQL: dict[str, str] = {
    "flagship_seat_draw": f"""
WITH {SQL_ADMITTED}
SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS p
FROM admitted GROUP BY c_mktsegment""",
    "weighted_sample": _sql_sample("score", SQL_SCORED),
    "weighted_sample_threshold": _sql_sample("score", SQL_SCORED),
    "draw_chances": f"""
WITH RECURSIVE scored AS (SELECT c_custkey, score FROM {SQL_SCORED}),
c AS (SELECT score AS w, count(*) AS n FROM scored WHERE score > 0 GROUP BY 1),
b AS (SELECT 0 AS i, {SEATS} / sum(n * w) AS lo,
             CASE WHEN sum(n) > {SEATS} THEN greatest({SEATS} / sum(n * w), -ln(1 - {SEATS} / sum(n)) / min(w)) END AS hi FROM c
      UNION ALL
      SELECT i + 1, CASE WHEN sum(n * (1 - exp(-w * (lo + hi) / 2))) < {SEATS} THEN (lo + hi) / 2 ELSE lo END,
             CASE WHEN sum(n * (1 - exp(-w * (lo + hi) / 2))) < {SEATS} THEN hi ELSE (lo + hi) / 2 END
      FROM b, c WHERE i < 80 GROUP BY i, lo, hi)
SELECT c_custkey, score, CASE WHEN NOT score > 0 THEN 0.0 WHEN hi IS NULL THEN 1.0
  ELSE round(1 - exp(-score * (lo + hi) / 2), 9) END::DOUBLE AS chance
FROM scored, (SELECT lo, hi FROM b WHERE i = 80)""",
    "uniform_sample": _sql_sample("1.0", "customer"),
    "first_submission": f"""
SELECT o_custkey, o_orderkey, o_totalprice FROM ({SQL_ORDERS_TIMED}) o
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY t ASC NULLS LAST, o_orderkey) = 1""",
    "first_submission_window": f"""
SELECT o_custkey, o_orderkey, o_totalprice FROM ({SQL_ORDERS_TIMED}) o
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY t ASC NULLS LAST, o_orderkey) = 1""",
    "clean_intake": SQL_CLEAN_INTAKE,
    "clean_intake_linked": SQL_CLEAN_INTAKE_LINKED,
    "intake_account": SQL_INTAKE_ACCOUNT,
    "conformance_observed": f"""
WITH o AS ({SQL_CLEAN_INTAKE})
SELECT 'correo' AS question_id, count(*) AS n, count(*) - count(correo) AS n_missing, CAST(0 AS BIGINT) AS n_out_of_domain FROM o
UNION ALL
SELECT 'trans', count(*), count(*) - count(trans), count(*) FILTER (WHERE trans NOT IN ('sí')) FROM o
UNION ALL
SELECT 'genero', count(*), CAST(0 AS BIGINT), count(*) FILTER (WHERE genero NOT IN ('click', 'view', 'purchase')) FROM o""",
    "profile_merged": "\nUNION ALL ".join(_sql_profile(c) for c in PROFILED),
    "semi_join_thinned": """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)""",
    "bucketed_firsts": """
SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
    "exclusions": """
SELECT p_partkey FROM part
WHERE p_type <> 'ECONOMY' AND nullif(p_brand, 'Brand#7') <> 'Brand#1' AND p_size <> 50 AND p_size <> 49""",
    "score_rules": f"""
SELECT c_custkey, score, row_number() OVER (ORDER BY score DESC NULLS LAST, c_custkey) AS id
FROM (SELECT *, {SQL_SCORE} FROM (SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) c) x) y""",
    "ordinal_rank": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS id FROM orders",
    "ordinal_rank_window": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS id FROM orders",
    "head_ranked": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6",
    "tail_ranked": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC, o_orderkey DESC LIMIT 6",
    "semi_join_list": f"SELECT c_custkey, c_name FROM customer WHERE c_name IN ({SQL_SPECIAL_LIST})",
    "count_one": "SELECT nullif(c_mktsegment, 'MACHINERY') AS seg, count(*) AS n FROM customer GROUP BY 1",
    "count_two": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "count_sorted": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1",
    "count_having": """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2
HAVING l_linestatus = 'F' AND count(*) > 100""",
    "group_share": """
WITH c AS (SELECT n_regionkey, c_mktsegment, count(*) AS n
           FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
f AS (SELECT * FROM c WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD'))
SELECT n_regionkey, c_mktsegment, n, round(n / sum(n) OVER (PARTITION BY n_regionkey), 9) AS p FROM f""",
    "total_share": """
SELECT c_nationkey, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS p
FROM customer GROUP BY 1""",
    "filter_out_nulls_kept": """
SELECT c_custkey, seg FROM (SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS seg FROM customer)
WHERE NOT coalesce(seg = 'BUILDING', false)""",
    "lump_top_n": """
WITH c AS (SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1),
r AS (SELECT *, rank() OVER (ORDER BY n DESC) AS rk FROM c),
o AS (SELECT *, sum(CASE WHEN rk > 10 THEN 1 ELSE 0 END) OVER () AS n_out FROM r),
m AS (SELECT p_brand, CASE WHEN rk <= 10 OR n_out <= 1 THEN p_brand ELSE 'Other brands' END AS lumped FROM o)
SELECT m.lumped AS p_brand, count(*) AS n FROM part LEFT JOIN m USING (p_brand) GROUP BY 1""",
    "category_order": """
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT *, n / sum(n) OVER () AS p FROM c)
SELECT o_orderpriority, n,
       row_number() OVER (ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 END
                          ASC NULLS LAST, o_orderpriority) AS ord_fixed,
       row_number() OVER (ORDER BY p, o_orderpriority) AS ord_by_share
FROM p""",
    "mean_strict": """
WITH t AS (SELECT c_nationkey, CASE WHEN c_nationkey NOT BETWEEN 3 AND 9 THEN c_acctbal END AS x FROM customer)
SELECT c_nationkey, round(CASE WHEN count(*) = count(x) THEN avg(x) END, 9) AS mean FROM t GROUP BY 1""",
    "mean_na_rm": """
WITH t AS (SELECT c_nationkey, CASE WHEN c_nationkey NOT BETWEEN 3 AND 9 THEN c_acctbal END AS x FROM customer)
SELECT c_nationkey, round(avg(x), 9) AS mean FROM t GROUP BY 1""",
    "recipient_list": """
WITH r AS (SELECT CASE WHEN c_nationkey <> 3 THEN c_name END AS mail, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer)
SELECT CAST((i - 1) // 500 AS BIGINT) AS batch,
       string_agg(coalesce(mail, 'NA'), ', ' ORDER BY i) AS recipients FROM r GROUP BY 1""",
    "text_squish_lower": r"""
SELECT doc_id, md5(lower(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')))) AS h FROM documents""",
    "email_filter": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '@.*\.')",
    "replace_first": "SELECT p_partkey, regexp_replace(replace(p_name, ' ', '_'), '_', ' ') AS v FROM part",
    "repair_list": """
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name,
       'r', 'R'), 'o', '0'), 'ge', 'GE'), 'b', '') AS v FROM part""",
    "wrap_label": r"""
SELECT p_partkey, regexp_replace(regexp_replace(
         trim(regexp_replace(concat_ws(' ', p_name, p_type, p_brand, p_name), '[\s\p{Z}]+', ' ', 'g')),
         '(.{1,12})( +|$)', '\1' || chr(10), 'g'), '\n+$', '') AS v FROM part""",
    "title_case": """
SELECT p_partkey, array_to_string(list_transform(string_split(lower(concat_ws(' ', p_name, p_type)), ' '),
       lambda w: upper(w[1]) || w[2:]), ' ') AS v FROM part""",
    "percent_label": """
SELECT l_returnflag, count(*) AS n,
       printf('%.1f%%', round_even(count(*) / sum(count(*)) OVER () * 100.0, 1)) AS label
FROM lineitem GROUP BY 1""",
    "recode": """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open'
                   ELSE o_orderstatus END AS status FROM orders""",
    "across_strings": """
WITH c AS (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 's' ELSE 'no' END AS flag
           FROM customer)
SELECT c_custkey,
       CASE WHEN regexp_matches(c_name, '^s$') THEN 'sí' ELSE c_name END AS c_name,
       CASE WHEN regexp_matches(c_mktsegment, '^s$') THEN 'sí' ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN regexp_matches(flag, '^s$') THEN 'sí' ELSE flag END AS flag FROM c""",
    "harmonise_union": f"""
WITH {SQL_ADMITTED}
SELECT c_custkey, c_mktsegment, c_nationkey, 'inscritos/as' AS tipo FROM admitted
UNION ALL
SELECT c_custkey, c_mktsegment, c_nationkey, 'postulaciones' AS tipo FROM customer""",
    "cutoff_inclusive": "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'",
    "cutoff_text_time": "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem",
    "density": SQL_DENSITY_BINNED,
    "density_exact": SQL_DENSITY,
    "csv2_roundtrip": """
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal,
       CAST((s_suppkey % 9 + 1) * 1000 + 500 AS BIGINT) AS thousands, 1234 + (s_suppkey % 10) / 10.0 AS thousands_dec,
       CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS some, 'a;"b"' || chr(10) || s_name || '; c' AS odd
FROM supplier""",
    "snapshot_anonymised": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "column_profile": """
SELECT 'c_custkey' AS "column", count(*) AS n, count(c_custkey) AS n_non_null,
       count(DISTINCT c_custkey) AS n_distinct FROM customer
UNION ALL SELECT 'c_name', count(*), count(c_name), count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'c_nationkey', count(*), count(c_nationkey), count(DISTINCT c_nationkey) FROM customer
UNION ALL SELECT 'c_acctbal', count(*), count(c_acctbal), count(DISTINCT c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer""",
    "slugify": """
SELECT p_partkey, trim(regexp_replace(lower(concat_ws(' ', p_brand, p_name, p_type)), '[^a-z0-9]+', '_', 'g'), '_')
       AS code FROM part""",
    "decode_codes": """
SELECT o_orderkey,
       CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END AS o_orderstatus_label,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
            WHEN '4-NOT SPECIFIED' THEN 'Not specified' WHEN '5-LOW' THEN 'Low' END AS o_orderpriority_label
FROM orders""",
    "conformance": """
WITH o AS (SELECT o_custkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders)
SELECT 'o_custkey' AS question_id, count(*) AS n, count(*) - count(o_custkey) AS n_missing,
       CAST(0 AS BIGINT) AS n_out_of_domain FROM o
UNION ALL
SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus),
       count(*) FILTER (WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O')) FROM o
UNION ALL
SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority),
       count(*) FILTER (WHERE o_orderpriority IS NOT NULL AND o_orderpriority NOT IN
                        ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) FROM o""",
    "stream_clean_intake": SQL_CLEAN_INTAKE,
    "stream_final_intake": SQL_CLEAN_INTAKE,
    "line_list_semi_join": f"SELECT c_custkey, c_name FROM customer WHERE c_name IN ({SQL_SPECIAL_LIST})",
    "flagship_union_form": f"WITH {SQL_ADMITTED} SELECT c_custkey, c_mktsegment, score FROM admitted",
    "recipient_file": """
WITH r AS (SELECT CASE WHEN c_nationkey <> 3 THEN c_name END AS mail, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer)
SELECT string_agg(coalesce(mail, 'NA'), ', ' ORDER BY i) AS value FROM r GROUP BY (i - 1) // 500""",
    "drop_prefix_relocate": """
SELECT o_custkey, CAST(1.0 AS DOUBLE) AS w, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""",
    "sort_text_number": """
SELECT c_custkey,
       row_number() OVER (ORDER BY CAST(c_acctbal AS VARCHAR) DESC NULLS LAST, c_custkey) AS id_text,
       row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS id_num
FROM customer""",
    "display_labels": r"""
WITH p AS (
  SELECT p_partkey, lower(p_type) || '_' || CAST(p_size AS VARCHAR) AS genero, lower(p_type) AS nivel_r,
         replace(p_name, ' ', '_') || '_de_' || lower(p_type) AS areas,
         lower(replace(p_brand, '#', '_')) AS pais FROM part),
l AS (
  SELECT p_partkey,
         regexp_replace(CASE genero WHEN 'queer_ag_nero_otro' THEN 'queer, agénero, otros' ELSE genero END,
                        '_', ' ') AS genero,
         CASE nivel_r WHEN 'lo_vi_en_la_universidad_pero_no_entend_nada'
              THEN 'lo vi en la universidad,' || chr(10) || 'pero no entendí nada' ELSE nivel_r END AS nivel_r,
         regexp_replace(trim(regexp_replace(
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
             replace(areas, '_', ' '), 'g a', 'gía'), 'm a', 'mía'), 'f a', 'fía'), 'pol tica', 'política'),
             'ci n', 'ción'),
           '[\s\p{Z}]+', ' ', 'g')), '(.{1,30})( +|$)', '\1' || chr(10), 'g') AS areas_w,
         array_to_string(list_transform(string_split(lower(
           CASE pais WHEN 'm_xico' THEN 'méxico' WHEN 'per' THEN 'perú' WHEN 'espa_a' THEN 'españa'
                ELSE pais END), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS pais
  FROM p),
lv AS (
  SELECT nivel_r, row_number() OVER (ORDER BY CASE nivel_r WHEN 'avanzado' THEN 0 WHEN 'intermedio' THEN 1
                                       WHEN 'principiante' THEN 2 WHEN 'ninguno' THEN 3 END ASC NULLS LAST,
                                     nivel_r) AS nivel_r_ord
  FROM (SELECT DISTINCT nivel_r FROM l WHERE nivel_r IS NOT NULL))
SELECT p_partkey, genero, l.nivel_r, lv.nivel_r_ord, regexp_replace(areas_w, '\n+$', '') AS areas, pais
FROM l LEFT JOIN lv ON l.nivel_r = lv.nivel_r""",
    "glimpse": """
WITH h AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)
SELECT 'c_custkey' AS "column", 'bigint' AS type,
       string_agg(CAST(c_custkey AS VARCHAR), ', ' ORDER BY c_custkey) AS sample FROM h
UNION ALL SELECT 'c_name', 'string', string_agg(c_name, ', ' ORDER BY c_custkey) FROM h
UNION ALL SELECT 'c_nationkey', 'int', string_agg(CAST(c_nationkey AS VARCHAR), ', ' ORDER BY c_custkey) FROM h
UNION ALL SELECT 'c_acctbal', 'double', string_agg(CAST(c_acctbal AS VARCHAR), ', ' ORDER BY c_custkey) FROM h
UNION ALL SELECT 'c_mktsegment', 'string', string_agg(c_mktsegment, ', ' ORDER BY c_custkey) FROM h""",
    "admitted_snapshot": f"WITH {SQL_ADMITTED} SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, seg FROM admitted",
    "admitted_by_nation": f"WITH {SQL_ADMITTED} SELECT c_nationkey, count(*) AS n FROM admitted GROUP BY 1",
    "admitted_mean_balance": f"""
WITH {SQL_ADMITTED}
SELECT c_mktsegment, round(avg(TRY_CAST(CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(c_acctbal AS VARCHAR) END
                                        AS DOUBLE)), 9) AS mean
FROM admitted GROUP BY 1""",
    "answer_counts": """
WITH c AS (SELECT nullif(c_mktsegment, 'MACHINERY') AS seg, c_nationkey, c_mktsegment FROM customer)
SELECT 'seg' AS "column", seg AS value, count(*) AS n FROM c GROUP BY seg
UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM c GROUP BY c_nationkey
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM c GROUP BY c_mktsegment""",
}


def _sql_density(column: str, table: str, digits: int = 9) -> str:
    return (SQL_DENSITY_BINNED.replace("CAST(p_size AS DOUBLE) AS x FROM part WHERE p_size IS NOT NULL",
                                       f"CAST({column} AS DOUBLE) AS x FROM {table} WHERE {column} IS NOT NULL")
            .replace("d0.dens), 9)", f"d0.dens), {digits})"))


# the digits that the labeller picks: one finer than the least gap, less an idle last one
SQL_AUTO = """
v AS (SELECT DISTINCT p * 100.0 AS v FROM s),
gap AS (SELECT min(d) AS d FROM (SELECT v - lag(v) OVER (ORDER BY v) AS d FROM v)),
dig AS (SELECT CASE WHEN d IS NULL OR d < 1.4901161193847656e-08 THEN 0 ELSE CAST(1 - floor(log10(d)) AS INTEGER) END AS k, d FROM gap),
fin AS (SELECT greatest(0, CASE WHEN any_value(d) IS NULL OR any_value(d) < 1.4901161193847656e-08 THEN 0
          WHEN bool_and(CAST(round_even(v * pow(10, k), 0) AS BIGINT) % 10 = 0) THEN any_value(k) - 1 ELSE any_value(k) END) AS k
        FROM v, dig)"""


def _sql_lump(col: str, n: int, other: str, by_tipo: bool) -> str:
    keep = ", tipo" if by_tipo else ""
    return f"""
WITH {SQL_DATOS}, adm AS (SELECT * FROM datos WHERE tipo = 'inscritos/as'),
c AS (SELECT {col}, count(*) AS n FROM adm WHERE {col} IS NOT NULL GROUP BY 1),
r AS (SELECT *, rank() OVER (ORDER BY n DESC) AS rk FROM c),
o AS (SELECT *, sum(CASE WHEN rk > {n} THEN 1 ELSE 0 END) OVER () AS n_out FROM r),
m AS (SELECT {col}, CASE WHEN rk <= {n} OR n_out <= 1 THEN {col} ELSE {other} END AS lumped FROM o),
k AS (SELECT m.lumped AS {col}{keep}, count(*) AS n FROM adm LEFT JOIN m USING ({col}) GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER () AS p FROM k)
SELECT {col}{keep}, n, round(p, 9) AS p,
       row_number() OVER (ORDER BY p, CAST({col} = {other} AS INTEGER), {col}) AS {col}_ord,
       printf('%.1f%%', round_even(p * 100.0, 1)) AS label FROM s"""


def _sql_report(rows: str) -> str:
    def one(name: str, cols: str, source: str = "a") -> str:
        fields = ", ".join(f"'{c}', CAST({c} AS VARCHAR)" for c in sorted(cols.split()))
        return f"SELECT '{name}' AS name, CAST(json_object({fields}) AS VARCHAR) AS r FROM {source}"
    count = lambda keys: f"(SELECT {keys}, count(*) AS n FROM a GROUP BY ALL)"
    everything = "nombre genero lgbt nivel_r areas pais edad trans educacion nivel_programacion"
    parts = [one(f"by_{k}", f"{c} n", count(c)) for k, c in (
        ("gender", "genero"), ("country", "pais"), ("level", "nivel_r"), ("programming", "nivel_programacion"),
        ("trans", "trans"), ("education", "educacion"), ("area", "areas"))]
    parts += [one("mean_age", "mean", "(SELECT CAST(NULL AS DOUBLE) AS mean)"),
              one("country_trans", "pais trans n", count("pais, trans") + " WHERE trans = 'sí'"),
              one("from_country", everything, "a WHERE pais = 'pais_3'"), one("trans_yes", everything, "a WHERE trans = 'sí'"),
              one("by_age", everything)]
    parts += [f"SELECT 'all_answers', CAST(json_object('column', '{c}', 'n', CAST(n AS VARCHAR), 'value', {c}) AS VARCHAR) FROM {count(c)}"
              for c in ("genero", "pais", "nivel_r", "nivel_programacion", "trans", "educacion", "areas")]
    return (f"{rows}, t AS ({' UNION ALL '.join(parts)}) SELECT name, count(*) AS n, count(DISTINCT r) AS n_distinct, "
            "min(r) AS least, max(r) AS largest FROM t GROUP BY name")


def _sql_share(col: str, keep: str) -> str:
    return f"""
WITH {SQL_DATOS},
c AS (SELECT {col}, tipo, count(*) AS n FROM datos GROUP BY 1, 2),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY tipo) AS p FROM c WHERE {keep}), {SQL_AUTO}
SELECT {col}, tipo, n, round(p, 9) AS p, printf('%.' || k || 'f%%', round_even(p * 100.0, k)) AS label FROM s, fin"""


ORACLE_SQL |= {
    "category_order_median": """
WITH m AS (SELECT o_orderpriority, row_number() OVER (ORDER BY median(o_totalprice), o_orderpriority) AS ord
           FROM orders GROUP BY 1)
SELECT o_orderkey, ord FROM orders JOIN m USING (o_orderpriority)""",
    "draw_by_rank": f"""
WITH scored AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, c_custkey) AS id
                FROM (SELECT *, {SQL_SCORE} FROM (SELECT *, c_mktsegment AS seg FROM customer) c) x) y),
drawn AS (SELECT id FROM scored WHERE score > 0 ORDER BY {sql_key('id', 'score')}, id LIMIT {SEATS})
SELECT id, c_custkey, score FROM scored
WHERE id IN (SELECT id FROM drawn) OR c_nationkey = 7 OR c_name IN ({SQL_SPECIAL_LIST})""",
    "density_continuous": _sql_density("l_extendedprice", "lineitem", 12),
    "mean_strict_all": """
SELECT 'good' AS rows, round(avg(c_acctbal), 9) AS mean FROM customer WHERE c_nationkey NOT BETWEEN 3 AND 9
UNION ALL SELECT 'all', CASE WHEN count(*) FILTER (c_nationkey BETWEEN 3 AND 9) = 0 THEN round(avg(c_acctbal), 9) END FROM customer""",
    "harmonise": f"WITH {SQL_DATOS} SELECT c_custkey, tipo, genero, lgbt, nivel_r, CAST(nivel_r_ord AS BIGINT) AS nivel_r_ord, areas, pais, edad FROM datos",
    "harmonise_codebook": f"""
WITH {SQL_DATOS}
SELECT c_custkey, tipo,
  CASE genero WHEN 'femenino' THEN 'Femenino' WHEN 'masculino' THEN 'Masculino' WHEN 'no_binario' THEN 'No binario' ELSE genero END AS genero,
  CASE WHEN pais IN ('pais_0', 'pais_1', 'pais_2', 'pais_3', 'pais_4', 'pais_5') THEN 'País ' || pais[6:] ELSE pais END AS pais, areas
FROM coded""",
    "chart_gender_share": _sql_share("genero", "genero IN ('no binario', 'femenino', 'masculino')"),
    "chart_lgbt_share": _sql_share("lgbt", "NOT coalesce(lgbt = 'prefiero_no_decirlo', false)"),
    "chart_level_count": f"""
WITH {SQL_DATOS}, c AS (SELECT nivel_r, tipo, CAST(nivel_r_ord AS BIGINT) AS nivel_r_ord, count(*) AS n FROM datos GROUP BY 1, 2, 3)
SELECT nivel_r, tipo, nivel_r_ord, n, round(n / sum(n) OVER (PARTITION BY tipo), 9) AS p FROM c""",
    "chart_top_areas": _sql_lump("areas", 10, "'otras disciplinas'", True),
    "chart_top_countries": _sql_lump("pais", 7, "'Otros' || chr(10) || 'países'", False),
    "chart_age_density": f"WITH {SQL_DATOS}, v0 AS (SELECT edad FROM datos WHERE tipo = 'inscritos/as')," + _sql_density("edad", "v0").lstrip()[4:],
    "wrap_label_balanced": """
WITH RECURSIVE label AS (   -- every way to break each text, and the best of them
  SELECT DISTINCT concat_ws(' ', p_name, p_type, p_brand, p_name) AS t FROM part),
split AS (SELECT t, string_split(t, ' ') AS w FROM label),
lay AS (
  SELECT t, w, 0 AS done, 0::BIGINT AS cost, '' AS text, []::INTEGER[] AS counts FROM split
  UNION ALL
  SELECT t, w, done + k, cost + CASE WHEN done + k = len(w) OR length(line) > 18 THEN 0 ELSE (18 - length(line)) ** 2 END::BIGINT,
    text || CASE WHEN done > 0 THEN chr(10) ELSE '' END || line, list_prepend(k::INTEGER, counts)
  FROM (SELECT *, array_to_string(w[done + 1:done + k], ' ') AS line
        FROM (SELECT *, unnest(range(1, len(w) - done + 1)) AS k FROM lay WHERE done < len(w)))
  WHERE k = 1 OR length(line) <= 18),
best AS (SELECT t, text FROM lay WHERE done = len(w)
         QUALIFY row_number() OVER (PARTITION BY t ORDER BY cost, counts DESC) = 1)
SELECT p_partkey, text AS v FROM part JOIN best ON t = concat_ws(' ', p_name, p_type, p_brand, p_name)""",
    "category_order_collated": f"""
WITH l AS (SELECT p_partkey, CASE WHEN p_size <> 50 THEN {SPANISH}[p_partkey % {len(SPANISH)} + 1] END AS level FROM part),
o AS (SELECT level, row_number() OVER (ORDER BY CASE level WHEN 'oro' THEN 0 WHEN 'azul' THEN 1 ELSE 2 END, level COLLATE es) AS ord
      FROM (SELECT DISTINCT level FROM l WHERE level IS NOT NULL))
SELECT p_partkey, level, ord FROM l LEFT JOIN o USING (level)""",
    "count_collated": f"""
WITH c AS (SELECT CASE WHEN p_size <> 50 THEN {SPANISH}[p_partkey % {len(SPANISH)} + 1] END AS level, count(*) AS n FROM part GROUP BY 1)
SELECT level, n, CASE WHEN level IS NOT NULL THEN row_number() OVER (PARTITION BY level IS NULL ORDER BY level COLLATE es) END AS place,
  CASE WHEN level IS NOT NULL THEN row_number() OVER (PARTITION BY level IS NULL ORDER BY n, level COLLATE es) END AS by_count FROM c""",
    "report_one_scan": f"""
WITH a AS ({SQL_ANSWERS} FROM customer),
g AS (SELECT genero, pais, nivel_r, nivel_programacion, trans, educacion, areas, count(*) AS n,
        round(avg(CAST(replace(edad, '30d', '30') AS DOUBLE)), 9) AS mean,
        GROUPING(genero) AS g1, GROUPING(pais) AS g2, GROUPING(nivel_r) AS g3, GROUPING(nivel_programacion) AS g4,
        GROUPING(trans) AS g5, GROUPING(educacion) AS g6, GROUPING(areas) AS g7
      FROM a GROUP BY GROUPING SETS ((genero), (pais), (nivel_r), (nivel_programacion), (trans), (educacion), (areas), (), (pais, trans))),
t AS (SELECT *, CASE WHEN g2 + g5 = 0 THEN 9 WHEN g1 = 0 THEN 1 WHEN g2 = 0 THEN 2 WHEN g3 = 0 THEN 3 WHEN g4 = 0 THEN 4
        WHEN g5 = 0 THEN 5 WHEN g6 = 0 THEN 6 WHEN g7 = 0 THEN 7 ELSE 8 END AS k FROM g),
kept AS (SELECT * FROM t WHERE k < 9 OR trans = 'sí')
SELECT ['by_gender', 'by_country', 'by_level', 'by_programming', 'by_trans', 'by_education', 'by_area', 'mean_age', 'country_trans'][k] AS "table",
  genero, pais, nivel_r, nivel_programacion, trans, educacion, areas, n, CASE WHEN k = 8 THEN mean END AS mean,
  row_number() OVER (ORDER BY k, CASE WHEN k IN (2, 6, 7) THEN n END DESC NULLS LAST, genero NULLS LAST, pais NULLS LAST, nivel_r NULLS LAST,
    nivel_programacion NULLS LAST, trans NULLS LAST, educacion NULLS LAST, areas NULLS LAST) AS place
FROM kept""",
    "chart_tables_one_scan": f"""
WITH {SQL_DATOS},
sh AS (SELECT 'gender' AS chart, genero AS level, tipo, count(*) AS n FROM datos WHERE genero IN ('no binario', 'femenino', 'masculino') GROUP BY 2, 3
  UNION ALL SELECT 'lgbt', lgbt, tipo, count(*) FROM datos WHERE NOT coalesce(lgbt = 'prefiero_no_decirlo', false) GROUP BY 2, 3
  UNION ALL SELECT 'level', nivel_r, tipo, count(*) FROM datos GROUP BY 2, 3),
lv AS (SELECT 'areas' AS chart, areas AS level, count(*) AS n, 10 AS keep, 'otras disciplinas' AS other FROM datos WHERE tipo = 'inscritos/as' GROUP BY 2
  UNION ALL SELECT 'countries', pais, count(*), 7, 'Otros' || chr(10) || 'países' FROM datos WHERE tipo = 'inscritos/as' GROUP BY 2),
rk AS (SELECT *, rank() OVER (PARTITION BY chart ORDER BY n DESC) AS r FROM lv),
lu AS (SELECT *, CASE WHEN r > keep AND count(*) FILTER (r > keep) OVER (PARTITION BY chart) > 1 THEN other ELSE level END AS lumped FROM rk),
lc AS (SELECT chart, lumped AS level, other, sum(n)::BIGINT AS n FROM lu GROUP BY ALL),
lp AS (SELECT *, n / sum(n) OVER (PARTITION BY chart) AS p FROM lc)
SELECT chart, level, tipo, n, round(n / sum(n) OVER (PARTITION BY chart, tipo), 9) AS p,
  CASE WHEN chart = 'level' THEN CASE level WHEN 'intermedio' THEN 1 WHEN 'principiante' THEN 2 WHEN 'ninguno' THEN 3 ELSE 4 END END::BIGINT AS ord FROM sh
UNION ALL
SELECT chart, level, CASE WHEN chart = 'areas' THEN 'inscritos/as' END, n, round(p, 9),
  row_number() OVER (PARTITION BY chart ORDER BY p, level = other, level) FROM lp""",
    "report_applicants": _sql_report(f"WITH a AS ({SQL_ANSWERS} FROM customer)"),
    "report_admitted": _sql_report(f"WITH {SQL_ADMITTED}, a AS ({SQL_ANSWERS} FROM admitted)"),
    "codebook_file": """
SELECT 'Label of ' || o_orderstatus AS o_orderstatus_label, 'Label of ' || o_orderpriority AS o_orderpriority_label, count(*) AS n
FROM orders GROUP BY 1, 2""",
}
