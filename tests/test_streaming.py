"""The streaming first-submission aggregate equals the batch job on the same rows."""

import os

from pyspark.sql import functions as F

from seatwise.plans.config import IntakeConfig
from seatwise.plans.intake import clean_intake
from seatwise.streaming import finish, first_submissions, response_stream
from tests.fixtures import SCHEMA, TEST_NAME, response_rows


def test_stream_matches_batch(spark, scratch):
    rows = response_rows()
    folder = os.path.join(scratch, "in")
    # Two arrivals; the second holds earlier-timed answers for some people.
    spark.createDataFrame(rows[1::2], SCHEMA).coalesce(1).write.parquet(f"{folder}/a")
    cfg = IntakeConfig(exclude_names=(TEST_NAME,))
    stream = response_stream(spark, f"{folder}/*", SCHEMA, max_files_per_trigger=1)
    q = (first_submissions(stream, cfg).writeStream.outputMode("complete").format("memory")
         .queryName("firsts").option("checkpointLocation", os.path.join(scratch, "ck")).start())
    q.processAllAvailable()
    spark.createDataFrame(rows[0::2], SCHEMA).coalesce(1).write.parquet(f"{folder}/b")
    q.processAllAvailable()
    q.stop()
    got = finish(spark.table("firsts"), cfg)
    want = clean_intake(spark.createDataFrame(rows, SCHEMA), cfg)
    cols = sorted(want.columns)
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
    assert got.filter(F.col("nombre") == "rita repeat").count() == 0


def test_update_mode_changes_sink(spark, scratch):
    from seatwise.streaming import changes_sink, current_firsts

    rows = response_rows()
    folder = os.path.join(scratch, "in")
    spark.createDataFrame(rows[1::2], SCHEMA).coalesce(1).write.parquet(f"{folder}/a")
    cfg = IntakeConfig(exclude_names=(TEST_NAME,))
    out = os.path.join(scratch, "changes")
    stream = response_stream(spark, f"{folder}/*", SCHEMA, max_files_per_trigger=1)
    q = (first_submissions(stream, cfg).writeStream.outputMode("update")
         .foreachBatch(changes_sink(out)).option("checkpointLocation", os.path.join(scratch, "ck2")).start())
    q.processAllAvailable()
    spark.createDataFrame(rows[0::2], SCHEMA).coalesce(1).write.parquet(f"{folder}/b")
    q.processAllAvailable()
    q.stop()
    got = current_firsts(spark, out)
    want = clean_intake(spark.createDataFrame(rows, SCHEMA), cfg)
    cols = sorted(want.columns)
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_stream_switches_match_batch(spark, scratch):
    from dataclasses import replace
    rows = response_rows()
    folder = os.path.join(scratch, "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/a")
    cfg = replace(IntakeConfig(exclude_names=(TEST_NAME,)), validate_before_dedup=True,
                  dedup_extra_keys=("correo",))
    stream = response_stream(spark, f"{folder}/*", SCHEMA)
    q = (first_submissions(stream, cfg).writeStream.outputMode("complete").format("memory")
         .queryName("firsts_sw").option("checkpointLocation", os.path.join(scratch, "ck3")).start())
    q.processAllAvailable()
    q.stop()
    got = finish(spark.table("firsts_sw"), cfg)
    want = clean_intake(spark.createDataFrame(rows, SCHEMA), cfg)
    cols = sorted(want.columns)
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_stream_keeps_people_apart_like_the_batch(spark, scratch):
    """Names that the rewriting makes equal, and extra grouping keys."""
    from dataclasses import replace

    from seatwise.streaming import changes_sink, current_firsts

    base = [r for r in response_rows()][0]
    fields = [f.split()[0].strip("`") for f in SCHEMA.split(", ")] if isinstance(SCHEMA, str) else SCHEMA.names
    i, j = fields.index("nombre"), fields.index("correo")
    row = lambda n, c: tuple(n if k == i else c if k == j else v for k, v in enumerate(base))
    rows = [row("S", "a@b.cl"), row("Sí", "a@b.cl"), row("Sí", "c@d.cl"), row("Ana", "a@b.cl")]
    for n, extra in enumerate([(), ("correo",)]):
        cfg = replace(IntakeConfig(), dedup_extra_keys=extra)
        folder, out = os.path.join(scratch, f"in{n}"), os.path.join(scratch, f"out{n}")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/a")
        q = (first_submissions(response_stream(spark, f"{folder}/*", SCHEMA), cfg).writeStream.outputMode("update")
             .foreachBatch(changes_sink(out)).option("checkpointLocation", os.path.join(scratch, f"ck{n}")).start())
        q.processAllAvailable()
        q.stop()
        want = clean_intake(spark.createDataFrame(rows, SCHEMA), cfg)
        got = current_firsts(spark, out, cfg)
        assert sorted(r["nombre"] for r in got.collect()) == sorted(r["nombre"] for r in want.collect())
        assert got.count() == (3 if not extra else 4)


def _run_final(spark, scratch, arrivals, cfg, late="0 seconds"):
    """Feed the arrivals one after another: rows out after each, and rows of state."""
    from seatwise.streaming import final_submissions

    folder, out, told = os.path.join(scratch, "in"), os.path.join(scratch, "out"), []
    os.makedirs(folder)
    final = final_submissions(response_stream(spark, folder, SCHEMA, 1), cfg, late)
    q = (final.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(scratch, "ck")).start())
    try:
        for rows in arrivals:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            q.processAllAvailable()
            told.append((spark.read.schema(final.schema).parquet(out).count(),
                         q.lastProgress["stateOperators"][0]["numRowsTotal"]))
    finally:
        q.stop()
    return spark.read.schema(final.schema).parquet(out), told


def test_final_rows_equal_the_batch_and_leave_no_state(spark, scratch):
    rows = response_rows()
    cfg = IntakeConfig(exclude_names=(TEST_NAME,))
    t = [f.split()[0] for f in SCHEMA.split(", ")].index("time_end")
    before = [r for r in rows if r[t] is None or r[t] <= cfg.cutoff]
    after = [r for r in rows if r[t] is not None and r[t] > cfg.cutoff]
    assert before and after
    # the second arrival holds earlier answers of some people; the last is a straggler, too late
    straggler = tuple("2026-05-01 10:00:00" if i == t else v for i, v in enumerate(before[2]))
    got, told = _run_final(spark, scratch, [before[1::2], before[0::2], after, [straggler]], cfg)
    assert [n for n, _ in told[:2]] == [0, 0] and told[0][1] > 0
    want = clean_intake(spark.createDataFrame(rows, SCHEMA), cfg)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got.select(*cols).collect(), key=key) == sorted(want.select(*cols).collect(), key=key)
    assert told[2] == told[3] == (want.count(), 0)


def test_final_rows_wait_for_late_answers(spark, scratch):
    rows = [r for r in response_rows() if r[0] in ("s14", "s16", "s17")]      # s14: a second after the closing
    got, told = _run_final(spark, scratch, [rows], IntakeConfig(), late="1 hour")
    assert got.count() == 0 and told[0][1] == 2


def test_final_rows_need_a_closing_time(spark, scratch):
    import pytest

    from seatwise.streaming import final_submissions

    stream = response_stream(spark, scratch, SCHEMA)
    for cfg in (IntakeConfig(cutoff=None), IntakeConfig(cutoff="1899-01-01 00:00:00"), IntakeConfig(identity="linked")):
        with pytest.raises(ValueError):
            final_submissions(stream, cfg)
