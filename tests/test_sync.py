"""The masked copy: windows, idempotence, quarantine, reconciliation, and the stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cloakfield.functions.tokens import token
from cloakfield.operators import sync as S
from cloakfield.sources.policy import FieldSpec, Policy
from cloakfield.streaming.sync import masked_stream

SALT = "unit-test-salt-of-more-than-32-characters"
NOW = datetime(2024, 1, 10, 12)


def raw(spark, hours, ids=None):
    rows = [(i if ids is None else ids[i], NOW - timedelta(hours=h), f"user{i}") for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, "id int, ts timestamp, user string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def mask(fail=()):
    return lambda rows: rows.withColumn("user", token("USER", F.col("user"), SALT)).withColumn("masking_failure", F.when(F.col("id").isin(*fail), "boom") if fail else F.lit(None).cast("string"))


def paths(tmp_path):
    return str(tmp_path / "masked"), str(tmp_path / "quarantine")


def test_windows():
    assert S.next_window(None, NOW).start == NOW - timedelta(hours=24) and S.next_window(NOW - timedelta(hours=2), NOW).start == NOW - timedelta(hours=3)


def test_runs_add_nothing_twice(spark, tmp_path):
    m, q = paths(tmp_path)
    marks = S.Checkpoints(spark, str(tmp_path / "marks"))
    assert marks.read("a") is None
    first = S.sync(raw(spark, [1, 2, 30]), mask(), "a", marks, m, q, "id", "ts", NOW)
    assert first["masked"] == 2 and marks.read("a") == NOW
    S.sync(raw(spark, [1, 0.5, 30], [0, 7, 2]), mask(), "a", marks, m, q, "id", "ts", NOW + timedelta(hours=1))
    rows = spark.read.parquet(m).collect()
    assert sorted(r["id"] for r in rows) == [0, 1, 7] and all(r["user"].startswith("[USER_") for r in rows)


def test_quarantine_keeps_the_checkpoint(spark, tmp_path):
    m, q = paths(tmp_path)
    marks = S.Checkpoints(spark, str(tmp_path / "marks"))
    for _ in range(2):
        with pytest.raises(S.SyncError):
            S.sync(raw(spark, [1, 2]), mask(fail=(1,)), "a", marks, m, q, "id", "ts", NOW)
    bad = spark.read.parquet(q).collect()
    assert marks.read("a") is None and [(r["id"], r["quarantine_reason"], r["masking_error"]) for r in bad] == [(1, "boom", True)]


def test_migration_moves_flagged_rows(spark, tmp_path):
    m, q = paths(tmp_path)
    spark.createDataFrame([(1, True), (2, False)], "id int, masking_error boolean").write.parquet(m)
    assert S.migrate(m, q, spark, "id") == 1 and [r["id"] for r in spark.read.parquet(m).collect()] == [2] and [r["id"] for r in spark.read.parquet(q).collect()] == [1]
    assert S.migrate(m, q, spark, "id") == 0


def test_preflight_refuses_another_policy():
    from dataclasses import replace

    p = Policy("a", SALT, (FieldSpec("source.ip", "IP"),))
    S.preflight(p, replace(p, salt="not compared"))
    for other in (None, replace(p, fields=()), replace(p, mask_free_text_users=False)):
        with pytest.raises(S.SyncError):
            S.preflight(p, other)


def test_rows_are_deleted_by_condition(spark, tmp_path):
    m, _ = paths(tmp_path)
    spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, v string").write.parquet(m)
    S.delete_where(spark, m, F.col("v") == "x")
    assert sorted(r["id"] for r in spark.read.parquet(m).collect()) == [2, 3]


def test_stream_fails_closed_and_resumes(spark, tmp_path):
    m, q = paths(tmp_path)
    source = str(tmp_path / "raw")
    raw(spark, [1, 2, 3]).write.parquet(source)
    stream = lambda: spark.readStream.schema("id int, ts timestamp_ntz, user string").parquet(source)
    failing = masked_stream(stream(), mask(fail=(2,)), m, q, str(tmp_path / "cp"), "id", "ts")
    with pytest.raises(Exception):
        failing.processAllAvailable()
        failing.awaitTermination()
    assert spark.read.parquet(q).count() == 1
    for _ in range(2):
        masked_stream(stream(), mask(), m, q, str(tmp_path / "cp"), "id", "ts").awaitTermination()
    assert spark.read.parquet(m).count() == 3


def test_targets_are_read_written_and_dropped_by_day(spark, tmp_path):
    m, q = paths(tmp_path)
    marks = S.Checkpoints(spark, str(tmp_path / "marks"))
    counts = S.sync(raw(spark, [1, 2, 20, 22, 2], [1, 2, 3, 4, 2]), mask(), "a", marks, m, q, "id", "ts", NOW)
    assert (counts["source"], counts["masked"], counts["masked_new"], counts["quarantined"], counts["missing"]) == (5, 4, 4, 0, 0)
    assert list(S.days_of(spark, m)) == ["2024-01-09", "2024-01-10"] and not [p for p in tmp_path.iterdir() if "-run-" in p.name]
    pruned = S.in_days(spark.read.parquet(m), NOW - timedelta(hours=2), NOW)
    assert "PartitionFilters: [isnotnull(sync_day" in pruned._jdf.queryExecution().executedPlan().toString() and pruned.count() == 2
    again = S.sync(raw(spark, [1, 0.5], [1, 9]), mask(), "a", marks, m, q, "id", "ts", NOW + timedelta(minutes=10))
    assert (again["masked"], again["masked_new"]) == (2, 1)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "masked" / "sync_day=2024-01-09").iterdir()}
    S.delete_where(spark, m, F.col("id") == 2)
    assert sorted(r["id"] for r in spark.read.parquet(m).collect()) == [1, 3, 4, 9]
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "masked" / "sync_day=2024-01-09").iterdir()}  # the other day was left alone
    S.delete_where(spark, m, F.col("id") > 8)
    S.delete_where(spark, m, F.col("id") == 1)
    assert list(S.days_of(spark, m)) == ["2024-01-09"]
    assert S.drop_days(spark, m, NOW, 1) == [] and S.drop_days(spark, m, NOW + timedelta(days=1), 1) == ["2024-01-09"] and S.days_of(spark, m) == {}


def test_ids_are_needed_and_repeats_are_settled_alike(spark, tmp_path):
    m, q = paths(tmp_path)
    marks = S.Checkpoints(spark, str(tmp_path / "marks"))
    with pytest.raises(S.SyncError, match="no id"):
        S.sync(raw(spark, [1, 2], [None, 2]), mask(), "a", marks, m, q, "id", "ts", NOW)
    assert marks.read("a") is None and not (tmp_path / "masked").exists()
    df = raw(spark, [3, 1, 3], [1, 1, 1])
    kept = {tuple(S.one_each(df.repartition(n), "id", "ts").first()) for n in (1, 2, 3)}
    assert len(kept) == 1 and kept.pop()[1] == NOW - timedelta(hours=3)
