import datetime as dt
import tempfile

from pyspark.sql import functions as F

from featurespark.sources import history as H
from featurespark.sources import io as IO


def test_append_run_and_reports(spark):
    path = tempfile.mkdtemp(prefix="fs-hist-") + "/history"
    eda = spark.createDataFrame([("a1", "ds", "t", ["x", "y"], 10, 2, "{}")],
                                "analysis_id string, dataset string, table_name string, columns array<string>, "
                                "rows_count long, columns_count long, payload string")
    H.append_run(path, "eda", eda, "r1", dt.datetime(2024, 1, 1))
    eda2 = eda.withColumn("columns", F.array(F.lit("x"), F.lit("y"), F.lit("z")))
    H.append_run(path, "eda", eda2, "r2", dt.datetime(2024, 1, 2))
    fe = spark.createDataFrame([("ds", "t", "x", "log_transformation", "skew"),
                                ("ds", "t", "y", "standardization", "scale")],
                               "dataset string, table_name string, feature_name string, technique string, reason string")
    H.append_run(path, "fe", fe, "r3", dt.datetime(2024, 1, 3))
    tr = spark.createDataFrame([("ds", "t_transformed", "t_transformed", "[]", "done")],
                               "dataset string, table_name string, target_table string, specs string, status string")
    H.append_run(path, "transform", tr, "r4", dt.datetime(2024, 1, 4))
    cols = [r["column_name"] for r in H.latest_columns(spark, path, "ds", "t").orderBy("position").collect()]
    assert cols == ["x", "y", "z"]
    rep = {r["section"]: r["run_id"] for r in H.consolidated_report(spark, path, "ds", "t").collect()}
    assert rep == {"eda": "r2", "fe": "r3", "transform": "r4"}


def test_workspaces_and_state(spark):
    existing = spark.createDataFrame([("a",), ("b",)], "table_name string")
    lists = spark.createDataFrame([(" a, c ,, d",), ("c",)], "table_list string")
    res = {r["table_name"]: r["status"] for r in H.add_workspaces(existing, lists).collect()}
    assert res == {"a": "duplicate", "c": "added", "d": "added"}
    assert H.new_workspace_rows(H.add_workspaces(existing, lists)).count() == 2
    log = spark.createDataFrame([("t", "EDA_status", "running", dt.datetime(2024, 1, 1, 0, 0)),
                                 ("t", "EDA_status", "completed", dt.datetime(2024, 1, 1, 1, 0)),
                                 ("t", "FE_status", "running", dt.datetime(2024, 1, 1, 2, 0))],
                                "table_name string, phase string, status string, ts timestamp_ntz")
    st = H.phase_state(log, "table_name", "phase", "status", "ts", H.PHASES).first()
    assert st["EDA_status"] == "completed" and st["FE_status"] == "running" and st["DAG_status"] is None
    lst = H.list_workspaces(H.phase_state(log, "table_name", "phase", "status", "ts", H.PHASES),
                            dt.datetime(2024, 1, 1, 3, 0, 30)).first()
    assert lst["age"] == "1 hour ago" and lst["status"] == "in_progress"


def test_io_roundtrip(spark):
    from pyspark.sql import types as T
    path = tempfile.mkdtemp(prefix="fs-io-") + "/t"
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    IO.append_batch(spark.createDataFrame([(1,)], "a int"), path, schema)
    IO.append_batch(spark.createDataFrame([(2, "x")], "a long, b string"), path, schema)
    back = IO.scan(spark, path, where=F.col("a") > 0).orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in back] == [(1, None), (2, "x")]
    assert IO.keyed_lookup(IO.scan(spark, path), "a", 2).count() == 1
    tiny = IO.sample_scan(spark.range(0, 2_000_000), 5e-7)
    assert tiny.count() in range(0, 8) and IO.sample_scan(spark.range(0, 2_000_000), 4e-6).count() >= 1
    s1 = IO.sample_scan(spark.range(0, 10000), 0.1).count()
    assert 800 < s1 < 1200 and s1 == IO.sample_scan(spark.range(0, 10000), 0.1).count()


def test_records_and_apply_and_write(spark, customers):
    from featurespark.operators import leakage as LK
    from featurespark.operators import profile as P
    from featurespark.operators import recommend as RC
    from featurespark.plans.chain import apply_and_write
    path = tempfile.mkdtemp(prefix="fs-rec-") + "/history"
    rep = P.profile(customers, target="category")
    H.record_profile(path, "ds", "customers", customers, rep, dt.datetime(2024, 5, 1))
    rec = RC.recommendations(customers, target="category")
    H.record_recommendations(path, "ds", "customers", rec, dt.datetime(2024, 5, 2))
    lk = LK.leakage_summary(LK.leakage_report(customers, "income"))
    H.record_leakage(path, "ds", "customers", lk, dt.datetime(2024, 5, 3))
    out = tempfile.mkdtemp(prefix="fs-out-") + "/customers_transformed"
    specs = [{"column_name": "age", "fe_method": "impute_mean"}, {"column_name": "age", "fe_method": "standardization"}]
    res = apply_and_write(customers, specs, "category", out)
    assert spark.read.parquet(out).count() == 8 and res.lineage[0]["output_column"] == "age_imputed_scaled"
    H.record_transform(spark, path, "ds", "customers", specs, ts=dt.datetime(2024, 5, 4))
    sections = {r["section"] for r in H.consolidated_report(spark, path, "ds", "customers").collect()}
    assert sections == {"eda", "eda_rows", "fe", "leakage", "transform"}
    cols = [r["column_name"] for r in H.latest_columns(spark, path, "ds", "customers").orderBy("position").collect()]
    assert cols == customers.columns


def test_sample_rows_is_topn(spark):
    df = spark.range(0, 20000)
    a = IO.sample_rows(df, 1500)
    assert a.count() == 1500
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in IO.sample_rows(df, 1500).collect())
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_phase_events_roundtrip(spark):
    path = tempfile.mkdtemp(prefix="fs-ev-") + "/events"
    H.append_phase_event(spark, path, "t1", "EDA_status", "running", dt.datetime(2024, 1, 1, 0, 0))
    H.append_phase_event(spark, path, "t1", "EDA_status", "completed", dt.datetime(2024, 1, 1, 0, 5))
    H.append_phase_event(spark, path, "t2", "FE_status", "failed", dt.datetime(2024, 1, 2))
    st = {r["table_name"]: r for r in H.workspace_state(spark, path).collect()}
    assert st["t1"]["EDA_status"] == "completed" and st["t2"]["FE_status"] == "failed"
    one = H.workspace_state(spark, path, "t2").collect()
    assert len(one) == 1 and one[0]["last_updated"] == dt.datetime(2024, 1, 2)
    H.compact_phase_events(spark, path, path + "-compact")
    again = {r["table_name"]: r for r in H.workspace_state(spark, path + "-compact").collect()}
    assert again == st
    import pytest
    with pytest.raises(ValueError):
        H.append_phase_event(spark, path, "t1", "nope", "x")


def test_a_cut_run_stays_invisible(spark, customers):
    """Only the first of a run's two writes happened: no reader sees it, and a second attempt counts once."""
    import pytest
    from featurespark.operators import profile as P
    path = tempfile.mkdtemp(prefix="fs-cut-") + "/history"
    assert H.read_history(spark, path, "eda").collect() == []
    rep = {"overview": P.overview(customers), "missing_values": P.missing_report(customers)}
    H.record_profile(path, "ds", "customers", customers, rep, dt.datetime(2024, 5, 1))
    before = sorted(map(repr, H.consolidated_report(spark, path, "ds", "customers").collect()))
    broken = dict(rep, missing_values=rep["missing_values"].select("column_name", F.raise_error(F.lit("lost")).alias("missing_count")))
    with pytest.raises(Exception):
        H.record_profile(path, "ds", "customers", customers.drop("age"), broken, dt.datetime(2024, 5, 2))
    assert spark.read.parquet(path).where("section = 'eda'").count() == 2          # the header was written
    assert H.read_history(spark, path, "eda").count() == 1
    assert sorted(map(repr, H.consolidated_report(spark, path, "ds", "customers").collect())) == before
    assert H.latest_columns(spark, path, "ds", "customers").count() == len(customers.columns)
    H.record_profile(path, "ds", "customers", customers.drop("age"), rep, dt.datetime(2024, 5, 2))
    assert H.read_history(spark, path, "eda").count() == 2
    assert H.latest_columns(spark, path, "ds", "customers").count() == len(customers.columns) - 1


def test_snapshots_of_phase_events(spark):
    """State by snapshots equals the fold of all events, whenever events came; only new generations are read."""
    path = tempfile.mkdtemp(prefix="fs-snap-") + "/events"
    log = []

    def event(table, phase, status, minute):
        ts = dt.datetime(2024, 1, 1, 0, minute)
        log.append((table, phase, status, ts))
        H.append_phase_event(spark, path, table, phase, status, ts)

    def same():
        whole = spark.createDataFrame(log, H.PHASE_EVENT_SCHEMA)
        want = H.phase_state(whole, "table_name", "phase", "status", "ts", H.PHASES, "status").collect()
        got = H.workspace_state(spark, path)
        assert sorted(map(repr, got.select(*whole_columns(want)).collect())) == sorted(map(repr, want))

    def whole_columns(rows):
        return rows[0].__fields__

    event("t1", "EDA_status", "running", 1)
    event("t2", "FE_status", "running", 2)
    same()
    assert [H.snapshot_phase_events(spark, path) for _ in range(2)] == [0, 1]
    event("t1", "EDA_status", "completed", 5)
    event("t1", "FE_status", "running", 3)
    same()
    assert H.snapshot_phase_events(spark, path) == 2
    event("t2", "FE_status", "late", 1)                       # older than what the snapshot holds
    event("t2", "FE_status", "running", 2)                    # a tie
    same()
    assert H.snapshot_phase_events(spark, path) == 3
    same()
    read = H._newer(spark, path, H._snapshot(spark, path))
    assert read.count() < len(log) and "(gen#" in (plan := read._jdf.queryExecution().executedPlan().toString()) and " > 3)" in plan
    history = path + "-history"
    eda = spark.createDataFrame([("a", "ds", t) for t in ("t1", "t2")], "analysis_id string, dataset string, table_name string")
    H.append_run(history, "eda", eda, "r1", dt.datetime(2024, 1, 1))
    H.append_run(history, "eda", eda, "r2", dt.datetime(2024, 1, 2))
    assert [(r["table_name"], r["run_id"]) for r in H.latest_analysis(spark, history, path).collect()] == [("t1", "r2")]
