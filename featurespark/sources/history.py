"""Run history (R1–R3, R5–R7, R11, R13): the reference's metadata tables as
append-only tables on shared storage, read back with aggregates.

Parquet has no UPDATE, so state changes are appended as events and the
current state is derived: ``max_by(status, (ts, …))`` per key.  Latest-run
lookups are ``max_by`` aggregates joined back on the run id, so they scale
with runs × tables × columns and never sort the history.

A run becomes visible with its commit row, written after all its rows: readers leave out
what a cut run has written.  Phase events carry a generation; a snapshot folds the closed
ones, and readers merge the newest snapshot with the events after it.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col_of, ntz_lit
from .io import append_batch, conform, exists, listed, write_table

# FIXED VALUES: the five phase columns of a workspace.
PHASES = ["EDA_status", "FE_status", "DAG_status", "Leakage_status", "report_status"]

SECTION_SCHEMAS: dict[str, T.StructType] = {
    "eda": T.StructType([
        T.StructField("analysis_id", T.StringType()), T.StructField("dataset", T.StringType()),
        T.StructField("table_name", T.StringType()), T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("rows_count", T.LongType()), T.StructField("columns_count", T.LongType()),
        T.StructField("payload", T.StringType())]),
    # one row for each record of a report section, as JSON
    "eda_rows": T.StructType([
        T.StructField("dataset", T.StringType()), T.StructField("table_name", T.StringType()),
        T.StructField("part", T.StringType()), T.StructField("record", T.StringType())]),
    "fe": T.StructType([
        T.StructField("dataset", T.StringType()), T.StructField("table_name", T.StringType()),
        T.StructField("feature_name", T.StringType()), T.StructField("technique", T.StringType()),
        T.StructField("reason", T.StringType())]),
    "leakage": T.StructType([
        T.StructField("dataset", T.StringType()), T.StructField("table_name", T.StringType()),
        T.StructField("high_risk", T.IntegerType()), T.StructField("medium_risk", T.IntegerType()),
        T.StructField("low_risk", T.IntegerType()), T.StructField("payload", T.StringType())]),
    "transform": T.StructType([
        T.StructField("dataset", T.StringType()), T.StructField("table_name", T.StringType()),
        T.StructField("target_table", T.StringType()), T.StructField("specs", T.StringType()),
        T.StructField("status", T.StringType())]),
}


# ---------------------------------------------------------------------------
# R1 add workspaces
# ---------------------------------------------------------------------------
def parse_name_lists(lists: DataFrame, column: str) -> DataFrame:
    """Comma-separated name lists → distinct, trimmed, non-blank names."""
    names = lists.select(F.explode(F.split(col_of(column), ",")).alias("n"))
    return names.select(F.trim("n").alias("table_name")).where(F.col("table_name") != "").distinct()


def add_workspaces(existing: DataFrame, lists: DataFrame, column: str = "table_list") -> DataFrame:
    """(table_name, status): 'added' for names not present yet, 'duplicate'
    otherwise — anti / semi joins against the existing workspace names."""
    names = parse_name_lists(lists, column)
    known = existing.select("table_name").distinct()
    added = names.join(known, "table_name", "left_anti").withColumn("status", F.lit("added"))
    dup = names.join(known, "table_name", "left_semi").withColumn("status", F.lit("duplicate"))
    return added.unionByName(dup)


def new_workspace_rows(result: DataFrame, now: _dt.datetime | None = None) -> DataFrame:
    """Rows to append for the 'added' names (all phases pending)."""
    ts = ntz_lit(now or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))
    out = result.where(F.col("status") == "added").select(
        F.expr("uuid()").alias("id"), "table_name", F.lit("active").alias("status"), ts.alias("Last_updated"))
    for p in PHASES:
        out = out.withColumn(p, F.lit("pending"))
    return out


# ---------------------------------------------------------------------------
# R2 phase state, R3 workspace list
# ---------------------------------------------------------------------------
def phase_state(events: DataFrame, table: str, phase: str, status: str, ts: str, phases: list[str],
                tiebreak: str | None = None) -> DataFrame:
    """Current state per table: newest status of every phase (pivoted, one column
    per phase) and the time of the newest event."""
    order = F.struct(col_of(ts), col_of(tiebreak)) if tiebreak else col_of(ts)
    latest = events.groupBy(col_of(table).alias("table_name"), col_of(phase).alias("__phase")).agg(
        F.max_by(col_of(status), order).alias("__status"), F.max(col_of(ts)).alias("__ts"))
    wide = latest.groupBy("table_name").pivot("__phase", phases).agg(F.first("__status"))
    last = latest.groupBy("table_name").agg(F.max("__ts").alias("last_updated"))
    return wide.join(last, "table_name")


# FIXED VALUES: an age is told in the largest unit that it fills, a week or more as a date.
AGE_UNITS = [("second", 1, 60), ("minute", 60, 3600), ("hour", 3600, 86400), ("day", 86400, 604800)]


def age_text(ts: Column, now: Column) -> Column:
    """Age of ``ts`` at ``now`` in words, by AGE_UNITS; seconds are always plural."""
    elapsed = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(1_000_000))
    words = F.date_format(ts, "yyyy-MM-dd")
    for unit, size, limit in reversed(AGE_UNITS):
        n = F.floor(elapsed / size)
        plural = F.lit("s") if size == 1 else F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
        words = F.when(elapsed < limit, F.concat_ws(" ", n.cast("string"), F.concat(F.lit(unit), plural), F.lit("ago"))).otherwise(words)
    return words


def list_workspaces(state: DataFrame, now, ts: str = "last_updated", phases: list[str] | None = None) -> DataFrame:
    """(table_name, status, last_updated, age) newest first; ``now`` is a parameter.
    ``status`` is the state's own, or derived from ``phases``: completed when all of
    them are, pending when none has begun, else in_progress."""
    now_c = now if isinstance(now, Column) else ntz_lit(now)
    if "status" in state.columns:
        status = F.col("status")
    else:
        cols = [col_of(p) for p in (phases or [c for c in state.columns if c in PHASES])]
        every = [F.coalesce(c == "completed", F.lit(False)) for c in cols]
        idle = [c.isNull() | (c == "pending") for c in cols]
        status = (F.when(F.array_position(F.array(*every), False) == 0, "completed")
                  .when(F.array_position(F.array(*idle), False) == 0, "pending").otherwise("in_progress")) if cols else F.lit("active")
    return (state.select("table_name", status.alias("status"), col_of(ts).alias("last_updated"),
                         age_text(col_of(ts), now_c).alias("age"))
            .orderBy(F.col("last_updated").desc(), "table_name"))


# ---------------------------------------------------------------------------
# R5 latest row per key, R6 rows of the latest run, R11, R13
# ---------------------------------------------------------------------------
def latest_by_key(df: DataFrame, keys: list[str], ts: str, tiebreak: str | None = None) -> DataFrame:
    """Newest row per key (a max_by aggregate, no sort); equal times go by ``tiebreak``,
    or else by the row's JSON text, so the answer does not depend on the run."""
    others = [c for c in df.columns if c not in keys]
    order = F.struct(col_of(ts), col_of(tiebreak) if tiebreak else F.to_json(F.struct(*[col_of(c) for c in others])))
    agg = df.groupBy(*[col_of(k) for k in keys]).agg(
        F.max_by(F.struct(*[col_of(c) for c in others]), order).alias("__row"))
    return agg.select(*keys, *[F.col("__row")[c].alias(c) for c in others])


def latest_completed(results: DataFrame, state: DataFrame, key: str, ts: str, phase: str,
                     tiebreak: str | None = None) -> DataFrame:
    """The newest result per key, only where the key's phase is completed."""
    newest = latest_by_key(results, [key], ts, tiebreak)
    done = state.where(col_of(phase) == "completed").select(F.col("table_name").alias(key))
    return newest.join(done, key, "left_semi")


def latest_run_rows(df: DataFrame, keys: list[str], run: str, ts: str) -> DataFrame:
    """Every row of each key's newest run (max_by then an equi-join back)."""
    latest = (df.groupBy(*[col_of(k).alias(f"__k{i}") for i, k in enumerate(keys)])
              .agg(F.max_by(col_of(run), F.struct(col_of(ts), col_of(run))).alias("__run")))
    cond = [col_of(k) == F.col(f"__k{i}") for i, k in enumerate(keys)] + [col_of(run) == F.col("__run")]
    return df.join(latest, cond, "left_semi")


RUN_FIELDS = [T.StructField("run_id", T.StringType()), T.StructField("created_at", T.TimestampNTZType())]
PART_FIELDS = [T.StructField("section", T.StringType()), T.StructField("run_date", T.DateType())]
COMMIT_SCHEMA = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("attempt", T.StringType())])


def _stored_schema(section: str | None) -> T.StructType:
    """Columns of one section, or of all, as they lie in the history."""
    own = {f.name: f for name in ([section] if section else SECTION_SCHEMAS) for f in SECTION_SCHEMAS[name].fields}
    return T.StructType([*own.values(), *RUN_FIELDS, T.StructField("attempt", T.StringType()), *PART_FIELDS])


def run_rows(section: str, rows: DataFrame, run_id: str, ts: _dt.datetime) -> DataFrame:
    """One run's rows in the section's schema; all share ``run_id`` and ``created_at``."""
    full = T.StructType([*SECTION_SCHEMAS[section].fields, *RUN_FIELDS, *PART_FIELDS])
    return conform(rows.withColumn("run_id", F.lit(run_id)).withColumn("created_at", ntz_lit(ts))
                   .withColumn("section", F.lit(section)).withColumn("run_date", F.lit(ts.date())), full)


def append_run(history_path: str, section: str, rows: DataFrame, run_id: str | None = None,
               ts: _dt.datetime | None = None) -> str:
    """Append one run's rows to the section's history, partitioned by section and date."""
    return append_sections(history_path, {section: rows}, run_id, ts)


def append_sections(history_path: str, sections: dict[str, DataFrame], run_id: str | None = None,
                    ts: _dt.datetime | None = None) -> str:
    """Append the rows of one run to several sections as one commit: readers see all of
    them, once the commit row is written, or none. A run that was cut may be appended again
    under its id; what the first attempt left stays invisible."""
    run_id, attempt = run_id or uuid.uuid4().hex, uuid.uuid4().hex
    ts = ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    for section, rows in sections.items():
        write_table(run_rows(section, rows, run_id, ts).withColumn("attempt", F.lit(attempt)), history_path, mode="append",
                    partition_by=["section", "run_date"])
    spark = next(iter(sections.values())).sparkSession
    append_batch(spark.createDataFrame([(run_id, attempt)], COMMIT_SCHEMA).coalesce(1), _commits(history_path), COMMIT_SCHEMA)
    return run_id


def _commits(history_path: str) -> str:
    # a name with an underscore: readers of the history itself do not list it
    return f"{history_path.rstrip('/')}/_commits"


def read_history(spark: SparkSession, history_path: str, section: str | None = None) -> DataFrame:
    """Rows of committed runs, of one section or of all, by the sections' own schemas (no file
    is opened to find one). A history without a commit has no rows."""
    schema = _stored_schema(section)
    if not exists(spark, _commits(history_path)):
        return spark.createDataFrame([], schema).drop("attempt")
    df = spark.read.schema(schema).parquet(history_path)
    df = df.where(F.col("section") == section) if section else df   # partition pruning
    done = spark.read.schema(COMMIT_SCHEMA).parquet(_commits(history_path))
    return df.join(done, ["run_id", "attempt"], "left_semi").select(*[f.name for f in schema.fields if f.name != "attempt"])


def consolidated_report(spark: SparkSession, history_path: str, dataset: str, table: str) -> DataFrame:
    """R11 over a stored history; see :func:`consolidated`."""
    return consolidated(read_history(spark, history_path), dataset, table)


def consolidated(history: DataFrame, dataset: str, table: str) -> DataFrame:
    """Every record of the newest run of each section for one table, as (section,
    run_id, created_at, record json), one row per record however long the run; the
    transform run is keyed by the transformed table name, all others by the table."""
    key_table = F.when(F.col("section") == "transform", F.lit(f"{table}_transformed")).otherwise(F.lit(table))
    mine = history.where((F.col("dataset") == dataset) & (F.col("table_name") == key_table))
    # one row per section
    runs = mine.groupBy("section").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    rows = mine.join(F.broadcast(runs), ["section", "run_id"], "left_semi")
    own = [c for c in rows.columns if c not in ("section", "run_id", "created_at", "run_date")]
    return rows.select("section", "run_id", "created_at", F.to_json(F.struct(*[col_of(c) for c in own])).alias("record"))


def latest_columns(spark: SparkSession, history_path: str, dataset: str, table: str) -> DataFrame:
    """R13 over a stored history; see :func:`columns_of_latest`."""
    return columns_of_latest(read_history(spark, history_path, "eda"), dataset, table)


def columns_of_latest(eda: DataFrame, dataset: str, table: str) -> DataFrame:
    """(position, column_name) stored with the newest EDA run of a table."""
    mine = eda.where((F.col("dataset") == dataset) & (F.col("table_name") == table))
    newest = latest_by_key(mine, ["dataset", "table_name"], "created_at", "run_id")
    return newest.select(F.posexplode("columns").alias("position", "column_name"))


# ---------------------------------------------------------------------------
# R7 writers: one typed record per run, built on Spark from the report frames
# ---------------------------------------------------------------------------
def section_rows(dataset: str, table: str, report: dict[str, DataFrame]) -> DataFrame | None:
    """(dataset, table_name, part, record): every row of every report section as JSON."""
    out = None
    for part, d in report.items():
        rows = d.select(F.lit(dataset).alias("dataset"), F.lit(table).alias("table_name"), F.lit(part).alias("part"),
                        F.to_json(F.struct(*[col_of(c) for c in d.columns])).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out


def record_profile(history_path: str, dataset: str, table: str, df: DataFrame, report: dict[str, DataFrame],
                   ts: _dt.datetime | None = None) -> str:
    """R7 (EDA): one header row (analysis_id = dataset_table_utc, columns, counts) and one
    row for each record of each section, under the same run id and in one commit."""
    ts = ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    analysis_id = f"{dataset}_{table}_{ts.strftime('%Y%m%d%H%M%S')}"
    head = report["overview"].select(
        F.lit(analysis_id).alias("analysis_id"), F.lit(dataset).alias("dataset"), F.lit(table).alias("table_name"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"), F.col("rows").alias("rows_count"),
        F.col("columns").alias("columns_count"))
    rows = section_rows(dataset, table, {k: v for k, v in report.items() if k not in ("overview", "preview")})
    return append_sections(history_path, {"eda": head, **({"eda_rows": rows} if rows is not None else {})}, analysis_id, ts)


def record_recommendations(history_path: str, dataset: str, table: str, rec: DataFrame,
                           ts: _dt.datetime | None = None) -> str:
    """R7 (FE): one row per recommended feature, all sharing the run id."""
    rows = rec.select(F.lit(dataset).alias("dataset"), F.lit(table).alias("table_name"),
                      F.col("column_name").alias("feature_name"), "technique", "reason")
    return append_run(history_path, "fe", rows, ts=ts)


def record_leakage(history_path: str, dataset: str, table: str, summary: DataFrame,
                   ts: _dt.datetime | None = None) -> str:
    """R7 (leakage): the L4 summary row, risk lists as JSON."""
    rows = summary.select(F.lit(dataset).alias("dataset"), F.lit(table).alias("table_name"), "high_risk",
                          "medium_risk", "low_risk",
                          F.to_json(F.struct("high_risk_features", "medium_risk_features", "low_risk_features"))
                          .alias("payload"))
    return append_run(history_path, "leakage", rows, ts=ts)


def record_transform(spark: SparkSession, history_path: str, dataset: str, table: str, specs: list[dict],
                     target_table: str | None = None, status: str = "completed",
                     ts: _dt.datetime | None = None) -> str:
    """R7 (transform run): specs, target table (default ``<table>_transformed``), status."""
    import json
    target_table = target_table or f"{table}_transformed"
    rows = spark.createDataFrame([(dataset, target_table, target_table, json.dumps(specs), status)],
                                 "dataset string, table_name string, target_table string, specs string, status string")
    return append_run(history_path, "transform", rows, ts=ts)


# ---------------------------------------------------------------------------
# R2 write side: a status change is an appended event
# ---------------------------------------------------------------------------
PHASE_EVENT_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()), T.StructField("phase", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("ts", T.TimestampNTZType())])


def append_phase_event(spark: SparkSession, events_path: str, table: str, phase: str, status: str,
                       ts: _dt.datetime | None = None) -> None:
    """Record that ``phase`` of ``table`` is now ``status`` (the reference updates
    one of five phase columns in place; here the event is appended and
    ``phase_state`` derives the current state)."""
    if phase not in PHASES:
        raise ValueError(f"Unknown phase '{phase}'; expected one of {PHASES}")
    ts = ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    row = spark.createDataFrame([(table, phase, status, ts.isoformat(sep=" "))],
                                "table_name string, phase string, status string, ts string")
    row = row.select("table_name", "phase", "status", F.col("ts").cast("timestamp_ntz").alias("ts"),
                     F.lit(_snapshot(spark, events_path) + 2).alias("gen"))
    append_batch(row, events_path, T.StructType([*PHASE_EVENT_SCHEMA.fields, GENERATION]), partition_by=["gen"])


GENERATION = T.StructField("gen", T.LongType())


def _state_path(events_path: str, gen: int) -> str:
    return f"{events_path.rstrip('/')}/_state/{gen}"


def _snapshot(spark: SparkSession, events_path: str) -> int:
    """The newest finished snapshot, which covers the generations up to its number; -1: none.
    Events are appended two generations later, so the one that the next snapshot folds has
    been closed since the last one, and a slow writer has that long to finish."""
    names = [name for name in listed(spark, f"{events_path.rstrip('/')}/_state") if name.isdigit()]
    return max((int(n) for n in names if exists(spark, f"{_state_path(events_path, int(n))}/_SUCCESS")), default=-1)


def _newer(spark: SparkSession, events_path: str, gen: int) -> DataFrame:
    """Newest status per table and phase, from the snapshot ``gen`` and the events after it."""
    schema = T.StructType([*PHASE_EVENT_SCHEMA.fields, GENERATION])
    events = spark.read.schema(schema).parquet(events_path).where(F.col("gen") > gen).drop("gen")     # partition pruning
    return events if gen < 0 else events.unionByName(spark.read.schema(PHASE_EVENT_SCHEMA).parquet(_state_path(events_path, gen)))


def snapshot_phase_events(spark: SparkSession, events_path: str) -> int:
    """Fold the next closed generation of events into a new snapshot (one row for each table
    and phase); reads afterwards cost the snapshot and the events after it. Returns its number."""
    gen = _snapshot(spark, events_path)
    schema = T.StructType([*PHASE_EVENT_SCHEMA.fields, GENERATION])
    known = spark.read.schema(schema).parquet(events_path).where(F.col("gen") == gen + 1).drop("gen")
    if gen >= 0:
        known = known.unionByName(spark.read.schema(PHASE_EVENT_SCHEMA).parquet(_state_path(events_path, gen)))
    newest = known.groupBy("table_name", "phase").agg(F.max(F.struct("ts", "status")).alias("last"))
    newest.select("table_name", "phase", "last.status", "last.ts").write.parquet(_state_path(events_path, gen + 1))
    return gen + 1


def compact_phase_events(spark: SparkSession, events_path: str, target_path: str, files: int = 1) -> None:
    """Rewrite the event log, one small file per event, into ``files`` files at
    ``target_path``; point readers there and append new events to it."""
    rows = spark.read.schema(PHASE_EVENT_SCHEMA).parquet(events_path).withColumn("gen", F.lit(0).cast("long"))
    rows.coalesce(files).write.partitionBy("gen").parquet(target_path)


def workspace_state(spark: SparkSession, events_path: str, table: str | None = None) -> DataFrame:
    """Current phase columns (+ last update) of every table, or of one table; equal times go
    by the status. Reads the newest snapshot and the events after it."""
    ev = _newer(spark, events_path, _snapshot(spark, events_path))
    if table is not None:
        ev = ev.where(F.col("table_name") == table)          # pushed into the scan
    return phase_state(ev, "table_name", "phase", "status", "ts", PHASES, "status")


def latest_analysis(spark: SparkSession, history_path: str, events_path: str, phase: str = "EDA_status") -> DataFrame:
    """R5 over stored tables: the newest EDA header of each table whose ``phase`` is completed.
    Reads one header row a run, not the records, and the folded state."""
    heads = read_history(spark, history_path, "eda")
    return latest_completed(heads, workspace_state(spark, events_path), "table_name", "created_at", phase, "run_id")
