"""Constraint reports, orphan handling and additive schema changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid import schemas


def _outside(column: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(~F.col(column).isin(*values), F.lit(True))


def _positive(column: str) -> Column:
    return F.col(column) <= 0


def _negative(column: str) -> Column:
    return F.col(column) < 0


def row_rules(table: str) -> dict[str, Column]:
    """Row checks of a table: name to a condition that is true for a violation."""
    rules = {f"{c} unknown": _outside(c, v) for c, v in schemas.ENUM_COLUMNS[table].items()}
    for field in schemas.TABLES[table].fields:
        if not field.nullable:
            rules[f"{field.name} missing"] = F.col(field.name).isNull()
    if table == "recordings":
        rules["duration_ms negative"] = _negative("duration_ms")
    elif table == "transcript_segments":
        rules["segment_index negative"] = _negative("segment_index")
        rules["start_ms negative"] = _negative("start_ms")
        rules["end before start"] = F.col("end_ms") < F.col("start_ms")
        rules["confidence out of range"] = ~F.col("confidence").between(0.0, 1.0)
    elif table == "processing_jobs":
        rules["attempts negative"] = _negative("attempts")
        rules["max_attempts not positive"] = _positive("max_attempts")
    elif table == "recording_sessions":
        rules["video_source_kind unknown"] = _outside("video_source_kind", schemas.SOURCE_KINDS)
        for c in ("video_source_process_id", "video_source_window_id", "frame_count",
                  "duration_ms", "audio_byte_count", "microphone_audio_byte_count",
                  "source_audio_byte_count"):
            rules[f"{c} negative"] = _negative(c)
        for c in ("width", "height", "frame_rate", "audio_sample_rate", "audio_channels",
                  "microphone_audio_sample_rate", "microphone_audio_channels",
                  "source_audio_sample_rate", "source_audio_channels"):
            rules[f"{c} not positive"] = _positive(c)
    return rules


UNIQUE_KEYS = {
    "recordings": [["id"], ["recording_directory"]],
    "transcripts": [["id"], ["recording_id"]],
    "transcript_segments": [["id"], ["transcript_id", "segment_index"]],
    "ai_summaries": [["id"], ["recording_id"]],
    "processing_jobs": [["id"]],
    "recording_sessions": [["id"], ["recording_id"]],
}

FOREIGN_KEYS = {
    "transcripts": {"recording_id": "recordings"},
    "transcript_segments": {"transcript_id": "transcripts", "recording_id": "recordings"},
    "ai_summaries": {"recording_id": "recordings"},
    "processing_jobs": {"recording_id": "recordings"},
    "recording_sessions": {"recording_id": "recordings"},
}


def check_rows(table: str, rows: DataFrame) -> DataFrame:
    """table_name, rule, violations for all row checks, in one pass over the table."""
    rules = row_rules(table)
    counts = rows.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name)
                        for name, bad in rules.items()])
    pairs = F.explode(F.map_from_arrays(
        F.array(*map(F.lit, rules)), F.array(*[F.col(f"`{n}`") for n in rules])))
    return counts.select(pairs.alias("rule", "violations")).select(
        F.lit(table).alias("table_name"), "rule", "violations")


def check_unique(table: str, rows: DataFrame) -> DataFrame:
    """Number of key values that occur more than once, per unique key."""
    out = []
    for keys in UNIQUE_KEYS[table]:
        repeated = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        out.append(repeated.agg(F.count("*").alias("violations")).select(
            F.lit(table).alias("table_name"), F.lit("unique " + ", ".join(keys)).alias("rule"),
            "violations"))
    return reduce(DataFrame.unionByName, out)


def orphans(rows: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Rows whose non-null reference has no parent row."""
    return rows.where(F.col(column).isNotNull()).join(
        parent.select(F.col("id").alias(column)), column, "left_anti")


def check_references(table: str, tables: dict[str, DataFrame]) -> DataFrame | None:
    out = []
    for column, parent in FOREIGN_KEYS.get(table, {}).items():
        out.append(orphans(tables[table], column, tables[parent]).agg(
            F.count("*").alias("violations")).select(
            F.lit(table).alias("table_name"), F.lit(f"{column} without parent").alias("rule"),
            "violations"))
    return reduce(DataFrame.unionByName, out) if out else None


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of every declared check of the given tables."""
    parts = []
    for name, rows in tables.items():
        parts += [check_rows(name, rows), check_unique(name, rows), check_references(name, tables)]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def drop_children(children: DataFrame, recordings: DataFrame) -> DataFrame:
    """Children of deleted recordings drop."""
    return children.join(recordings.select(F.col("id").alias("recording_id")),
                         "recording_id", "left_semi")


def release_jobs(jobs: DataFrame, recordings: DataFrame) -> DataFrame:
    """Jobs of deleted recordings stay, without their recording. Jobs that have none already
    go round the join, where their null keys would meet in one task."""
    alive = recordings.select(F.col("id").alias("_alive"))
    own = jobs.where("recording_id IS NOT NULL")
    joined = own.join(alive, F.col("recording_id") == F.col("_alive"), "left")
    return joined.select(*[
        F.col("_alive").alias("recording_id") if c == "recording_id" else F.col(c)
        for c in jobs.columns]).unionByName(jobs.where("recording_id IS NULL"))


def evolve(rows: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    """Rows of an older table version in the current schema: missing columns are added
    with their default, present ones keep their values."""
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(defaults.get(f.name)))
        .cast(f.dataType).alias(f.name) for f in schema.fields])


def union_versions(versions: list[DataFrame], schema: T.StructType, defaults: dict) -> DataFrame:
    """Parts of one table written under different schema versions."""
    return reduce(DataFrame.unionByName, [evolve(v, schema, defaults) for v in versions])
