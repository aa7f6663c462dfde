"""Library tables on Parquet: checked reads and snapshot writes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid import schemas

BUCKETS = 64


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Scan with the declared schema; columns a caller does not use are not read."""
    return spark.read.schema(schemas.TABLES[table]).parquet(path)


def _unknown(table: str) -> Column:
    checks = [~F.coalesce(F.col(c).isin(*v), F.lit(False))
              for c, v in schemas.ENUM_COLUMNS[table].items()]
    return reduce(lambda a, b: a | b, checks, F.lit(False))


def valid_rows(rows: DataFrame, table: str) -> DataFrame:
    """Rows whose enum columns hold known values."""
    return rows.where(~_unknown(table))


def rejected_rows(rows: DataFrame, table: str) -> DataFrame:
    """Rows with an unknown enum value, with the column and value at fault."""
    faults = [
        F.when(~F.coalesce(F.col(c).isin(*v), F.lit(False)),
               F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit("null"))))
        for c, v in schemas.ENUM_COLUMNS[table].items()]
    if not faults:
        return rows.withColumn("fault", F.lit(None).cast("string")).where(F.lit(False))
    return rows.withColumn("fault", F.concat_ws(", ", *faults)).where(_unknown(table))


def _bucket(owner: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, owner: str, buckets: int, layout: str) -> None:
    order = list(dict.fromkeys(["bucket", owner, "id"]))
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").option("partitionOverwriteMode", layout)
     .partitionBy("bucket").parquet(path))


def write_snapshot(rows: DataFrame, path: str, owner: str = "id", buckets: int = BUCKETS) -> None:
    """Write a table snapshot laid out by recording.

    Rows go to folders by hash of the owning recording. Range partitioning on (folder,
    owner, row id) splits a recording that owns a large share of the rows over several
    files.
    """
    _write(rows.withColumn("bucket", _bucket(owner, buckets)), path, owner, buckets, "static")


def read_snapshot(spark: SparkSession, path: str, table: str) -> DataFrame:
    return _rows(spark.read.parquet(path), table)


def _rows(stored: DataFrame, table: str) -> DataFrame:
    """Rows of a snapshot; one without an id only keeps the folder of an emptied bucket."""
    return stored.where("id IS NOT NULL").select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.TABLES[table].fields])


def change_snapshot(spark: SparkSession, path: str, table: str, owners: DataFrame,
                    change: Callable[[DataFrame], DataFrame], owner: str = "id",
                    buckets: int = BUCKETS) -> list[int]:
    """Apply ``change``, a function from rows to rows, to the folders of some owners only.

    ``owners`` has the owner of every row the change may alter, add or drop, in its first
    column. Only their folders are read and written; files of all others stay as they are, so
    the cost follows the change and not the table. Each folder is replaced when the write
    commits. Returns the folders' numbers.
    """
    names = owners.select(F.col(owners.columns[0]).alias(owner))
    touched = sorted(r[0] for r in names.select(_bucket(owner, buckets)).distinct().collect())
    if not touched:
        return touched
    held = _rows(spark.read.parquet(path).where(F.col("bucket").isin(touched)), table)
    changed = change(held)
    rows = changed.withColumn("bucket", _bucket(owner, buckets)).where(F.col("bucket").isin(touched))
    # a folder that loses all rows would keep its old files without a row for it
    keepers = spark.createDataFrame([(k,) for k in touched], "bucket int")
    _write(rows.unionByName(keepers, allowMissingColumns=True), path, owner, buckets, "dynamic")
    return touched
