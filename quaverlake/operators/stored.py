"""Catalogue tables as stored tables that a refresh changes in place.

A table is dealt by its key twice: into bands, which are partitions that a batch rewrites alone, and in these into buckets, so that joins on the key need no shuffle of the
table. A batch is shuffled to the table, not the table to the batch, and bands that it doesn't touch are neither read nor written. Bands are replaced as a whole when
their new files are complete, so a failed batch leaves the old ones, and a batch that runs twice gives the same table."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .reconcile import upsert

BANDS, BUCKETS = 16, 16


def _band(key: str, bands: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bands)).cast("int")


def create_table(df: DataFrame, name: str, key: str, path: str, bands: int = BANDS, buckets: int = BUCKETS) -> None:
    """The stored table `name` of the rows of df below `path`, dealt by `key`."""
    rows = df.withColumn("band", _band(key, bands)).repartition(buckets, key)
    rows.write.mode("overwrite").partitionBy("band").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('bands' = '{bands}')")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """The table as it is now, also where another session has changed it."""
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _bands(spark: SparkSession, name: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {name} ('bands')").first().value)


@contextmanager
def _overwriting(spark: SparkSession, mode: str):
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, mode)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _touched(rows: DataFrame) -> list[int]:
    """The bands of rows; there are no more than the table has."""
    return sorted(r.band for r in rows.select("band").distinct().collect())


def _replace(spark: SparkSession, name: str, rows: DataFrame, bands: list[int]) -> None:
    """Writes these bands of a table anew; those that get no row become empty."""
    if not bands:
        return
    table = spark.table(name)
    with _overwriting(spark, "dynamic"):
        rows.select(*table.columns).write.insertInto(name, overwrite=True)
    spark.catalog.refreshTable(name)


def _empty(spark: SparkSession, name: str, bands: list[int]) -> None:
    columns = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in spark.table(name).schema if f.name != "band")
    with _overwriting(spark, "static"):
        for band in bands:
            spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (band = {band}) SELECT {columns} WHERE false")
    spark.catalog.refreshTable(name)


def upserted(spark: SparkSession, name: str, batch: DataFrame, key: str, refresh_id: str) -> tuple[DataFrame, list[int]]:
    """The rows of the bands that a batch touches, after it, and these bands. Batch keys are unique."""
    fresh = batch.withColumn("band", _band(key, _bands(spark, name)))
    bands = _touched(fresh)
    return upsert(spark.table(name).where(F.col("band").isin(bands)), fresh, key, refresh_id), bands


def upsert_table(spark: SparkSession, name: str, batch: DataFrame, key: str, refresh_id: str) -> None:
    """Batch rows replace those of their key in the table and get the refresh id; all others stay."""
    _replace(spark, name, *upserted(spark, name, batch, key, refresh_id))


def replace_owned(spark: SparkSession, name: str, owners: DataFrame, rows: DataFrame, owner: str) -> None:
    """Rows of the stored table of links `name`, dealt by `owner`, are replaced by `rows` for all `owners` (a column of that name), also for those that have none now."""
    bands = _bands(spark, name)
    owned = owners.select(owner).distinct().withColumn("band", _band(owner, bands))
    touched = _touched(owned)
    kept = spark.table(name).where(F.col("band").isin(touched)).join(owned.select(owner), owner, "left_anti")
    left = kept.unionByName(rows.withColumn("band", _band(owner, bands)))
    still = set(_touched(left))
    _replace(spark, name, left, sorted(still))
    _empty(spark, name, [b for b in touched if b not in still])


def unseen_removed(spark: SparkSession, name: str, refresh_id: str) -> tuple[DataFrame, list[int], list[int]]:
    """(rows, bands, emptied): what is left of the bands that hold rows which this refresh did not see, these bands, and those of them that nothing is left of."""
    table, seen = spark.table(name), F.col("seen_refresh_id").eqNullSafe(F.lit(refresh_id))
    bands = _touched(table.where(~seen))
    left = table.where(F.col("band").isin(bands)).where(seen)
    still = set(_touched(left)) if bands else set()
    return left, sorted(still), [b for b in bands if b not in still]


def linked(spark: SparkSession, links: str, owner: str, owners: str, key: str) -> DataFrame:
    """Rows of a table of links whose owner is in the stored table of owners. Both are dealt by it, so neither is shuffled."""
    return spark.table(links).join(spark.table(owners).select(F.col(key).alias(owner)), owner, "left_semi")


def delete_unseen_tables(spark: SparkSession, tables: list[str], links: dict[str, str], tracks: str, refresh_id: str) -> None:
    """Takes rows out of stored tables that this refresh did not see, then links, {name: column of the track's id}, of tracks that are gone."""
    for name in tables:
        left, bands, emptied = unseen_removed(spark, name, refresh_id)
        _replace(spark, name, left, bands)
        _empty(spark, name, emptied)
    for name, owner in links.items():
        gone = spark.table(name).join(spark.table(tracks).select(F.col("source_id").alias(owner)), owner, "left_anti")
        bands = _touched(gone)
        left = linked(spark, name, owner, tracks, "source_id").where(F.col("band").isin(bands))
        still = set(_touched(left)) if bands else set()
        _replace(spark, name, left, sorted(still))
        _empty(spark, name, [b for b in bands if b not in still])
